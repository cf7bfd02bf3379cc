"""Column queries: who reads or writes a table's columns, what a program exchanges with Db2, summaries and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.operators import definitions
from quarrylens.operators.uses import column_uses

from .index import CERTAIN, Index
from .tables import Result, expanded_targets, table_dependencies

_DML = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "LOAD INTO TABLE", "UNLOAD FROM TABLE"]
#: Contexts in which a column is compared or ordered, not carried.
FILTERS = ["WHERE", "ON", "HAVING", "ORDER BY", "GROUP BY", "INDEX", "SET-EXPR"]


def copybook_closure(index: Index, paths: DataFrame, hops: int = 3) -> DataFrame:
    """(path, def_path, hop, seq): the file itself at hop 0, then copybooks and DCLGENs it copies, up to three deep."""
    books = index.files.where(F.col("kind").isin("COPYBOOK", "DCLGEN")).select(F.col("path").alias("book"), F.col("member").alias("copied"))
    edges = index.copy_refs.join(books, "copied").select(F.col("path").alias("from_path"), "book", "seq")
    level = paths.select("path", F.col("path").alias("def_path"), F.lit(0).alias("hop"), F.lit(0).alias("seq"))
    found = level
    for hop in range(1, hops + 1):
        level = written(level.join(edges.withColumnRenamed("seq", "next"), F.col("def_path") == F.col("from_path")).select("path", F.col("book").alias("def_path"), F.lit(hop).alias("hop"), F.col("next").alias("seq")).distinct(), "copies")
        found = found.unionByName(level)
    return found.groupBy("path", "def_path").agg(F.min(F.struct("hop", "seq")).alias("order")).select("path", "def_path", "order.hop", "order.seq")


def host_definitions(index: Index, uses: DataFrame) -> DataFrame:
    """uses with host_def_path, host_def_line and host_def_pic: the program's own item, else the nearest copybook's."""
    wanted = uses.where("host_var <> ''").select("path", "host_var").distinct()
    reach = copybook_closure(index, wanted.select("path").distinct())
    last = index.items.groupBy("path", "name").agg(F.max_by(F.struct("line", "pic"), "item").alias("d"))
    field = F.element_at(F.split("host_var", r"\."), -1)
    found = wanted.join(reach, "path").withColumn("name", field).join(last.withColumnRenamed("path", "def_path"), ["def_path", "name"])
    best = found.groupBy("path", "host_var").agg(F.min_by(F.struct("def_path", "d"), F.struct("hop", "seq", "def_path")).alias("b"))
    rows = uses.join(best, ["path", "host_var"], "left")
    return rows.select(*uses.columns, F.coalesce("b.def_path", F.lit("")).alias("host_def_path"), F.coalesce("b.d.line", F.lit(0)).alias("host_def_line"), F.coalesce("b.d.pic", F.lit("")).alias("host_def_pic")).drop("b")


def finished(uses: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each (path, line, table, column, access, context, host variable), with the member."""
    key = ["path", "line", "table", "column", "access", "context", "host_var"]
    order = Window.partitionBy(*key).orderBy("unit", "stmt", "pos", "label")
    rows = uses.withColumn("nth", F.row_number().over(order)).where("nth = 1").withColumnRenamed("label", "label_")
    return rows.join(files.select("path", "member"), "path").withColumn("what", F.col("label_"))


@dataclass
class FieldResult:
    """The answer to a column query. ``frames`` are DataFrames by name; the properties collect them."""

    spec: str
    frames: dict[str, DataFrame]
    table_result: Result | None = None

    @cached_property
    def columns(self) -> list:
        return self.frames["columns"].orderBy("table", "seq").collect()

    @cached_property
    def uses(self) -> list:
        return self.frames["uses"].orderBy("member", "line", "column", "context", "host_var").collect()

    @cached_property
    def bindings(self) -> list:
        return self.frames["bindings"].orderBy("path", "line").collect()

    @cached_property
    def layout_dependents(self) -> dict[str, str]:
        return {r.member: r.why for r in self.frames["layout_dependents"].orderBy("member").collect()}

    @cached_property
    def table_access(self) -> dict[str, list[str]]:
        return {r.table: list(r.access) for r in self.frames["table_access"].orderBy("table").collect()}

    @cached_property
    def blind_spots(self) -> list[tuple]:
        return [tuple(r) for r in self.frames["blind_spots"].orderBy("path", "line", "kind", "detail").collect()]

    @cached_property
    def notes(self) -> list[str]:
        return [r.note for r in self.frames["notes"].orderBy("note").collect()]


def _assembled(index: Index, spec: str, paths: DataFrame, tables: DataFrame, include_read: bool) -> dict[str, DataFrame]:
    """Uses of the tables within the files; only those files' tokens are read."""
    known = written(index.known(), "known")
    tokens = written(index.tokens.join(paths, "path", "left_semi").where("unit >= 0"), "tokens")
    uses, holes, filled = (written(x, "uses") for x in column_uses(tokens, known))
    uses = uses.join(tables.select("table").distinct(), "table", "left_semi")
    if not include_read:
        uses = uses.where("access = 'WRITE'")
    uses = host_definitions(index, finished(uses, index.files)).select("column", "table", "access", "context", F.col("what").alias("stmt"), "host_var", "member", "path", "line", "host_def_path", "host_def_line", "host_def_pic")
    uses = written(uses, "uses")
    bindings, unbound = (written(x, "bindings") for x in definitions.host_bindings(index.items, index.columns, index.files))
    bindings = bindings.join(tables.select("table").distinct(), "table", "left_semi").select("column", "host_field", "pic", "member", "path", "line", "table")
    members = bindings.select("path", F.col("member").alias("copied")).distinct()
    users = index.copy_refs.join(members.select("copied").distinct(), "copied").join(index.files.select("path", "member"), "path").join(members.select("path"), "path", "left_anti")
    layout = users.groupBy("member").agg(F.concat(F.lit("COPY "), F.min("copied")).alias("why"))
    spots = holes.select("path", F.col("line").cast("int").alias("line"), "kind", "detail").unionByName(unbound.join(paths, "path", "left_semi").select("path", F.col("line").cast("int").alias("line"), "kind", "detail")).distinct()
    lists = filled.join(tables.select("table").distinct(), "table", "left_semi").join(index.files.select("path", "member", "library"), "path")
    note = lists.select(F.concat(F.upper("verb"), F.lit(" in "), "library", F.lit("("), "member", F.lit(") has no column list: all columns of "), "table", F.lit(" are taken")).alias("note")).distinct()
    columns = known.join(tables.select("table").distinct(), "table", "left_semi")
    return {"columns": columns, "uses": uses, "bindings": bindings, "layout_dependents": layout, "blind_spots": spots, "notes": note}


def field_dependencies(index: Index, spec: str, include_read: bool = True) -> FieldResult:
    """Columns of the table, their uses in all statements, host bindings, layout dependents, blind spots and notes."""
    result = table_dependencies(index, spec, data_hops=0)
    refs, targets = result.frames["refs"], result.frames["targets"]
    paths = refs.where(F.col("confidence") >= CERTAIN).select("path").distinct()
    frames = _assembled(index, spec, paths, targets, include_read)
    dynamic = refs.where(F.col("confidence") < CERTAIN).select(F.concat("member", F.lit(": dynamic SQL, its columns are not known")).alias("note")).distinct()
    views = targets.where(F.col("why").startswith("view over")).select(F.concat("table", F.lit(" is a "), "why", F.lit("; its uses are reported under its own name")).alias("note"))
    instream = refs.where(F.col("kind").isin("JCL", "PROC") & F.col("what").isin("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")).select(F.concat("member", F.lit(": instream SQL in JCL")).alias("note")).distinct()
    frames["notes"] = frames["notes"].unionByName(dynamic).unionByName(views).unionByName(instream)
    frames["table_access"] = refs.groupBy("table").agg(F.sort_array(F.collect_set("access")).alias("access"))
    frames["columns"] = frames["columns"].join(targets.where("why = 'the table itself'").select("table"), "table", "left_semi")
    return FieldResult(spec, frames, result)


def program_field_dependencies(index: Index, program: str, include_read: bool = True) -> FieldResult:
    """The same seen from one program: all tables it touches. An unknown program raises LookupError."""
    name = program.upper()
    named = index.programs.where(F.col("name") == name).select("path").unionByName(index.files.where((F.col("member") == name) & F.col("kind").isin("COBOL", "UNKNOWN", "SQL")).select("path")).distinct()
    named = written(named, "named")
    if not named.limit(1).count():
        raise LookupError(f"no program {name} in the index")
    refs = index.table_refs.join(named, "path", "left_semi")
    sure = refs.where((F.col("confidence") >= CERTAIN) & F.col("stmt_name").isin(*_DML)).withColumnRenamed("table_name", "table")
    frames = _assembled(index, name, named, sure, include_read)
    frames["table_access"] = sure.groupBy("table").agg(F.sort_array(F.collect_set("access")).alias("access"))
    unsure = refs.where(F.col("confidence") < CERTAIN).select("path", "line", F.lit("DYNAMIC-SQL").alias("kind"), F.concat_ws(" ", "stmt_name", "table_name").alias("detail"))
    frames["blind_spots"] = frames["blind_spots"].unionByName(unsure.withColumn("line", F.col("line").cast("int"))).distinct()
    return FieldResult(name, frames)


def boundary_fields(result: FieldResult, by_member: bool = False) -> DataFrame:
    """(table, column, direction, host_vars, pic, provenance): out is written, filter compared or ordered, in is read.

    ``by_member`` tells each member's exchange apart (first column), so that a row holds no more places than one file has.
    """
    keys = [*(["member"] if by_member else []), "table", "column", "direction"]
    uses, pics = result.frames["uses"], result.frames["bindings"].groupBy("table", "column").agg(F.max_by("pic", F.struct("path", "line")).alias("pic"))
    direction = F.when(F.col("access") == "WRITE", "out").when(F.col("context").isin(*FILTERS), "filter").otherwise("in")
    rows = uses.withColumn("direction", direction).groupBy(*keys).agg(
        F.sort_array(F.array_remove(F.collect_set("host_var"), "")).alias("host_vars"),
        F.transform(F.array_sort(F.collect_list(F.struct("member", "line", "path", "stmt", "context"))), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"), x["stmt"].alias("stmt"), x["context"].alias("context"))).alias("provenance"),
    )
    return rows.join(pics, ["table", "column"], "left").withColumn("pic", F.coalesce("pic", F.lit("")))


def db2_boundary(index: Index, program: str) -> dict:
    """A program's exchange with Db2 as plain data: an endpoint per table with typed fields, and what could not be told."""
    result = program_field_dependencies(index, program)
    fields: dict[str, list] = {t: [] for t in result.table_access}
    for r in boundary_fields(result).orderBy("table", "column", "direction").collect():
        fields.setdefault(r.table, []).append({"column": r.column, "direction": r.direction, "hostVars": list(r.host_vars), "pic": r.pic, "provenance": [p.asDict() for p in r.provenance]})
    return {
        "program": result.spec,
        "generatedBy": "quarrylens.db2_boundary",
        "endpoints": [{"type": "Db2", "object": t, "access": result.table_access.get(t, []), "fields": fields[t]} for t in sorted(fields)],
        "unmodeledConstructs": [{"construct": kind, "reason": detail, "provenance": {"path": path, "line": line}} for path, line, kind, detail in result.blind_spots],
        "notes": result.notes,
    }


def column_rollup(result: FieldResult) -> DataFrame:
    """(column, type, read_by, written_by, host_fields): a field bound with its picture wins over the bare variable."""
    uses, bindings, columns = result.frames["uses"], result.frames["bindings"], result.frames["columns"]
    by = uses.groupBy("column").agg(F.sort_array(F.collect_set(F.when(F.col("access") == "READ", F.col("member")))).alias("read_by"), F.sort_array(F.collect_set(F.when(F.col("access") != "READ", F.col("member")))).alias("written_by"))
    fields = uses.where("host_var <> ''").select("column", F.col("host_var").alias("f"), F.lit(None).cast("string").alias("bound"), F.col("host_var").alias("bare"))
    fields = fields.unionByName(bindings.select("column", F.col("host_field").alias("f"), F.trim(F.concat("host_field", F.lit(" PIC "), "pic")).alias("bound"), F.lit(None).cast("string").alias("bare")))
    fields = fields.groupBy("column", "f").agg(F.coalesce(F.max("bound"), F.max("bare")).alias("t")).groupBy("column").agg(F.sort_array(F.collect_set("t")).alias("host_fields"))
    names = columns.select(F.col("name").alias("column")).unionByName(uses.select("column")).unionByName(bindings.select("column")).distinct()
    types = columns.groupBy(F.col("name").alias("column")).agg(F.max("sql_type").alias("type"))
    none = F.array().cast("array<string>")
    rows = names.join(types, "column", "left").join(by, "column", "left").join(fields, "column", "left")
    return rows.select("column", F.coalesce("type", F.lit("")).alias("type"), *[F.coalesce(c, none).alias(c) for c in ("read_by", "written_by", "host_fields")])


def field_summary(result: FieldResult) -> dict:
    """The rollup with layout dependents, number of blind spots and notes, as plain data."""
    rows = column_rollup(result).orderBy("column").collect()
    return {
        "table": result.spec,
        "columns": {r.column: {"type": r.type, "read_by": list(r.read_by), "written_by": list(r.written_by), "host_fields": list(r.host_fields)} for r in rows},
        "layout_dependents": result.layout_dependents,
        "blind_spots": len(result.blind_spots),
        "notes": result.notes,
    }
