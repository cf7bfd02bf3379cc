"""The table query: what depends on a table, directly, through views, copies, calls, jobs and data sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.vendor import classified
from quarrylens.operators.jobs import deck_references

from .index import Index, StageTimer, split_spec

#: DD names of libraries and printed output, which carry no data from step to step.
_NO_DATA = ["STEPLIB", "JOBLIB", "JCLLIB", "SYSPRINT", "SYSOUT", "SYSUDUMP", "SYSTSPRT", "SYSIN", "SYSTSIN", "SYSPROC", "SYSEXEC"]
_STEP = ["path", "job", "step", "seq"]


def closure(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], max_rounds: int = 1000) -> DataFrame:
    """``start`` and all rows that ``step`` (the last round's rows, the round) reaches, one row per ``keys``.

    Every round starts from the last round's new rows only; a cycle ends by the anti join. Rounds are written to the
    shared folder, so lineage stays short. More than ``max_rounds`` rounds raise, they are never cut off.
    """
    found = frontier = written(start, "closure")
    for turn in range(1, max_rounds + 1):
        new = step(frontier, turn).join(found.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*start.columns)
        frontier = written(new, "frontier")
        if not frontier.limit(1).count():
            return found
        found = written(found.unionByName(frontier), "closure")
    raise RuntimeError(f"a closure did not end in {max_rounds} rounds")


def expanded_targets(index: Index, spec: str) -> DataFrame:
    """(schema, table, why) of the table, and of views and synonyms over it, views over those and so on."""
    schema, table = split_spec(spec)
    found = index.spark.createDataFrame([(schema, table, "the table itself")], "schema string, table string, why string")
    objects = index.objects.where(~F.col("why").startswith("in tablespace"))

    def over(frontier: DataFrame, _: int) -> DataFrame:
        base = frontier.select(F.col("schema").alias("s"), F.col("table").alias("t"))
        return objects.join(base, (objects.base_name == base.t) & ((objects.base_schema == base.s) | (objects.base_schema == "") | (base.s == ""))).select("schema", F.col("name").alias("table"), "why")

    return closure(found, over, ["schema", "table"])


def direct_references(index: Index, targets: DataFrame, spec: str) -> DataFrame:
    """Reference rows of the targets, and of the table space that holds the table."""
    schema, table = split_spec(spec)
    match = lambda rows, t: (rows["table_name"] == t["t"]) & ((rows["schema"] == t["s"]) | (rows["schema"] == "") | (t["s"] == ""))
    refs = index.table_refs
    plain, spaces = refs.where("via = ''"), refs.where("via = 'tablespace'")
    named = targets.select(F.col("schema").alias("s"), F.col("table").alias("t")).distinct()
    held = index.objects.where(F.col("why").startswith("in tablespace") & (F.col("name") == table) & ((F.col("schema") == schema) | (F.col("schema") == "") | F.lit(schema == "")))
    held = held.select(F.col("base_schema").alias("s"), F.col("base_name").alias("t")).distinct()
    hit = plain.join(named, match(plain, named)).drop("s", "t").unionByName(spaces.join(held, match(spaces, held)).drop("s", "t"))
    files = index.files.select("path", "member", F.col("kind").alias("file_kind"))
    return hit.dropDuplicates().join(files, "path").select("path", "unit", "stmt", "member", "line", "schema", F.col("table_name").alias("table"), "access", F.col("stmt_name").alias("what"), "via", "confidence", F.col("file_kind").alias("kind"))


def copy_fan_out(index: Index, members: DataFrame, hops: int = 3) -> DataFrame:
    """(path) of files that copy one of the members, directly or through up to ``hops`` copybooks."""
    copies = index.copy_refs.join(index.files.select("path", "member", "kind"), "path")
    found = None
    wanted = members.select(F.col("member").alias("copied")).distinct()
    for _ in range(hops):
        users = written(copies.join(wanted, "copied").select("path", "member", "kind").distinct(), "users")
        found = users if found is None else found.unionByName(users)
        wanted = users.where(F.col("kind").isin("COPYBOOK", "DCLGEN")).select(F.col("member").alias("copied")).distinct()
    return found.select("path").distinct()


def program_names(index: Index) -> DataFrame:
    """(path, name): a program's id, else the member name of a COBOL file without one."""
    ids = index.programs
    rest = index.files.where("kind = 'COBOL'").join(ids.select("path"), "path", "left_anti").select("path", F.col("member").alias("name"))
    return ids.unionByName(rest)


def call_closure(calls: DataFrame, start: DataFrame) -> DataFrame:
    """(name, depth) of the programs in ``start`` (name) and of all that call them, at their least distance.

    calls has caller and callee.
    """
    edges = calls.select("caller", "callee").distinct()

    def callers(frontier: DataFrame, depth: int) -> DataFrame:
        return edges.join(frontier.select(F.col("name").alias("callee")), "callee").select(F.col("caller").alias("name"), F.lit(depth).alias("depth"))

    return closure(start.select("name", F.lit(0).alias("depth")).distinct(), callers, ["name"])


def dependent_steps(index: Index, refs: DataFrame, programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, decks): steps that run a dependent program, hold a reference in their instream data, read a deck that
    holds one, or call a procedure with such a step, through any nesting of procedures."""
    steps = index.steps
    decks, _ = deck_references(index.dds, index.files)
    by_program = steps.join(programs.select(F.col("name").alias("resolved_pgm")).distinct(), "resolved_pgm", "left_semi")
    instream = refs.where(F.col("kind").isin("JCL", "PROC")).select("path", F.col("line").alias("at")).distinct()
    at = steps.select(*_STEP, F.col("line").alias("from_line")).join(instream, "path").where("from_line <= at")
    last = at.groupBy("path", "at").agg(F.max("seq").alias("seq")).select("path", "seq").distinct()
    by_stream = steps.join(last, ["path", "seq"], "left_semi")
    by_deck = steps.join(decks.join(refs.select(F.col("path").alias("deck_path")).distinct(), "deck_path", "left_semi").select("path", "seq").distinct(), ["path", "seq"], "left_semi")
    found = by_program.unionByName(by_stream).unionByName(by_deck).distinct()
    found = closure(found, lambda last, _: steps.where("proc <> ''").join(last.select(F.col("job").alias("proc")).distinct(), "proc", "left_semi").select(*steps.columns), ["path", "seq"])
    return found, decks


def data_links(index: Index, steps: DataFrame, decks: DataFrame, hops: int) -> DataFrame:
    """(job, step, dataset, via_job, hop, decks): steps that share a data set with a dependent step, then with those."""
    data = index.dds.where(~F.col("is_member") & ~F.col("dd").isin(*_NO_DATA) & ~F.col("dsn").startswith("&&")).select(*_STEP, F.col("base").alias("dataset")).distinct()
    data = written(data, "data")
    frontier = seen = written(steps.select(*_STEP), "seen")
    out = None
    via = F.struct(F.col("job").alias("v_job"), F.col("step").alias("v_step"))
    for hop in range(1, hops + 1):
        # of the frontier's steps at a data set, its least and the least of each job stand for all: a row names its
        # own job's if there is one, else the least; so a data set that many steps share costs a row a step
        held = data.join(frontier, _STEP, "left_semi")
        least = held.groupBy("dataset").agg(F.min(via).alias("any"))
        own = held.groupBy("dataset", "job").agg(F.min(via).alias("own"))
        near = data.join(seen, _STEP, "left_anti").join(least, "dataset").join(own, ["dataset", "job"], "left").withColumn("via", F.coalesce("own", "any"))
        near = written(near.select(*_STEP, "dataset", F.concat_ws("/", "via.v_job", "via.v_step").alias("via_job"), F.lit(hop).alias("hop")), "links")
        out = near if out is None else out.unionByName(near)
        frontier = near.select(*_STEP).distinct()
        seen = written(seen.unionByName(frontier), "seen")
    used = decks.groupBy("path", "seq").agg(F.sort_array(F.collect_set(F.struct("dd", "dsn", F.col("deck_kind").alias("kind"), F.col("deck_path").alias("path")))).alias("decks"))
    return out.join(used, ["path", "seq"], "left").select("job", "step", "dataset", "via_job", "hop", "decks")


def with_details(index: Index, steps: DataFrame, decks: DataFrame) -> DataFrame:
    """Steps with their decks (dd, dsn, kind, path) and data sets (dd, dsn, disp)."""
    used = decks.groupBy("path", "seq").agg(F.sort_array(F.collect_set(F.struct("dd", "dsn", F.col("deck_kind").alias("kind"), F.col("deck_path").alias("path")))).alias("decks"))
    data = index.dds.groupBy("path", "seq").agg(F.sort_array(F.collect_set(F.struct("dd", "dsn", "disp"))).alias("datasets"))
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    rows = steps.join(used, ["path", "seq"], "left").join(data, ["path", "seq"], "left")
    return rows.withColumn("decks", empty("decks", "array<struct<dd:string,dsn:string,kind:string,path:string>>")).withColumn("datasets", empty("datasets", "array<struct<dd:string,dsn:string,disp:string>>"))


def unresolved_calls(index: Index, programs: DataFrame, overrides: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(missing, vendor): calls of dependent programs whose target has no source, and vendor modules they call by label."""
    names = program_names(index)
    files = names.join(programs.select("name"), "name", "left_semi").select("path").distinct()
    made = classified(index.calls.join(files, "path", "left_semi"), "callee", overrides)
    known = names.select(F.col("name").alias("callee")).unionByName(index.files.select(F.col("member").alias("callee"))).distinct()
    missing = made.where("vendor is null").join(known, "callee", "left_anti").groupBy("callee").agg(F.min_by("path", F.struct("path", "line")).alias("path"), F.min_by("line", F.struct("path", "line")).alias("line"))
    vendor = made.where("vendor is not null").groupBy(F.col("vendor.label").alias("label")).agg(F.count("*").alias("calls"), F.sort_array(F.collect_set("callee")).alias("modules"))
    return missing.select("path", "line", F.lit("UNRESOLVED-CALL").alias("kind"), F.concat(F.lit("CALL "), "callee", F.lit(": no source in the index")).alias("detail")), vendor


@dataclass
class Result:
    """The answer to a table query. ``frames`` are DataFrames by name; the properties collect them as rows."""

    spec: str
    frames: dict[str, DataFrame]
    notes_frames: list[DataFrame] = field(default_factory=list)
    timings: list[dict] = field(default_factory=list)

    def _rows(self, name: str, *order: str) -> list:
        return self.frames[name].orderBy(*order).collect()

    @cached_property
    def refs(self) -> list:
        return [_Named(r) for r in self._rows("refs", "path", "line", "table", "what")]

    @cached_property
    def targets(self) -> list[tuple[str, str, str]]:
        return [(r.schema, r.table, r.why) for r in self._rows("targets", "why", "schema", "table")]

    @cached_property
    def programs(self) -> dict:
        return {r.name: r for r in self._rows("programs", "depth", "name")}

    @cached_property
    def steps(self) -> list:
        return self._rows("steps", "job", "path", "seq")

    @cached_property
    def jobs(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for s in self.steps:
            out.setdefault(s.job, []).append(s)
        return out

    @cached_property
    def data_links(self) -> list:
        return self._rows("data_links", "job", "step", "hop", "dataset") if "data_links" in self.frames else []

    @cached_property
    def blind_spots(self) -> list[tuple]:
        return [tuple(r) for r in self._rows("blind_spots", "path", "line", "kind", "detail")]

    @cached_property
    def notes(self) -> list[str]:
        return [r[0] for f in self.notes_frames for r in f.orderBy("note").collect()]


class _Named:
    """A reference row by attribute; ``stmt`` is the statement's name."""

    def __init__(self, row) -> None:
        self.__dict__.update(row.asDict())
        self.stmt_no, self.stmt = self.__dict__["stmt"], self.__dict__.pop("what")

    def __repr__(self) -> str:
        return f"{self.member}:{self.line} {self.stmt} {self.schema}.{self.table} {self.access}"


def table_dependencies(index: Index, spec: str, include_read: bool = True, data_hops: int = 1, overrides: list | None = None) -> Result:
    """Everything that depends on the table. ``include_read`` False leaves out reading references and what only they reach."""
    timer = StageTimer()
    with timer.stage("targets"):
        targets = expanded_targets(index, spec)
    with timer.stage("refs"):
        refs = direct_references(index, targets, spec)
        if not include_read:
            refs = refs.where("access <> 'READ'")
        refs = written(refs, "refs")
    with timer.stage("closure"):
        names = program_names(index)
        copied = copy_fan_out(index, refs.where(F.col("kind").isin("DCLGEN", "COPYBOOK")).select("member"))
        direct = refs.where(F.col("kind").isin("COBOL", "UNKNOWN")).select("path").unionByName(copied).distinct()
        start = names.join(direct, "path", "left_semi").select("name")
        calls = index.calls.join(names.withColumnRenamed("name", "caller"), "path").select("caller", "callee")
        programs = call_closure(calls, start)
    with timer.stage("jobs"):
        steps, decks = dependent_steps(index, refs, programs)
        decks = written(decks, "decks")
        detailed = written(with_details(index, steps, decks), "steps")
    frames = {"targets": targets, "refs": refs, "programs": programs, "steps": detailed}
    with timer.stage("data-trace"):
        if data_hops:
            frames["data_links"] = written(data_links(index, steps, decks, data_hops), "data_links")
    with timer.stage("unresolved-calls"):
        missing, vendor = (written(x, "calls") for x in unresolved_calls(index, programs, overrides))
    with timer.stage("blind-spots"):
        _, lost = deck_references(index.dds, index.files)
        reach = refs.select("path").unionByName(steps.select("path")).distinct()
        lost = lost.join(reach, "path", "left_semi").select("path", F.lit(0).alias("line"), F.lit("UNRESOLVED-DECK-REF").alias("kind"), "detail")
        own = index.blind_spots.join(refs.select("path").distinct(), "path", "left_semi").select("path", F.col("line").cast("int").alias("line"), "kind", "detail")
        frames["blind_spots"] = written(own.unionByName(lost).unionByName(missing.withColumn("line", F.col("line").cast("int"))).distinct(), "blind_spots")
    notes = vendor.select(F.concat(F.col("calls"), F.lit(" calls of "), "label", F.lit(" modules: "), F.array_join("modules", ", ")).alias("note"))
    return Result(spec, frames, [notes], timer.timings())


def table_summary(result: Result) -> dict:
    """Counts, and the members that write, programs and jobs, as plain data."""
    return {
        "table": result.spec,
        "references": result.frames["refs"].count(),
        "writers": [r.member for r in result.frames["refs"].where("access = 'WRITE'").select("member").distinct().orderBy("member").collect()],
        "programs": sorted(result.programs),
        "jobs": sorted(result.jobs),
        "blind_spots": len(result.blind_spots),
        "notes": result.notes,
    }


__all__ = ["Result", "table_dependencies", "table_summary"]
