"""Column definitions, COBOL data items, host bindings and copy references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import NOT_DEFINITIONS, newlines

_KEY = ["path", "unit", "stmt"]


def defined_columns(rows: DataFrame) -> DataFrame:
    """(path, table, name, seq, sql_type, nullable, origin, line) of CREATE and DECLARE TABLE lists and ALTER TABLE ADD.

    Items that start with a constraint word define nothing and take no number. A type is the item's text after its
    name, without the blanks inside it that the source's layout gives.
    """
    name = F.element_at(F.split("word", r"\."), -1)
    p1, p2 = F.coalesce("p1", F.lit("")), F.coalesce("p2", F.lit(""))
    heads = rows.where((F.col("kind") == "name") & (((F.col("verb") == "CREATE") & (p1 == "TABLE") & p2.isin("CREATE", "TEMPORARY")) | ((p1 == "DECLARE") & (F.col("n1") == "TABLE"))))
    heads = heads.select(*_KEY, name.alias("table"), F.when(p1 == "DECLARE", "DECLARE TABLE").otherwise("CREATE TABLE").alias("origin"), F.col("pos").alias("head"))
    opened = rows.where((F.col("tok") == "(") & (F.col("level") == 1)).join(heads, _KEY).where("pos > head").groupBy(*_KEY, "table", "origin").agg(F.min("grp").alias("list"))
    inside = rows.join(opened, _KEY).where((F.col("pos") > F.col("list")) & (F.col("level") >= 1))
    # a list that is never closed runs to the end of its statement
    last = rows.where((F.col("tok") == ")") & (F.col("level") == 1)).select(*_KEY, F.col("grp").alias("list"), F.col("pos").alias("end"))
    inside = inside.join(last, [*_KEY, "list"], "left").where("(end is null or pos < end) and tok <> ';'")
    item = Window.partitionBy(*_KEY, "list").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("item", F.sum(((F.col("tok") == ",") & (F.col("level") == 1)).cast("int")).over(item)).where(~((F.col("tok") == ",") & (F.col("level") == 1)))
    items = inside.groupBy(*_KEY, "table", "origin", "item").agg(_texts(), F.min_by(name, "pos").alias("name"), F.min_by("kind", "pos").alias("first_kind"), F.min("line").alias("line"))
    items = items.where((F.col("first_kind") == "name") & ~F.col("name").isin(*NOT_DEFINITIONS))
    number = Window.partitionBy(*_KEY, "table").orderBy("item")
    listed = items.select("path", "unit", "stmt", "table", "name", (F.row_number().over(number) - 1).alias("seq"), "sql_type", (~F.upper("sql_type").rlike(r"\bNOT NULL\b")).alias("nullable"), "origin", "line")

    added = rows.where((F.col("verb") == "ALTER") & (F.col("kw") == "ADD")).groupBy(*_KEY).agg(F.min("pos").alias("add"))
    altered = rows.where((F.col("verb") == "ALTER") & (F.col("kind") == "name") & (p1 == "TABLE")).select(*_KEY, name.alias("table"))
    rest = rows.join(added, _KEY).where((F.col("pos") > F.col("add")) & (F.coalesce("kw", F.lit("")) != "COLUMN") & (F.col("tok") != ";"))
    rest = rest.groupBy(*_KEY).agg(_texts(), F.min_by(name, "pos").alias("name"), F.min_by("kind", "pos").alias("first_kind"), F.min("line").alias("line")).join(altered, _KEY)
    rest = rest.where((F.col("first_kind") == "name") & ~F.col("name").isin(*NOT_DEFINITIONS))
    more = rest.select("path", "unit", "stmt", "table", "name", F.lit(0).alias("seq"), "sql_type", (~F.upper("sql_type").rlike(r"\bNOT NULL\b")).alias("nullable"), F.lit("ALTER TABLE").alias("origin"), "line")
    return listed.unionByName(more)


def _texts() -> Column:
    """The text of an item's tokens but the first, as sql_type."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("blank"), F.concat(F.lit(" "), "tok")).otherwise(F.col("tok")).alias("t"))))
    joined = F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: x["t"]), "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s*([(),])\s*", "$1"), r"\)(?=\w)", ") ")).alias("sql_type")


def known_columns(columns: DataFrame, files: DataFrame) -> DataFrame:
    """One definition per table: CREATE before DECLARE, SQL files before others, then by path; ALTER ADD after it."""
    rows = columns.join(files.select("path", "member", "kind"), "path")
    rank = F.struct((F.col("origin") != "CREATE TABLE").alias("a"), (F.col("kind") != "SQL").alias("b"), F.col("path").alias("c"), F.col("unit").alias("d"), F.col("stmt").alias("e"))
    listed = rows.where("origin <> 'ALTER TABLE'").withColumn("rank", rank)
    best = listed.groupBy("table").agg(F.min("rank").alias("rank"))
    chosen = listed.join(best, ["table", "rank"]).drop("rank")
    size = chosen.groupBy("table").agg((F.max("seq") + 1).alias("n"))
    later = Window.partitionBy("table").orderBy("path", "unit", "stmt", "name")
    more = rows.where("origin = 'ALTER TABLE'").join(chosen.select("table", "name"), ["table", "name"], "left_anti").dropDuplicates(["table", "name"])
    more = more.join(size, "table", "left").withColumn("seq", (F.coalesce("n", F.lit(0)) + F.row_number().over(later) - 1).cast("int")).drop("n")
    return chosen.unionByName(more).select("table", "name", F.col("seq").cast("int").alias("seq"), "sql_type", "nullable", "origin", "member", "path", "line")


def data_items(blobs: DataFrame) -> DataFrame:
    """(path, item, level, name, pic, line) of COBOL data items before the PROCEDURE DIVISION.

    Levels 1 to 49 and 77; FILLER is left out. pic is the picture with its usage, empty for groups. An item ends
    at its full stop, so a picture on a later line counts.
    """
    data = F.element_at(F.split("blob", r"(?i)\bPROCEDURE\s+DIVISION\b"), 1)
    # sentences: up to a full stop that ends a word, as decimal points in pictures do not
    parts = blobs.select("path", "origin", F.posexplode(F.split(data, r"\.(?=\s|\z)")).alias("item", "text"))
    run = Window.partitionBy("path").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    breaks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    parts = parts.withColumn("before", F.coalesce(F.sum(breaks(F.col("text"))).over(run), F.lit(0)))
    found = r"(?is)^\s*(\d{1,2})\s+([A-Z0-9][A-Z0-9-]*)(.*)$"
    level = F.regexp_extract("text", found, 1)
    at = F.col("before") + breaks(F.regexp_extract("text", r"(?s)^(\s*)", 1)) + 1
    rest = F.regexp_extract("text", found, 3)
    pic = F.regexp_extract(rest, r"(?is)\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", 1)
    usage = F.regexp_extract(rest, r"(?i)\b(COMP(?:UTATIONAL)?(?:-[0-9])?|BINARY|PACKED-DECIMAL|DISPLAY|POINTER|INDEX)\b", 1)
    rows = parts.where(level != "").select("path", "item", level.cast("int").alias("level"), F.upper(F.regexp_extract("text", found, 2)).alias("name"), F.upper(F.trim(F.concat_ws(" ", F.when(pic != "", pic), F.when(usage != "", usage)))).alias("pic"), F.try_element_at("origin", at.cast("int")).alias("line"))
    return rows.where("level between 1 and 77 and level <> 66 and name <> 'FILLER'")


def host_bindings(items: DataFrame, columns: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings, unbound): fields of a DCLGEN paired with the columns it declares, by name, else by position.

    Fields are those at the lowest level between 2 and 48. A group's picture is that of its -TEXT child, else of
    its first child with one.
    """
    dcl = files.where("kind = 'DCLGEN'").select("path", "member")
    rows = items.join(dcl, "path")
    top = rows.where("level between 2 and 48").groupBy("path").agg(F.min("level").alias("top"))
    rows = rows.join(top, "path")
    order = Window.partitionBy("path").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("field", F.last(F.when(F.col("level") == F.col("top"), F.col("item")), ignorenulls=True).over(order))
    child = rows.where((F.col("level") > F.col("top")) & (F.col("pic") != "")).groupBy("path", "field").agg(F.min_by("pic", F.struct(~F.col("name").endswith("-TEXT"), "item")).alias("child_pic"))
    fields = rows.where(F.col("level") == F.col("top")).join(child, ["path", "field"], "left")
    number = Window.partitionBy("path").orderBy("item")
    fields = fields.select("path", "member", F.col("name").alias("host_field"), F.coalesce(F.when(F.col("pic") != "", F.col("pic")), "child_pic", F.lit("")).alias("pic"), "line", (F.row_number().over(number) - 1).alias("at"))
    declared = columns.where("origin = 'DECLARE TABLE'").select("path", "table", F.col("name").alias("column"), "seq", F.col("line").alias("column_line")).join(dcl.select("path"), "path", "left_semi")
    by_name = fields.select("path", F.replace("host_field", F.lit("-"), F.lit("_")).alias("column"), F.struct("member", "host_field", "pic", "line").alias("named"))
    by_place = fields.select("path", F.col("at").alias("seq"), F.struct("member", "host_field", "pic", "line").alias("placed"))
    paired = declared.join(by_name, ["path", "column"], "left").join(by_place, ["path", "seq"], "left").withColumn("hit", F.coalesce("named", "placed"))
    bindings = paired.where("hit is not null").select("column", "hit.host_field", "hit.pic", "hit.member", "path", "hit.line", "table").dropDuplicates(["path", "table", "column"])
    unbound = paired.where("hit is null").select("path", F.col("column_line").alias("line"), F.lit("UNBOUND-COLUMN").alias("kind"), F.concat_ws(".", "table", "column").alias("detail"))
    return bindings, unbound


def copy_references(blobs: DataFrame) -> DataFrame:
    """(path, copied, seq): COPY and EXEC SQL INCLUDE of members."""
    found = F.regexp_extract_all("blob", F.lit(r"(?i)(?:\bCOPY|\bEXEC\s+SQL\s+INCLUDE)\s+'?([A-Z@#$][A-Z0-9@#$-]*)"), F.lit(1))
    return blobs.select("path", F.posexplode(found).alias("seq", "copied")).select("path", F.upper("copied").alias("copied"), "seq").where("copied not in ('SQLCA', 'SQLDA')")


def programs(blobs: DataFrame) -> DataFrame:
    """(path, name) of every PROGRAM-ID."""
    found = F.regexp_extract_all("blob", F.lit(r"(?i)\bPROGRAM-ID\s*\.?\s+'?([A-Z0-9@#$-]+)"), F.lit(1))
    return blobs.select("path", F.explode(F.array_distinct(F.transform(found, lambda x: F.upper(x)))).alias("name"))


def calls(blobs: DataFrame) -> DataFrame:
    """(path, callee, line) of static calls, one row for each call."""
    parts = blobs.select("path", "origin", F.posexplode(F.split("blob", "\n", -1)).alias("at", "code"))
    found = F.explode(F.regexp_extract_all("code", F.lit(r"(?i)(?<![A-Z0-9-])CALL\s+['\"]([A-Z0-9@#$]+)['\"]"), F.lit(1)))
    return parts.select("path", found.alias("callee"), F.try_element_at("origin", F.col("at") + 1).alias("line")).select("path", F.upper("callee").alias("callee"), "line")


#: Literal, word, line feed, blanks, anything else.
_COBOL_TOKEN = r"(?s)('[^']*+(?:''[^']*+)*+'?|[A-Za-z0-9][A-Za-z0-9-]*|\n|[^\S\n]+|.)"
_PARTS = "array<struct<lit:string,name:string,delimiter:string>>"
#: Words that begin a statement, as far as they can follow one that moves text.
_VERBS = ["MOVE", "STRING", "UNSTRING", "EXEC", "END-EXEC", "END-STRING", "DISPLAY", "CALL", "IF", "ELSE", "END-IF", "EVALUATE", "WHEN", "PERFORM", "ADD", "SUBTRACT", "COMPUTE", "INITIALIZE", "INSPECT", "ACCEPT", "READ", "WRITE", "SET", "GO", "STOP", "GOBACK", "EXIT", "CONTINUE"]


def assignments(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, prepared) of programs that prepare or execute statements, in the order of their text.

    assigned: path, nth, target, parts (array of struct(lit, name, delimiter)), first (logical line), of MOVE, STRING and
    VALUE. What other statements put into a field is not known: they give a row with null parts. prepared: path, nth, host.
    """
    rows = blobs.where(F.col("blob").rlike(r"(?i)\bEXEC\s+SQL\s+(?:PREPARE|EXECUTE)\b"))
    toks = rows.select("path", F.posexplode(F.regexp_extract_all("blob", F.lit(_COBOL_TOKEN), F.lit(1))).alias("pos", "tok"))
    order = Window.partitionBy("path").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    toks = toks.withColumn("line", 1 + F.coalesce(F.sum(newlines(F.col("tok"))).over(so_far), F.lit(0))).where(F.trim(F.regexp_replace("tok", r"\s", "")) != "")
    kw = F.when(~F.col("tok").startswith("'"), F.upper("tok"))
    toks = toks.withColumn("kw", kw)
    starts = F.col("kw").isin(*_VERBS) | (F.col("tok") == ".")
    toks = toks.withColumn("nth", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = F.filter(F.array_sort(F.collect_list(F.struct("pos", "tok", "kw"))), lambda x: x["tok"] != ".")
    stmts = toks.groupBy("path", "nth").agg(t.alias("t"), F.min(F.when(F.col("tok") != ".", F.col("line"))).alias("first")).where(F.size("t") > 1)
    words = F.transform("t", lambda x: F.coalesce(x["kw"], F.lit("'")))
    stmts = stmts.withColumn("w", words).withColumn("verb", F.get("w", 0))
    at = lambda word: F.array_position("w", word)
    literal = lambda x: F.when(x["kw"].isNull(), F.replace(F.substring(x["tok"], F.lit(2), F.char_length(x["tok"]) - 2), F.lit("''"), F.lit("'")))
    part = lambda x, d: F.struct(literal(x).alias("lit"), x["kw"].alias("name"), d.cast("string").alias("delimiter"))
    none = F.lit(None)
    moved = stmts.where((F.col("verb") == "MOVE") & (at("TO") > 0))
    source = F.slice("t", F.lit(2), at("TO").cast("int") - 2)
    # MOVE a TO b c: an operand of several words (a function, a subscript) is not known
    moved = moved.select("path", "nth", "first", F.explode(F.slice("w", at("TO").cast("int") + 1, F.size("w"))).alias("target"), F.when(F.size(source) == 1, F.transform(source, lambda x: part(x, none))).alias("parts"))
    strung = stmts.where((F.col("verb") == "STRING") & (at("INTO") > 0))
    body = F.slice("t", F.lit(2), at("INTO").cast("int") - 2)
    limits = F.filter(F.transform(body, lambda x, i: F.struct(i.alias("i"), x["kw"].alias("kw"), F.get(body, i + 1 + (F.get(body, i + 1)["kw"].eqNullSafe("BY")).cast("int"))["kw"].alias("by"))), lambda x: x["kw"] == "DELIMITED")
    operand = lambda x, i: ~F.coalesce(x["kw"].isin("DELIMITED", "BY", ","), F.lit(False)) & ~F.exists(limits, lambda d: (i == d["i"] + 1) | ((i == d["i"] + 2) & (F.get(body, d["i"] + 1)["kw"].eqNullSafe("BY"))))
    listed = F.filter(F.transform(body, lambda x, i: F.when(operand(x, i), part(x, F.get(F.filter(limits, lambda d: d["i"] > i), 0)["by"]))), lambda x: x.isNotNull())
    strung = strung.select("path", "nth", "first", F.get("w", at("INTO").cast("int")).alias("target"), listed.alias("parts"))
    valued = stmts.where(F.col("verb").rlike(r"^\d{1,2}$") | (F.get("w", 0) == ".")).where(at("VALUE") > 0)
    after = at("VALUE").cast("int") + (F.get("w", at("VALUE").cast("int")).eqNullSafe("IS")).cast("int")
    valued = valued.select("path", "nth", "first", F.get("w", 1).alias("target"), F.transform(F.slice("t", after + 1, F.lit(1)), lambda x: part(x, none)).alias("parts"))
    other = stmts.where(F.col("verb").isin("ACCEPT", "INITIALIZE", "UNSTRING", "READ", "INSPECT", "COMPUTE", "SET")).select("path", "nth", "first", F.explode("w").alias("target")).withColumn("parts", F.lit(None))
    # statements fetch into fields as well
    fetched = stmts.where((F.col("verb") == "EXEC") & (at("INTO") > 0)).select("path", "nth", "first", F.explode(F.slice("w", at("INTO").cast("int") + 1, F.size("w"))).alias("target")).withColumn("parts", F.lit(None))
    name = F.col("target").rlike("^[A-Z0-9][A-Z0-9-]*$")
    assigned = reduce(DataFrame.union, [x.select("path", "nth", "target", F.col("parts").cast(_PARTS).alias("parts"), "first") for x in (moved, strung, valued, other, fetched)]).where(name)
    host = F.when(at("PREPARE") > 0, F.get("w", at("FROM").cast("int") + 1)).when(at("IMMEDIATE") > 0, F.get("w", at("IMMEDIATE").cast("int") + 1))
    prepared = stmts.where(F.col("verb") == "EXEC").select("path", "nth", host.alias("host")).where("host is not null")
    return assigned.dropDuplicates(["path", "nth", "target"]), prepared


def assembled_units(blobs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Units like embedded_sql's of statements that programs put together from constants and prepare.

    Constants are followed through MOVE, STRING and VALUE in the order of the text, from fields to fields, as long as more
    become known; a field that anything else may have changed is not known. Statements of one literal on one line are left
    to ``dynamic_units``. More than ``max_rounds`` rounds raise, they are never cut off.
    """
    assigned, prepared = assignments(blobs)
    assigned, prepared = written(assigned, "assigned"), written(prepared, "prepared")
    cut = lambda text, by: F.when(by.isin("SPACE", "SPACES"), F.regexp_extract(text, "^([^ ]*)", 1)).otherwise(text)
    asked = assigned.where("parts is not null").select("path", "nth", "target", "first", F.posexplode("parts").alias("k", "p"))
    fixed = asked.where("p.lit is not null").select("path", "nth", "target", "k", cut(F.col("p.lit"), F.col("p.delimiter")).alias("text"), F.lit(1).alias("n"))
    named = asked.where("p.lit is null").select("path", "nth", "target", "k", F.col("p.name").alias("name"), F.col("p.delimiter").alias("by"))
    size = assigned.select("path", "nth", "target", "first", F.size("parts").alias("size"))
    known = written(_whole(fixed, size), "constants")
    before = known.count()
    for _ in range(max_rounds):
        filled = _as_of(named.withColumnRenamed("name", "field"), assigned, known)
        more = filled.where("text is not null").select("path", "nth", "target", "k", cut(F.col("text"), F.col("by")).alias("text"), "n")
        known = written(_whole(fixed.unionByName(more), size), "constants")
        after = known.count()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"constants did not settle in {max_rounds} rounds")
    found = _as_of(prepared.withColumnRenamed("host", "field"), assigned, known).where("text is not null")
    found = found.where((F.col("n") > 1) | F.col("text").contains("\n")).where(F.col("text").rlike(r"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|MERGE)\b"))
    return found.join(blobs.select("path", "origin"), "path").select("path", (F.lit(-1_000_000_000) - F.col("nth")).cast("int").alias("unit"), F.col("first").cast("int").alias("first"), "origin", "text")


def _whole(parts: DataFrame, size: DataFrame) -> DataFrame:
    """(path, nth, target, text, n, first) of assignments all of whose parts are known; n counts the literals they come from."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("path", "nth", "target").agg(text.alias("text"), F.count("*").alias("found"), F.sum("n").cast("int").alias("n")).join(size, ["path", "nth", "target"]).where("found = size").select("path", "nth", "target", "text", "n", "first")


def _as_of(asked: DataFrame, assigned: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` (path, nth, field, ...) with text, n and first of the field's last assignment before; null text if it is not known."""
    told = assigned.select("path", "nth", "target").join(known, ["path", "nth", "target"], "left").select("path", "nth", F.col("target").alias("field"), F.struct("text", "n", "first").alias("told"))
    both = asked.withColumn("told", F.lit(None).cast(told.schema["told"].dataType)).withColumn("asks", F.lit(True)).unionByName(told.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("path", "field").orderBy("nth", F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("told", ignorenulls=True).over(order)).where("asks").select(*asked.columns, "last.text", "last.n", "last.first")


def dynamic_units(blobs: DataFrame) -> DataFrame:
    """Units like embedded_sql's of SQL in literals of programs that prepare or execute statements."""
    rows = blobs.where(F.col("blob").rlike(r"(?i)\bEXEC\s+SQL\s+(?:PREPARE|EXECUTE)\b"))
    literal = r"('(?i:SELECT|INSERT|UPDATE|DELETE|MERGE)\b(?:[^']|'')*')"
    parts = rows.select("path", "origin", F.posexplode(F.split("blob", "\n", -1)).alias("at", "code"))
    found = parts.select("path", "origin", "at", F.posexplode(F.regexp_extract_all("code", F.lit(literal), F.lit(1))).alias("k", "lit"))
    return found.select("path", (F.lit(-1) - F.col("at") * 16 - F.col("k")).cast("int").alias("unit"), (F.col("at") + 1).alias("first"), "origin", F.replace(F.expr("substring(lit, 2, char_length(lit) - 2)"), F.lit("''"), F.lit("'")).alias("text"))
