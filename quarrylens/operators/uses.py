"""Column uses: which statement reads or writes which column, and through which host variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import NOT_COLUMNS

from .references import table_tokens

_KEY = ["path", "unit", "stmt"]
_BLOCK = [*_KEY, "owner", "own_branch"]
_OPS = ["=", "<>", "!=", "<", ">", "<=", ">=", "IN", "LIKE", "BETWEEN", "IS"]
_OUT = [*_KEY, "pos", "line", "column", "table", "access", "context", "label", "host_var"]


def labels(rows: DataFrame) -> DataFrame:
    """(key, label): the statement's name in uses: its verb, or DECLARE CURSOR, CREATE VIEW, CREATE INDEX, LOAD INTO TABLE ..."""
    has = lambda *words: F.bool_or(F.coalesce(F.col("kw").isin(*words), F.lit(False)))
    found = rows.groupBy(*_KEY).agg(F.first("verb").alias("verb"), has("CURSOR").alias("cursor"), has("VIEW").alias("view"), has("INDEX").alias("index"), has("SELECT").alias("select"), F.min_by("kw", F.when(F.col("kw").isin("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"), F.col("pos"))).alias("dml"))
    label = (
        F.when((F.col("verb") == "DECLARE") & F.col("cursor"), "DECLARE CURSOR")
        .when((F.col("verb") == "CREATE") & F.col("view"), "CREATE VIEW")
        .when((F.col("verb") == "CREATE") & F.col("index"), "CREATE INDEX")
        .when(F.col("verb") == "LOAD", "LOAD INTO TABLE")
        .when(F.col("verb") == "UNLOAD", "UNLOAD FROM TABLE")
        .when(F.col("verb").isin("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "FETCH"), F.col("verb"))
        .otherwise(F.coalesce("dml", "verb"))
    )
    return found.select(*_KEY, label.alias("label"))


def block_tables(rows: DataFrame) -> DataFrame:
    """(block, alias, table, first, tables): the tables of each query block by alias and by name."""
    # an INSERT's own table is known from its list; the columns of its SELECT belong to the SELECT's tables
    found = table_tokens(rows).where(F.col("access").isin("READ", "WRITE") & (F.col("what") != "INSERT"))
    # the statement's target is seen from every block of the statement's own level
    counted = found.groupBy(*_BLOCK).agg(F.countDistinct("table").alias("tables"), F.min_by("table", "pos").alias("first"))
    opaque = rows.where((F.col("tok") == "(") & (F.col("p1").isin("FROM", "JOIN", ",", "USING")) & (F.col("n1") == "SELECT")).groupBy(*_KEY).agg(F.lit(True).alias("derived"))
    counted = counted.join(opaque, _KEY, "left").withColumn("multi", (F.col("tables") > 1) | F.coalesce("derived", F.lit(False)))
    by_name = found.select(*_BLOCK, F.col("table").alias("alias"), "table")
    by_alias = found.where("alias is not null").select(*_BLOCK, "alias", "table")
    names = by_alias.unionByName(by_name).dropDuplicates([*_BLOCK, "alias"])
    return names.join(counted.select(*_BLOCK, "first", "multi"), _BLOCK)


def _qualified(rows: DataFrame, names: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, pos, by_alias) of qualified names: the table of the nearest block around, its own first, that has the qualifier.

    A block reaches from its first token to the next branch of its UNION or to its closing parenthesis; the statement's
    own to the end.
    """
    branches = Window.partitionBy(*_KEY, "owner").orderBy("own_branch")
    extent = rows.groupBy(*_BLOCK).agg(F.min("pos").alias("low"), F.max("pos").alias("last"))
    extent = extent.withColumn("high", F.coalesce(F.lead("low").over(branches) - 1, F.when(F.col("owner") >= 0, F.col("last"))))
    around = tables.select(*_BLOCK, F.col("alias").alias("qualifier"), F.col("table").alias("of")).join(extent, _BLOCK)
    found = names.where("qualifier <> ''").select(*_KEY, "pos", "qualifier").join(around, [*_KEY, "qualifier"])
    found = found.where((F.col("low") <= F.col("pos")) & (F.col("high").isNull() | (F.col("pos") <= F.col("high"))))
    return found.groupBy(*_KEY, "pos").agg(F.max_by("of", "owner").alias("by_alias"))


def column_tokens(rows: DataFrame, known: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, ambiguous): name tokens that can be columns, with the table each belongs to.

    A qualified name belongs to the table of its correlation name, in its own block or in the nearest one around it
    that has the name; a plain one to the block's only table, or to the one table of the block that defines it. ``defined`` tells whether a definition has the column, ``open`` whether
    the table has no definition at all.
    """
    parts = F.split("word", r"\.")
    qualifier, name = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.element_at(parts, -1)
    n1, p1 = F.coalesce("n1", F.lit("")), F.coalesce("p1", F.lit(""))
    clause = F.col("own_clause")
    can = rows.where((F.col("kind") == "name") & clause.isin("SELECT", "WHERE", "ON", "SET", "GROUP", "ORDER", "HAVING", "VALUES", "WHEN") & (n1 != "(") & (p1 != "AS"))
    can = can.withColumn("qualifier", qualifier).withColumn("name", name).where(~((F.col("qualifier") == "") & F.col("name").isin(*NOT_COLUMNS, "FULL", "TRUE", "FALSE", "UNKNOWN", "COLUMN")))
    # an alias without AS follows its expression: a name after a name or a closing parenthesis in a select list
    can = can.where(~((clause == "SELECT") & (p1.rlike(r"^[A-Z@#$][A-Z0-9@#$_]*$") & ~p1.isin(*NOT_COLUMNS) | (p1 == ")"))))
    bound = can.join(_qualified(rows, can, tables), [*_KEY, "pos"], "left")
    only = tables.select(*_BLOCK, "first", "multi").distinct()
    bound = bound.join(only, _BLOCK, "left")
    owners = tables.select(*_BLOCK, "table").distinct().join(known.select("table", "name"), "table")
    owners = owners.groupBy(*_BLOCK, "name").agg(F.min("table").alias("by_definition"), F.countDistinct("table").alias("holders"))
    bound = bound.join(owners, [*_BLOCK, "name"], "left")
    table = F.when(F.col("qualifier") != "", F.col("by_alias")).when(~F.col("multi"), F.col("first")).when(F.col("holders") == 1, F.col("by_definition"))
    bound = bound.withColumn("table", table)
    named = known.groupBy("table").agg(F.lit(True).alias("has_definition"))
    bound = bound.join(named, "table", "left").join(known.select("table", "name", F.lit(True).alias("defined")), ["table", "name"], "left")
    bound = bound.withColumn("defined", F.coalesce("defined", F.lit(False))).withColumn("open", ~F.coalesce("has_definition", F.lit(False)))
    vague = bound.where((F.col("qualifier") == "") & F.col("multi") & F.col("table").isNull() & clause.isin("SELECT", "WHERE", "ON", "GROUP", "ORDER"))
    ambiguous = vague.select(*_KEY, "line", F.lit("AMBIGUOUS-COLUMN").alias("kind"), F.col("name").alias("detail"))
    return bound.where("table is not null"), ambiguous


def _use(rows: DataFrame, access: str, context: Column | str, host: Column | str = "") -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(*_KEY, "pos", "line", F.col("name").alias("column"), "table", F.lit(access).alias("access"), as_column(context).alias("context"), as_column(host).alias("host_var"))


def select_items(rows: DataFrame, columns: DataFrame, known: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, stars): bare items of select lists with their ordinals, stars expanded; and stars no definition expands."""
    lists = rows.where((F.col("own_clause") == "SELECT") & (F.coalesce("kw", F.lit("")) != "SELECT") & ~F.coalesce(F.col("kw").isin("DISTINCT", "ALL"), F.lit(False)) & (F.col("tok") != ","))
    lists = lists.where(~((F.col("grp") == F.col("owner")) & F.col("tok").isin("(", ")")))
    slot = [*_BLOCK, "own_part", "own_slot"]
    shape = lists.groupBy(*slot).agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"), F.min_by("tok", "pos").alias("tok"), F.min_by("word", "pos").alias("word"), F.min_by("line", "pos").alias("line"), F.min_by("n1", "pos").alias("after"))
    star = (F.col("kind") == "star") | ((F.col("tok") == "*") & (F.col("n") == 1))
    bare = (F.col("kind") == "name") & ((F.col("n") == 1) | ((F.col("n") == 3) & (F.col("after") == "AS")) | ((F.col("n") == 2) & (F.col("after") != "(")))
    shape = shape.withColumn("star", star).withColumn("bare", bare & ~star)
    q = F.when(F.col("kind") == "star", F.element_at(F.split("word", r"\."), -1))
    stars = shape.where("star").withColumn("alias", q)
    with_alias = stars.where("alias is not null").join(tables.select(*_BLOCK, "alias", "table"), [*_BLOCK, "alias"])
    every = stars.where("alias is null").drop("alias").join(tables.select(*_BLOCK, "table").distinct(), _BLOCK)
    of = with_alias.select(*slot, "pos", "line", "table").unionByName(every.select(*slot, "pos", "line", "table"))
    wide = of.join(known.select("table", "name", "seq"), "table", "left")
    blind = wide.where("name is null").select(*_KEY, "line", F.lit("SELECT-STAR").alias("kind"), F.col("table").alias("detail")).distinct()
    wide = wide.where("name is not null")
    widths = wide.groupBy(*slot).agg(F.count("*").alias("w"))
    order = Window.partitionBy(*_BLOCK).orderBy("own_part", "own_slot").rowsBetween(Window.unboundedPreceding, -1)
    sized = shape.join(widths, slot, "left").withColumn("base", F.coalesce(F.sum(F.when(F.col("star"), F.coalesce("w", F.lit(1))).otherwise(1)).over(order), F.lit(0)))
    place = Window.partitionBy(*slot).orderBy("table", "seq")
    from_stars = wide.join(sized.select(*slot, "base"), slot).withColumn("ordinal", F.col("base") + F.row_number().over(place) - 1).select(*_BLOCK, "pos", "line", "name", "table", "ordinal")
    named = columns.where("own_clause = 'SELECT'").select(*_KEY, "pos", "name", "table")
    plain = sized.where("bare").join(named, [*_KEY, "pos"]).select(*_BLOCK, "pos", "line", "name", "table", F.col("base").alias("ordinal"))
    return plain.unionByName(from_stars), blind


def column_uses(rows: DataFrame, known: DataFrame, contexts: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uses, blind spots, notes) of structured and placed tokens, given the known columns.

    ``contexts`` leaves out uses in others, and the work for them.
    """
    wanted = lambda *names: contexts is None or not set(names).isdisjoint(contexts)
    tables = written(block_tables(rows), "block_tables")
    columns, ambiguous = column_tokens(rows, known, tables)
    # read by many branches below: written, so that each is worked out once and plans stay small. Targets take a sort of all
    # tokens, ambiguous names the joins of columns once more: neither is worked out for contexts that do not read it
    columns, targets = written(columns, "columns"), _targets(rows)
    ambiguous = written(ambiguous, "ambiguous") if contexts is None else ambiguous
    targets = written(targets, "targets") if wanted("SET", "SET-EXPR", "INSERT", "INDEX", "LOAD", "UNLOAD") else targets
    p1, n1, n2 = (F.coalesce(c, F.lit("")) for c in ("p1", "n1", "n2"))
    strict = F.col("defined") | (F.col("qualifier") != "")
    hosts = rows.where("kind = 'host'")
    host_of = lambda rel, c: rel.select(*_KEY, F.col("pos").alias(c), F.col("word").alias("host"))
    out: list[DataFrame] = []

    # select lists, INTO and expressions
    items, blind = select_items(rows, columns, known, tables)
    items = written(items, "items") if wanted("SELECT", "FETCH") else items
    into = hosts.where((F.col("clause") == "INTO") & (F.col("verb") != "FETCH") & (F.col("p1").isin("INTO", ","))).select(*_KEY, F.col("grp").alias("owner"), F.col("slot").alias("ordinal"), F.col("word").alias("host"))
    paired = items.join(into.dropDuplicates([*_KEY, "owner", "ordinal"]), [*_KEY, "owner", "ordinal"], "left")
    if wanted("SELECT"):
        out.append(_use(paired, "READ", "SELECT", F.coalesce("host", F.lit(""))))
    rest = columns.where("own_clause = 'SELECT'").where(strict).join(items.select(*_KEY, "pos"), [*_KEY, "pos"], "left_anti")
    if wanted("SELECT"):
        out.append(_use(rest, "READ", "SELECT"))

    # predicates: a column before an operator with the host variables after it, and columns after one
    filters = columns.where(F.col("own_clause").isin("WHERE", "ON", "HAVING") | ((F.col("own_clause") == "WHEN") & (F.col("verb") == "MERGE")))
    context = F.when(F.col("own_clause").isin("ON", "HAVING"), F.col("own_clause")).otherwise("WHERE")
    # before an operator a plain name of a block with one table is its column, whether a definition has it or not
    left = filters.where(n1.isin(*_OPS) | ((n1 == "NOT") & n2.isin("IN", "LIKE", "BETWEEN")))
    pairs = left.withColumn("op", F.when(n1 == "NOT", n2).otherwise(n1))
    follow = Window.partitionBy(*_KEY).orderBy("pos")
    near = rows.select(*_KEY, "pos", *[F.when(F.lead("kind", i).over(follow) == "host", F.lead("word", i).over(follow)).alias(f"h{i}") for i in (2, 3, 4, 5)], *[F.lead("pos", i).over(follow).alias(f"g{i}") for i in (2, 3)])
    near = pairs.join(near, [*_KEY, "pos"]).withColumn("shift", (n1 == "NOT").cast("int"))
    within = hosts.groupBy(*_KEY, F.col("grp").alias("list")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("listed"))
    near = near.withColumn("list", F.when(F.col("op") == "IN", F.when(F.col("shift") == 1, F.col("g3")).otherwise(F.col("g2")))).join(within, [*_KEY, "list"], "left")
    at = lambda i: F.when(F.col("shift") == 1, F.col(f"h{i + 1}")).otherwise(F.col(f"h{i}"))
    values = F.when(F.col("op") == "BETWEEN", F.array_compact(F.array(at(2), at(4)))).when(F.col("op") == "IN", F.coalesce("listed", F.array().cast("array<string>"))).otherwise(F.array_compact(F.array(at(2))))
    near = near.withColumn("hosts", F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(""))))
    if wanted("WHERE", "ON", "HAVING"):
        out.append(_use(near.withColumn("host", F.explode("hosts")), "READ", context, F.col("host")))
    # after an operator a plain name may be a parameter of a routine: a column only if a definition has it
    right = filters.where(p1.isin("=", "<>", "!=", "<", ">", "<=", ">=", "LIKE", "BETWEEN") & ~n1.isin(*_OPS) & strict)
    if wanted("WHERE", "ON", "HAVING"):
        out.append(_use(right, "READ", context))

    # SET: the first name of an entry is written with the entry's first host variable; other columns are read
    sets = rows.where((F.col("own_clause") == "SET"))
    slot = [*_KEY, "owner", "own_part", "own_slot"]
    heads = sets.where((F.col("kind") == "name") & (F.coalesce("kw", F.lit("")) != "SET") & (p1.isin("SET", ",")) & (n1 == "="))
    target = rows.join(targets, _KEY)
    first_host = hosts.where("own_clause = 'SET'").groupBy(*slot).agg(F.min_by("word", "pos").alias("host"))
    assigned = heads.join(targets, _KEY).join(first_host, slot, "left").withColumn("name", F.element_at(F.split("word", r"\."), -1)).withColumn("table", F.col("target"))
    if wanted("SET"):
        out.append(_use(assigned, "WRITE", "SET", F.coalesce("host", F.lit(""))))
    # SET (a, b) = (x, y): names and values are paired by place
    opens = sets.where((F.col("tok") == "(") & (F.col("level") == 1))
    lists = sets.where((F.col("tok") == ")") & (F.col("level") == 1) & (n1 == "=")).select(*_KEY, "grp").join(opens.where(p1.isin("SET", ",")).select(*slot, "grp"), [*_KEY, "grp"])
    parts = opens.where((p1 == "=") & (F.coalesce("p2", F.lit("")) == ")")).select(*slot, F.col("grp").alias("values"))
    told = hosts.groupBy(*_KEY, F.col("grp").alias("values"), "slot").agg(F.min_by("word", "pos").alias("host"))
    named = sets.where((F.col("kind") == "name") & p1.isin("(", ",")).join(lists.select(*_KEY, "grp", F.col("own_slot").alias("entry")), [*_KEY, "grp"])
    named = named.join(parts.select(*slot, "values"), slot, "left").join(told, [*_KEY, "values", "slot"], "left").join(targets, _KEY)
    named = named.withColumn("name", F.element_at(F.split("word", r"\."), -1)).withColumn("table", F.col("target"))
    if wanted("SET"):
        out.append(_use(named, "WRITE", "SET", F.coalesce("host", F.lit(""))))
    heads = heads.select(*_KEY, "pos").unionByName(named.select(*_KEY, "pos"))
    read = columns.where("own_clause = 'SET'").where(strict).join(heads, [*_KEY, "pos"], "left_anti")
    if wanted("SET-EXPR"):
        out.append(_use(read, "READ", "SET-EXPR"))

    # GROUP BY and ORDER BY: entries that are one column
    ordered = columns.where(F.col("own_clause").isin("GROUP", "ORDER") & p1.isin("BY", ",") & n1.isin("", ",", ")", "ASC", "DESC", "FETCH", "FOR", "HAVING", "ORDER", "WITH", "UNION", "OPTIMIZE", ";"))
    if wanted("GROUP BY", "ORDER BY"):
        out.append(_use(ordered, "READ", F.concat(F.col("own_clause"), F.lit(" BY"))))

    # INSERT: the list after the table, else all its columns, paired with VALUES by position
    inserts = target.where((F.col("tok") == "(") & (F.col("pos") == F.col("after")) & (F.col("n1") != "SELECT")).select(*_KEY, F.col("grp").alias("list"))
    merge_list = rows.where((F.col("tok") == "(") & (F.col("p1") == "INSERT") & (F.col("verb") == "MERGE")).select(*_KEY, F.col("grp").alias("list"))
    lists = inserts.unionByName(merge_list)
    listed = rows.where("kind = 'name'").join(lists.select(*_KEY, F.col("list").alias("grp")), [*_KEY, "grp"]).select(*_KEY, "pos", "line", "slot", "word")
    listed = listed.join(targets, _KEY).where("what in ('INSERT', 'MERGE')").select(*_KEY, "pos", "line", "slot", F.element_at(F.split("word", r"\."), -1).alias("name"), F.col("target").alias("table"))
    without = targets.where("what = 'INSERT'").join(lists.select(*_KEY), _KEY, "left_anti")
    expanded = without.join(known.select(F.col("table").alias("target"), "name", "seq"), "target", "left")
    no_list = expanded.where("name is null").select(*_KEY, F.col("target_line").alias("line"), F.lit("INSERT-NO-COLUMNS").alias("kind"), F.col("target").alias("detail"))
    positional = expanded.where("name is not null").select(*_KEY, F.col("target_pos").alias("pos"), F.col("target_line").alias("line"), F.col("seq").alias("slot"), "name", F.col("target").alias("table"))
    opened = rows.where((F.col("tok") == "(") & (F.col("p1") == "VALUES")).groupBy(*_KEY).agg(F.min("grp").alias("grp"))
    values = hosts.join(opened, [*_KEY, "grp"]).groupBy(*_KEY, "slot").agg(F.min_by("word", "pos").alias("host"))
    inserted = listed.unionByName(positional).join(values, [*_KEY, "slot"], "left")
    if wanted("INSERT"):
        out.append(_use(inserted, "WRITE", "INSERT", F.coalesce("host", F.lit(""))))

    # FETCH: host variables paired with the select list of the latest declaration of the cursor before it
    cursors = rows.where((F.col("kind") == "name") & (F.col("p1") == "DECLARE") & (F.col("verb") == "DECLARE") & F.col("n1").isin("CURSOR", "INSENSITIVE", "SENSITIVE", "SCROLL", "ASENSITIVE", "NO")).select(*_KEY, F.col("word").alias("cursor"))
    chosen = items.where("owner = -1 and own_branch = 0").join(cursors, _KEY).select("path", "cursor", F.struct("unit", "stmt").alias("declared"), "ordinal", "name", "table")
    into = hosts.where((F.col("verb") == "FETCH") & (F.col("clause") == "INTO") & F.col("p1").isin("INTO", ",")).select(*_KEY, "pos", "line", F.col("slot").alias("ordinal"), F.col("word").alias("host"))
    fetched = rows.where((F.col("kind") == "name") & (F.col("verb") == "FETCH") & (F.col("n1") == "INTO")).select(*_KEY, F.col("word").alias("cursor")).dropDuplicates(_KEY)
    opened = fetched.join(chosen.select("path", "cursor", "declared").distinct(), ["path", "cursor"]).where(F.col("declared") < F.struct("unit", "stmt")).groupBy(*_KEY, "cursor").agg(F.max("declared").alias("declared"))
    matched = into.join(opened, _KEY).join(chosen, ["path", "cursor", "declared", "ordinal"])
    if wanted("FETCH"):
        out.append(_use(matched, "READ", "FETCH", F.col("host")))

    # CREATE INDEX, LOAD and UNLOAD: the list after the table
    after = target.where((F.col("tok") == "(") & ((F.col("pos") == F.col("after")) | ((F.col("pos") > F.col("target_pos")) & (F.col("p1") == ")") & F.col("verb").isin("LOAD", "UNLOAD") & (F.col("level") == 1))))
    after = after.where("what in ('CREATE INDEX', 'LOAD INTO TABLE', 'UNLOAD FROM TABLE')").groupBy(*_KEY, "target", "target_pos", "what").agg(F.min("grp").alias("grp"))
    fields = rows.where((F.col("kind") == "name") & F.col("p1").isin("(", ",")).join(after, [*_KEY, "grp"]).withColumn("name", F.element_at(F.split("word", r"\."), -1)).withColumn("table", F.col("target"))
    if wanted("INDEX"):
        out.append(_use(fields.where("what = 'CREATE INDEX'"), "READ", "INDEX"))
    if wanted("LOAD"):
        out.append(_use(fields.where("what = 'LOAD INTO TABLE'"), "WRITE", "LOAD"))
    if wanted("UNLOAD"):
        out.append(_use(fields.where("what = 'UNLOAD FROM TABLE'"), "READ", "UNLOAD"))
    bare = targets.where("what in ('LOAD INTO TABLE', 'UNLOAD FROM TABLE')").join(after.select(*_KEY, "target_pos"), [*_KEY, "target_pos"], "left_anti")
    filled = bare.join(known.select(F.col("table").alias("target"), "name"), "target", "left").withColumn("pos", F.col("target_pos")).withColumn("line", F.col("target_line")).withColumn("table", F.col("target"))
    blank = filled.where("name is null").select(*_KEY, "line", F.lit("NO-COLUMN-LIST").alias("kind"), F.col("target").alias("detail"))
    full = filled.where("name is not null")
    if wanted("LOAD"):
        out.append(_use(full.where("what = 'LOAD INTO TABLE'"), "WRITE", "LOAD"))
    if wanted("UNLOAD"):
        out.append(_use(full.where("what = 'UNLOAD FROM TABLE'"), "READ", "UNLOAD"))
    notes = full.select("path", F.col("target").alias("table"), F.lower("target_verb").alias("verb")).distinct()

    uses = reduce(DataFrame.unionByName, out).join(labels(rows), _KEY)
    uses = uses if contexts is None else uses.where(F.col("context").isin(*contexts))
    holes = reduce(DataFrame.unionByName, [ambiguous, blind, no_list, blank]).distinct()
    return uses.select(*_OUT), holes.select(*_KEY, "line", "kind", "detail"), notes


def _targets(rows: DataFrame) -> DataFrame:
    """(key, target, target_pos, after, what, target_line, target_verb): the table that a statement writes, indexes, loads or unloads."""
    found = table_tokens(rows).where((F.col("access") == "WRITE") | F.col("what").isin("CREATE INDEX", "UNLOAD FROM TABLE"))
    # after: the place of the token that follows the table's name
    follow = rows.select(*_KEY, F.lead("pos").over(Window.partitionBy(*_KEY).orderBy("pos")).alias("after"), "pos")
    return found.join(follow, [*_KEY, "pos"]).select(*_KEY, F.col("table").alias("target"), F.col("pos").alias("target_pos"), "after", "what", F.col("line").alias("target_line"), F.col("verb").alias("target_verb"))
