"""Table references, aliases and object definitions, read off the structured tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import NOT_COLUMNS

_KEY = ["path", "unit", "stmt"]
_NOT_ALIAS = [*NOT_COLUMNS, "TABLE", "FULL", "NATURAL", "WHERE", "OPTIMIZE", "EXCEPT", "INTERSECT", "VALUES", "FINAL", "OLD", "NEW", "SHRLEVEL", "REPLACE", "RESUME", "IGNORE", "DO", "THEN"]


def _split(word) -> tuple:
    parts = F.split(word, r"\.")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.element_at(parts, -1)


def _use(access: str, what: str | Column) -> Column:
    return F.struct(F.lit(access).alias("access"), (F.lit(what) if isinstance(what, str) else what).alias("what"))


def _rule() -> Column:
    """struct(access, what) of a name token in table position, else null."""
    p1, p2, p3, n1, n2 = (F.coalesce(c, F.lit("")) for c in ("p1", "p2", "p3", "n1", "n2"))
    clause = F.coalesce("clause", F.lit(""))
    item = (p1.isin("FROM", "JOIN") | ((p1 == ",") & clause.isin("FROM", "ON"))) & clause.isin("FROM", "ON") & (n1 != "(") & ~((p1 == "FROM") & (p2 == "DELETE"))
    index_on = (p1 == "ON") & (F.col("verb") == "CREATE") & p3.isin("INDEX")
    return (
        F.when(F.col("kw").isin("SET", "WHERE", "TABLE", "SELECT", "VALUES", "LATERAL", "FINAL", "OLD", "NEW", "DISTINCT"), None)
        .when((p1 == "UPDATE") & (p2 != "FOR"), _use("WRITE", "UPDATE"))
        .when((p1 == "INTO") & p2.isin("INSERT"), _use("WRITE", "INSERT"))
        .when((p1 == "INTO") & p2.isin("MERGE"), _use("WRITE", "MERGE"))
        .when((p1 == "FROM") & (p2 == "DELETE"), _use("WRITE", "DELETE"))
        .when((p1 == "TABLE") & (p2 == "INTO"), _use("WRITE", "LOAD INTO TABLE"))
        .when((p1 == "TABLE") & (p2 == "FROM"), _use("READ", "UNLOAD FROM TABLE"))
        .when((p1 == "TABLE") & (p2 == "LOCK"), _use("LOCK", "LOCK TABLE"))
        .when((p1 == "TABLE") & p2.isin("CREATE", "DROP", "ALTER", "TEMPORARY"), _use("DDL", F.concat_ws(" ", F.when(p2 == "TEMPORARY", "CREATE").otherwise(p2), F.lit("TABLE"))))
        .when((p1 == "DECLARE") & (n1 == "TABLE"), _use("DECLARE", "DECLARE TABLE"))
        .when(index_on, _use("DDL", "CREATE INDEX"))
        .when((p1 == "USING") & (F.col("verb") == "MERGE") & (n1 != "("), _use("READ", "MERGE"))
        .when(item, _use("READ", F.when(F.col("verb") == "UNLOAD", "UNLOAD FROM TABLE").otherwise("SELECT")))
    )


def _common_table() -> Column:
    """Whether a name token names a common table expression."""
    return F.coalesce(F.col("p1").isin("WITH", ",", "RECURSIVE") & (F.col("own_clause") == "WITH") & (((F.col("n1") == "AS") & (F.col("n2") == "(")) | (F.col("n1") == "(")), F.lit(False))


def reference_tokens(rows: DataFrame) -> DataFrame:
    """Those structured tokens, and columns of them, that ``table_references`` reads: few of all, so they are what to write before it."""
    wanted = _rule().isNotNull() | _common_table() | F.coalesce(F.col("p1") == "TABLESPACE", F.lit(False))
    columns = [*_KEY, "pos", "line", "kind", "word", "kw", "p1", "p2", "p3", "n1", "n2", "verb", "grp", "clause", "owner", "own_clause", "own_branch"]
    return rows.where((F.col("kind") == "name") & wanted).select(*columns)


def table_tokens(rows: DataFrame) -> DataFrame:
    """Name tokens in table position: access, stmt_name, via, with schema, table and alias."""
    n1, n2 = (F.coalesce(c, F.lit("")) for c in ("n1", "n2"))
    schema, table = _split(F.col("word"))
    alias = F.when(n1 == "AS", n2).when(n1.rlike(r"^[A-Z@#$][A-Z0-9@#$_]*$"), n1)
    alias = F.when(alias.isin(*_NOT_ALIAS), None).otherwise(alias)
    found = rows.where(F.col("kind") == "name").withColumn("rule", _rule()).where("rule is not null")
    found = found.select(*_KEY, "pos", "line", "grp", "owner", "own_branch", "verb", F.col("rule.access").alias("access"), F.col("rule.what").alias("what"), schema.alias("schema"), table.alias("table"), alias.alias("alias"))
    ctes = rows.where((F.col("kind") == "name") & _common_table()).select(*_KEY, F.col("word").alias("table"), F.lit("").alias("schema")).distinct()
    return found.join(ctes, [*_KEY, "table", "schema"], "left_anti")


def table_references(rows: DataFrame) -> DataFrame:
    """(path, unit, stmt, line, schema, table_name, access, stmt_name, via) of every reference to a table or table space."""
    direct = table_tokens(rows).select(*_KEY, "line", "schema", F.col("table").alias("table_name"), "access", F.col("what").alias("stmt_name"), F.lit("").alias("via"))
    schema, name = _split(F.col("word"))
    utilities = ["REORG", "RUNSTATS", "COPY", "QUIESCE", "CHECK", "RECOVER", "REBUILD", "REPAIR", "MODIFY", "UNLOAD", "LOAD"]
    spaces = rows.where((F.col("kind") == "name") & (F.col("p1") == "TABLESPACE") & F.col("verb").isin(*utilities))
    spaces = spaces.select(*_KEY, "line", schema.alias("schema"), name.alias("table_name"), F.when(F.col("verb") == "UNLOAD", "READ").when(F.col("verb").isin("RUNSTATS", "COPY", "QUIESCE", "CHECK"), "READ").otherwise("WRITE").alias("access"), F.concat_ws(" ", "verb", F.lit("TABLESPACE")).alias("stmt_name"), F.lit("tablespace").alias("via"))
    return direct.unionByName(spaces)


def objects(rows: DataFrame) -> DataFrame:
    """(path, schema, name, base_schema, base_name, why): views over tables, synonyms and aliases, tables in table spaces."""
    schema, name = _split(F.col("word"))
    p1, p2 = F.coalesce("p1", F.lit("")), F.coalesce("p2", F.lit(""))
    named = rows.where((F.col("kind") == "name") & (F.col("verb") == "CREATE"))
    heads = named.where(p1.isin("VIEW", "SYNONYM", "ALIAS", "TABLE")).groupBy(*_KEY).agg(F.min_by(F.struct(schema.alias("schema"), name.alias("name"), p1.alias("what")), "pos").alias("head"))
    views = table_tokens(rows).where((F.col("verb") == "CREATE") & (F.col("what") == "SELECT")).select(*_KEY, F.col("schema").alias("base_schema"), F.col("table").alias("base_name"))
    views = views.join(heads.where("head.what = 'VIEW'"), _KEY).withColumn("why", F.lit("view over "))
    other = named.where((p1 == "FOR") & p2.isNotNull()).select(*_KEY, schema.alias("base_schema"), name.alias("base_name")).join(heads.where("head.what in ('SYNONYM', 'ALIAS')"), _KEY).withColumn("why", F.lit("synonym for "))
    spaces = named.where((p1 == "IN") & (F.col("level") == 0)).select(*_KEY, schema.alias("base_schema"), name.alias("base_name")).join(heads.where("head.what = 'TABLE'"), _KEY).withColumn("why", F.lit("in tablespace "))
    every = views.unionByName(other).unionByName(spaces)
    dotted = F.concat_ws(".", F.when(F.col("base_schema") != "", F.col("base_schema")), "base_name")
    return every.select("path", F.col("head.schema").alias("schema"), F.col("head.name").alias("name"), "base_schema", "base_name", F.concat("why", dotted).alias("why")).distinct()
