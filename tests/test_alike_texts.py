"""Units of one text are lexed and resolved once; each keeps its own uses and lines. Units are cut from a file without dealing it out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import definitions, lexer, lines, texts
from quarrylens.operators.uses import column_uses
from quarrylens.plans import rendered

SF = "/root/testdata/sf0.001"
#: path, unit, first, origin, text: texts that repeat, with own line numbers, too few of them, none, and none at all.
UNITS = [
    ("a", 1, 1, [5, 9], "SELECT A\nINTO :X FROM S.T WHERE B = :Y"),
    ("a", 2, 3, [5, 9, 11, 12], "SELECT A\nINTO :X FROM S.T WHERE B = :Y"),
    ("b", 1, 2, [5, 9], "SELECT A\nINTO :X FROM S.T WHERE B = :Y"),
    ("c", 1, 7, None, "SELECT A\nINTO :X FROM S.T WHERE B = :Y"),
    ("c", 2, 1, [3, None], "UPDATE S.T\nSET A = :Z WHERE B = 1; DELETE FROM S.T\nWHERE A = :Q"),
    ("d", 1, 2, [3, 4, 6], "UPDATE S.T\nSET A = :Z WHERE B = 1; DELETE FROM S.T\nWHERE A = :Q"),
    ("e", 1, None, None, "INSERT INTO S.T VALUES (:P, :Q)"),
    ("f", 1, 1, None, None),
    ("g", 1, 1, [1], "COMMENT"),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "path string, unit int, first long, origin array<int>, text string")


@pytest.fixture(scope="module")
def known(spark):
    script = rendered.artifacts(spark.range(1), "L", F.lit("T.sql"), F.lit("CREATE TABLE S.T (A INT, B INT);"))
    return definitions.known_columns(definitions.defined_columns(rendered._tokens(script)), script).persist()


@pytest.mark.parametrize("few", [texts.FEW_USES, 0])
def test_units_take_over_the_uses_of_their_text(units, known, monkeypatch, few):
    contexts = ["SELECT", "WHERE", "SET", "INSERT"]
    want = column_uses(rendered._placed(units), known, contexts)[0]
    monkeypatch.setattr(texts, "FEW_USES", few)
    kept, alone = texts.told_apart(units)
    assert alone.count() == 4
    got = texts.handed_out(kept, column_uses(rendered._placed(alone), known, contexts)[0])
    told = lambda df: sorted(map(str, df.select("path", "unit", "stmt", "pos", "line", "column", "table", "access", "context", "label", "host_var").collect()))
    assert len(told(want)) == 16 and told(got) == told(want)


@pytest.mark.parametrize("name", ["update_set_writes", "insert_columns", "where_predicates", "select_into_pairing"])
def test_few_texts_of_many_programs_are_lexed(spark, monkeypatch, name):
    """Orders differ in three statements and seven host variables: 21 texts and the declarations, of 1500 programs."""
    lexed, kept = [], lexer.tokens
    monkeypatch.setattr(lexer, "tokens", lambda units: lexed.append(units.count()) or kept(units))
    df = rendered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({rendered.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))
    assert lexed == [22]


def test_statements_are_cut_from_a_file_without_dealing(spark):
    texts_of = [
        "       X. EXEC SQL SELECT A END-EXEC exec  sql B XEND-EXEC C\n      * EXEC SQL NO END-EXEC\n       XEXEC SQL D END-EXEC EXEC SQLX\n       EXEC\n      *\n       SQL E END-EXEC EXEC SQL COMMIT END-EXEC\n       EXEC SQL F",
        "       A\x01EXEC SQL G\x01END-EXEC",
    ]
    rows = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts_of)], "path string, text string")
    found = lines.embedded_sql(lines.cobol_blobs(rows))
    assert sorted((r.path, r.unit, r.first, r.origin, r.text.strip()) for r in found.collect()) == [
        ("p0", 1, 1, [1, 3, 4, 6, 7], "SELECT A"),
        ("p0", 2, 1, [1, 3, 4, 6, 7], "B XEND-EXEC C\n XEXEC SQL D".replace("\n ", "\n")),
        ("p0", 3, 4, [1, 3, 4, 6, 7], "E"),
        ("p0", 5, 5, [1, 3, 4, 6, 7], "F"),
        ("p1", 1, 1, [1], "G\x01"),
    ]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text, free", [
    ("000100 A\n000200 B\n       C\n\n   \n", False), ("A B C\nD", True), ("12 4   X", True), ("  12   X", False),
    ("000100 A\n" * 4 + "ABCDEF\n", False), ("000100 A\n" * 3 + "ABCDEF\n", True), ("000100 >>SOURCE FORMAT IS FREE", True), ("000100 >>X", False),
])
def test_free_format(spark, text, free):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(lines.is_free_format(F.col("text"), F.split("text", "\n", -1)).alias("f")).first().f is free
