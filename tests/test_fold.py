"""Units are folded where they are: no token is shuffled, sorted or put into a window, and odd text keeps its meaning."""

from pyspark.sql import functions as F

from quarrylens.operators import lexer
from quarrylens.plans import rendered

_UNITS = "path string, unit int, first long, origin array<int>, text string"


def test_tokens_are_not_sorted(spark):
    units = spark.range(50).select(F.concat(F.lit("/L/M"), "id").alias("path"), F.lit(0).alias("unit"), F.lit(1).cast("long").alias("first"), F.lit(None).cast("array<int>").alias("origin"), F.lit("SELECT F(A, ')') FROM T;").alias("text"))
    rows = lexer.placed(lexer.structured(lexer.tokens(units)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1
    assert rows.groupBy("path").agg(F.max("level").alias("deepest"), F.max("stmt").alias("stmt"), F.count("*").alias("n")).groupBy("deepest", "stmt", "n").count().collect() == [(1, 1, 10, 50)]


def test_odd_units(spark):
    text = "LOAD DATA INTO TABLE A.B ;)(x 'open\n"
    units = spark.createDataFrame([("a", 0, 3, None, None), ("b", 0, 1, None, ""), ("c", -7, 2, [10, 20, 31], f"-- gone\n{text}"), ("d", 0, 1, None, 'SELECT "é"."q" . * FROM t\x0b/*/ u')], _UNITS)
    rows = {(r.path, r.pos): r for r in lexer.placed(lexer.structured(lexer.tokens(units))).collect()}
    assert {p for p, _ in rows} == {"c", "d"}
    found = [(r.tok, r.line, r.stmt, r.level, r.grp, r.p1, r.n1, r.verb) for (p, _), r in sorted(rows.items()) if p == "c"]
    close = next(at for (p, at), r in rows.items() if p == "c" and r.tok == ")")
    assert found[0] == ("LOAD", 31, 1, 0, -1, None, "DATA", "LOAD")
    # a parenthesis that nothing opens; then one that nothing closes, around a literal without an end
    assert found[-4:] == [(")", 31, 2, 1, -1, ";", "(", "X"), ("(", 31, 2, 1, close + 1, ")", "X", "X"), ("x", 31, 2, 1, close + 1, "(", "'open\n", "X"), ("'open\n", 31, 2, 1, close + 1, "X", None, "X")]
    star = next(r for (p, _), r in rows.items() if p == "d" and r.kind == "star")
    assert (star.word, star.clause, star.blank) == ("é.q", "SELECT", True)
    assert [r.blank for (p, _), r in rows.items() if r.tok == "u"] == [True]


def test_declared_columns_are_written_before_they_are_returned(spark):
    plan = rendered.queries()["ddl_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan
