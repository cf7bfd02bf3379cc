"""Nesting and chains longer than any fixed number of rounds."""

from types import SimpleNamespace

import pytest

from quarrylens.operators import lexer
from quarrylens.plans import tables


def placed(spark, *statements):
    units = spark.createDataFrame([(str(i), 0, 1, None, s) for i, s in enumerate(statements)], "path string, unit int, first long, origin array<int>, text string")
    return lexer.placed(lexer.structured(lexer.tokens(units)))


def test_owner_under_many_parentheses(spark):
    nested = lambda name, n: "REPLACE(" * n + name + ")" * n
    statements = [f"SELECT A FROM P.T WHERE {nested('DEEP', n)} = 1 AND B IN (SELECT C FROM P.U WHERE {nested('FAR', n)} = (((2))) AND NEAR = 1) AND LAST = 3" for n in (1, 8, 9, 12, 40)]
    rows = {(int(r.path), r.tok): r for r in placed(spark, *statements).where("kind = 'name'").collect()}
    for i in range(len(statements)):
        inner = rows[i, "C"].grp
        assert (rows[i, "DEEP"].owner, rows[i, "DEEP"].own_clause) == (-1, "WHERE")
        assert (rows[i, "FAR"].owner, rows[i, "FAR"].own_clause) == (inner, "WHERE") and inner > 0
        assert (rows[i, "NEAR"].owner, rows[i, "LAST"].owner, rows[i, "LAST"].own_clause) == (inner, -1, "WHERE")


def test_closures_follow_chains_to_their_end(spark):
    n = 56
    calls = spark.createDataFrame([(f"P{i + 1}", f"P{i}") for i in range(n)] + [("P3", f"P{n}")], "caller string, callee string")
    got = {r.name: r.depth for r in tables.call_closure(calls, spark.createDataFrame([("P0",)], "name string")).collect()}
    assert got == {f"P{i}": i for i in range(n + 1)}

    objects = spark.createDataFrame([("S", f"V{i + 1}", "S", f"V{i}", "view") for i in range(10)], "schema string, name string, base_schema string, base_name string, why string")
    got = tables.expanded_targets(SimpleNamespace(spark=spark, objects=objects), "S.V0").collect()
    assert sorted(r.table for r in got) == sorted(f"V{i}" for i in range(11))


def test_steps_through_nested_procedures(spark):
    rows = [("p0", "PROC0", "S", 1, "PGM", "", "PGM", 1)] + [(f"p{i}", f"PROC{i}", "S", 1, "", f"PROC{i - 1}", "", 1) for i in range(1, 9)]
    steps = spark.createDataFrame(rows, "path string, job string, step string, seq long, pgm string, proc string, resolved_pgm string, line int")
    dds = spark.createDataFrame([], "path string, job string, step string, seq long, dd string, dsn string, disp string, base string, tail string, is_member boolean")
    files = spark.createDataFrame([], "path string, library string, member string, kind string")
    refs = spark.createDataFrame([], "path string, line int, kind string")
    found, _ = tables.dependent_steps(SimpleNamespace(steps=steps, dds=dds, files=files), refs, spark.createDataFrame([("PGM",)], "name string"))
    assert sorted(r.job for r in found.collect()) == [f"PROC{i}" for i in range(9)]


def test_closure_raises_at_its_bound(spark):
    start = spark.createDataFrame([(0,)], "n int")
    with pytest.raises(RuntimeError):
        tables.closure(start, lambda last, _: last.selectExpr("n + 1 AS n"), ["n"], max_rounds=3)
