from quarrylens.operators import uses
from quarrylens.plans import rendered


def test_tables_that_no_context_reads_are_not_worked_out(spark, monkeypatch):
    """GROUP BY and ORDER BY read neither the statements' targets, a sort of all tokens, nor ambiguous columns."""
    names, kept = [], uses.written
    monkeypatch.setattr(uses, "written", lambda df, name: names.append(name) or kept(df, name))
    got = rendered.queries()["group_order_by"](spark, "/root/testdata/sf0.001")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert names == ["block_tables", "columns"]
    assert {(r.context, r.line, r["count"]) for r in got.groupBy("context", "line").count().collect()} == {("GROUP BY", 2, parts), ("ORDER BY", 3, parts)}
