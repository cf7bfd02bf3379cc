"""Queries over rendered artifacts against the SQL that tells their facts from the columns, on the smallest tables."""

import duckdb
import pytest

from quarrylens.plans import rendered

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mask_sql", "cobol_logical_lines", "data_set_names", "vendor_calls", "job_steps", "call_depths", "undefined_columns", "tuple_set", "outer_qualifiers", "chunked_statements", "assembled_sql"])
def test_rendered_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = rendered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({rendered.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, map(tuple, want)))
    spark.catalog.clearCache()
