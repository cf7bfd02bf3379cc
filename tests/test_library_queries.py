"""Whole answers over a rendered library against SQL, and an index of artifacts that a table holds."""

import duckdb
import pytest

from quarrylens.plans import rendered_library
from quarrylens.plans.index import index_of
from quarrylens.plans.tables import table_dependencies

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(rendered_library.queries()))
def test_answer(spark, name):
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = rendered_library.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({rendered_library.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, map(tuple, want)))
    spark.catalog.clearCache()


def test_index_of_a_table(spark):
    schema = "path string, library string, member string, length long, text string, kind string, tokens int"
    rows = [("/L/A.sql", "L", "A", 30, "DELETE FROM S.T WHERE X = 1;", "SQL", 1), ("/L/B.sql", "L", "B", 9, None, "UNKNOWN", 2), ("/L/C.sql", "L", "C", 0, "", "SQL", 3)]
    index = index_of(spark.createDataFrame(rows, schema))
    assert index.stats() == {"files": 3, "table_refs": 1}
    assert [(r.path, r.kind) for r in index.blind_spots.collect()] == [("/L/B.sql", "UNREADABLE")]
    assert [(r.member, r.stmt) for r in table_dependencies(index, "S.T", data_hops=0).refs] == [("A", "DELETE")]
    assert index_of(spark.createDataFrame([], schema)).stats() == {"files": 0, "table_refs": 0}
