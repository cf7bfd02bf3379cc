"""Tables that are small as files and large as rows: neither broadcast nor dealt to a fixed number of tasks."""

from pyspark.sql import functions as F

from quarrylens.functions import storage
from quarrylens.operators import lexer


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_alike_rows_of_a_small_file_are_not_broadcast(spark, monkeypatch):
    many = storage.stored(spark.range(0, 300_000, 1, 8).select(F.concat(F.lit("/SHOP.COBOL/P"), "id").alias("path"), F.lit("x" * 300).alias("text")), "many")
    seen = []
    kept = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: seen.append(_plan(df)) or kept(df, name))
    other = spark.read.parquet(*many.inputFiles()).withColumnRenamed("text", "other")
    joined = lambda: many.join(other.dropDuplicates(["path"]), "path")
    assert "BroadcastHashJoin" in _plan(joined())
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    storage.written(joined(), "joined")
    assert "SortMergeJoin" in seen[0] and "BroadcastHashJoin" not in seen[0].split("== Physical Plan ==")[1]
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == before


def test_tasks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(lexer, "SQL_A_TASK", 1000)
    unit = F.lit("SELECT A FROM T WHERE B = 1")
    units = spark.range(2000).select(F.concat(F.lit("/L/M"), "id").alias("path"), F.lit(0).alias("unit"), F.lit(1).cast("long").alias("first"), F.lit(None).cast("array<int>").alias("origin"), unit.alias("text"))
    toks = lexer.tokens(units)
    assert toks.rdd.getNumPartitions() == 54  # 2000 texts of 27 bytes, however many spark.sql.shuffle.partitions
    assert toks.count() == 2000 * 8
