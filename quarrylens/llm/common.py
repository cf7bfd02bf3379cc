"""Helpers shared by the operators: written tables, groups of sorted rows, linked components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.storage import shared_dir
from quarrylens.functions.storage import stored as written

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls into fold 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(1))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a partition that is sorted by ``keys`` into one table per key; holds one group and one batch at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        columns = [rows.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        begin = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > begin:
                    held.append(rows.slice(begin, i - begin))
                if held:
                    yield pa.concat_tables(held)
                held, begin, last = [], i, mark
        held.append(rows.slice(begin))
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in ``edges`` (columns a, b): rows (id, component).

    Hooking and pointer jumping with joins and minima only. Each round is written to the shared folder, so
    lineage stays short; the number of rounds grows with the logarithm of the longest chain. Nulls are ignored;
    no rows in, no rows out. More than ``max_rounds`` rounds raise, they are never cut off.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    parent = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "parents")
    for _ in range(max_rounds):
        up = parent.select(F.col("id").alias("p"), F.col("component").alias("grand"))
        jumped = parent.join(up, F.col("component") == F.col("p")).select("id", "component", "grand")
        near = both.join(jumped.select(F.col("id").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("low"))
        seen = jumped.join(near.withColumnRenamed("a", "id"), "id").select("id", "component", F.least("grand", "low").alias("low"))
        told = seen.select("id", "low").unionByName(seen.select(F.col("component").alias("id"), "low")).groupBy("id").agg(F.min("low").alias("low"))
        after = written(parent.join(told, "id").select("id", F.least("component", "low").alias("component"), (F.col("low") < F.col("component")).alias("moved")), "parents")
        moved = after.where("moved").limit(1).count()
        parent = after.select("id", "component")
        if not moved:
            return parent
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


__all__ = ["WHITE_SPACE", "components", "fold", "groups", "shared_dir", "table", "written"]
