"""Exact deduplication over an extendible-hash index that is kept as files in the shared folder.

DataFrame functions only. Texts are hashed to 64 bits; the leading bits address a directory that is doubled until no
bucket holds more than ``capacity`` different keys. The directory deals the buckets in key order to owner tasks, so
that each owns a range of keys. Whole normalised texts go to their owners once, and are compared there byte by byte:
equal ones become one entry, and different ones with one key form the key's chain. Only the owners' entries tell which
rows are equal. A bucket that is too much for one task, such as that of a text which a third of all rows share, is dealt
to several owners by row; the few entries that they find in it are compared once more.

``MAX_DEPTH`` bits address 65,536 buckets. A bucket that is still over-full then overflows: it keeps all its entries, in
as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, written

MAX_DEPTH = 16
#: Bytes of text below which an owner's range is not cut further, and what a row costs beside its text.
OWNER_BYTES, ROW_BYTES = 4 << 20, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("row_id"), normalised(F.col(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """(cell, local_depth, bucket, owner, spread) for every used cell of the fully doubled directory: 65,536 rows at most.

    ``keys`` has a row for each key: cell, load in bytes. A prefix of d bits that holds more than ``capacity`` keys
    splits; a cell's local depth is the number of its prefixes that split. ``bucket`` is the prefix with a leading 1, so
    buckets of different depths differ. ``owner`` is the first of the ``spread`` tasks that own the bucket.
    """
    cells = written(keys.groupBy("cell").agg(F.count("*").alias("n"), F.sum("load").alias("load")), "cells")
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH - 1))).alias("depth"))
    prefixes = prefixes.withColumn("prefix", F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)"))
    full = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
    # at most 2^16 rows: the inner nodes of a tree with 2^16 leaves
    splits = prefixes.join(F.broadcast(full.select("depth", "prefix")), ["depth", "prefix"]).groupBy("cell").agg(F.count("*").cast("int").alias("splits"))
    found = cells.join(splits, "cell", "left").select("cell", "load", F.coalesce("splits", F.lit(0)).alias("local_depth"))
    found = found.withColumn("bucket", F.expr(f"shiftright(cell, {MAX_DEPTH} - local_depth) + shiftleft(1, local_depth)"))
    total = cells.agg(F.sum("load")).first()[0] or 0
    share = max(OWNER_BYTES, -(-total // int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    buckets = found.groupBy("bucket").agg(F.min("cell").alias("first"), F.sum("load").alias("load"))
    before = F.sum("load").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("load")
    owned = buckets.select("bucket", F.floor(before / share).cast("int").alias("owner"), F.ceil(F.col("load") / share).cast("int").alias("spread"))
    return written(found.drop("load").join(owned, "bucket"), "directory")


def _indexed(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, its directory, and (row_id, key, sha) of every row."""
    rows = _keyed(docs, id_col, text_col).select("row_id", "key", F.sha2("norm", 256).alias("sha"), (F.octet_length("norm") + ROW_BYTES).alias("load"))
    rows = written(rows, "rows")
    keys = rows.groupBy("key").agg(F.sum("load").alias("load")).select(_cell(F.col("key")).alias("cell"), "load")
    cells = directory(keys, capacity)
    owners = (cells.agg(F.max(F.col("owner") + F.col("spread"))).first()[0] or 0) + 1
    texts = _keyed(docs, id_col, text_col).withColumn("cell", _cell(F.col("key"))).join(F.broadcast(cells.drop("local_depth")), "cell")
    among = F.pmod(F.hash("row_id", F.spark_partition_id()), F.col("spread"))
    texts = texts.select((F.col("owner") + among).alias("owner"), (F.col("spread") > 1).alias("shared"), "bucket", "key", "norm", "row_id")
    found = texts.repartitionById(owners, "owner").groupBy("owner", "shared", "bucket", "key", "norm").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("group_size"))
    # texts go on only where several owners share a bucket; all else is decided
    found = found.select("bucket", "key", F.sha2("norm", 256).alias("sha"), F.when(F.col("shared"), F.col("norm")).alias("again"), "keep_id", "group_size")
    entries = found.repartition("bucket", "key").groupBy("bucket", "key", "sha", "again").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("parts"))
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    clash = (F.col("again").isNull() & (F.col("parts") > 1)) | F.lag("sha").over(chain).eqNullSafe(F.col("sha"))
    entries = entries.withColumn("chain", F.row_number().over(chain)).withColumn("clash", clash)
    sha = F.when(F.col("clash"), F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("sha"))
    return written(entries.select("bucket", "key", "chain", sha.alias("sha"), "keep_id", "group_size"), "index"), cells, rows.drop("load")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(index, directory). Index rows: bucket, key, chain (numbers the different texts of a key), sha, keep_id, group_size."""
    return _indexed(docs, id_col, text_col, capacity)[:2]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; an empty table gives an empty result; only the two named columns are read, so other
    columns cannot clash. Rows that repeat an id are all marked kept when that id stays. Null ids never win over
    others; where a whole group has null ids, all its rows are kept. Texts of any length are compared whole.
    """
    index, _, rows = _indexed(docs, id_col, text_col, capacity)
    # owners have compared all texts of a key, so within a key's chain the digest names the text
    found = rows.join(index.select("key", "sha", "keep_id", "group_size"), ["key", "sha"])
    return found.select(F.col("row_id").alias(id_col), "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, of which no earlier equal text exists.

    Rows that repeat the id and the text that stay are all kept if ``repeats`` is set, else the first of them by all
    their columns that have an order; so are rows of a text that only null ids have. Null texts count as empty; texts are
    compared whole; an empty table gives an empty result.
    """
    index, _ = build_index(docs, id_col, text_col)
    key = lambda row_id: [F.coalesce(row_id.cast("string"), F.lit("")).alias("x_id"), row_id.isNull().alias("x_null")]
    rows = docs.select(F.struct("*").alias("row"), F.sha2(normalised(F.col(text_col)), 256).alias("x_sha"), *key(F.col(id_col)))
    if not repeats:
        ordered = [F.col("row").getField(f.name) for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        first = F.row_number().over(Window.partitionBy("x_sha", "x_id", "x_null").orderBy(*ordered))
        rows = rows.withColumn("x_first", first).where("x_first = 1")
    kept = index.select(F.col("sha").alias("x_sha"), *key(F.col("keep_id")))
    return rows.join(kept, ["x_sha", "x_id", "x_null"], "left_semi").select("row.*")
