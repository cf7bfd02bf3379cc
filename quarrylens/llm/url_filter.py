"""URL filtering by a Bloom filter cascade: exact membership of listed hosts without a join.

DataFrame functions only. Level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 lets through
wrongly; level 2 the listed keys that level 1 lets through, and so on until nothing passes wrongly. Over all keys
of the corpus (the universe the cascade is built on) and all listed keys, the answer is exact.

Levels are literals of the plan, so their bytes are bounded. A list or a universe too long for that is split by key
hash into parts with a cascade each, and the rows pass them one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Rules as the contract fixes them: verdict, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts that the query blocks with all their subdomains where no rule speaks.
LISTED = ("cheap-pills.example.com", "spam-farm.example.org", "casino-wins.example.net")
#: Bits of one Spark bitmap.
BITMAP = 32768
#: Bytes of a level; and the share of foreign keys that a level of 10 bits and 4 hashes a key lets through, rounded up.
LEVEL_BYTES, WRONG = 8 << 20, 0.02


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first '://' and '/', '?', '#' or the end, A-Z lower-cased; then up to '?', '#' or the end."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    seed: int
    hashes: int

    def passes(self, key: Column) -> Column:
        """Whether all bits of the key are set; a filter of no bits passes nothing."""
        if not self.size:
            return F.lit(False)
        image = F.lit(self.bits)
        answer = F.lit(True)
        for h in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + h)), F.lit(self.size))
            byte = F.conv(F.hex(F.substring(image, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), F.pmod(at, F.lit(8)).cast("int") + 1)
            answer = answer & (byte.bitwiseAND(mask) != 0)
        return answer


def _level(keys: DataFrame, seed: int, bits_per_key: int, hashes: int, max_bytes: int) -> Level:
    n = keys.count()
    size = max(64, n * bits_per_key) if n else 0
    if size // 8 > max_bytes:
        raise ValueError(f"a level of {size // 8} bytes exceeds max_bytes={max_bytes}; take more parts")
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed * 64 + h)), F.lit(max(1, size))) + 1 for h in range(hashes)]))
    maps = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    image = bytearray(-(-size // BITMAP) * BITMAP // 8)
    for row in maps.collect():  # at most max_bytes
        begin = (row["b"] - 1) * BITMAP // 8
        image[begin : begin + len(row["m"])] = row["m"]
    return Level(bytes(image[: -(-size // 8)]), size, seed, hashes)


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 10, hashes: int = 4, max_bytes: int = LEVEL_BYTES, max_levels: int = 40) -> list[Level]:
    """Levels for the listed keys over the universe; both have one string column ``key``. ``max_bytes`` bounds each level."""
    ins = written(listed.where("key is not null").distinct(), "listed")
    outs = written(universe.where("key is not null").distinct().join(ins, "key", "left_anti"), "universe")
    levels, encoded, other = [], ins, outs
    for depth in range(max_levels):
        level = _level(encoded, depth, bits_per_key, hashes, max_bytes)
        levels.append(level)
        wrong = written(other.where(level.passes(F.col("key"))), f"level{depth}")
        if not wrong.limit(1).count():
            return levels
        encoded, other = wrong, encoded
    raise RuntimeError("the cascade did not close")


def member(levels: Sequence[Level], key: Column) -> Column:
    answer = F.lit(False)
    for level in reversed(levels):
        answer = level.passes(key) & ~answer
    return answer


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def parts_needed(listed: int, universe: int, max_bytes: int, bits_per_key: int = 10) -> int:
    """Parts in which no level exceeds ``max_bytes``: neither the listed keys nor the foreign ones let through wrongly."""
    return max(1, -(-int(max(listed, universe * WRONG) * bits_per_key / 8 / 0.8) // max_bytes))


def listed_hosts(rows: DataFrame, listed: DataFrame, max_bytes: int = LEVEL_BYTES) -> DataFrame:
    """``rows`` (with a column ``host``) and ``listed``: whether the host or a domain above it is on the list."""
    keys = written(rows.groupBy("host").count().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct(), "keys")
    listed = written(listed.select("key").where("key is not null").distinct(), "listed")
    parts = parts_needed(listed.count(), keys.count(), max_bytes)
    rows = rows.withColumn("listed", F.lit(False))
    for part in range(parts):
        mine = part_of(F.col("key"), parts) == part
        levels = build_cascade(listed.where(mine), keys.where(mine), max_bytes=max_bytes)
        hit = F.exists(suffixes(F.col("host")), lambda k: (part_of(k, parts) == part) & member(levels, k))  # noqa: B023
        rows = rows.withColumn("listed", F.col("listed") | hit)
        if parts > 1:  # a plan holds one cascade
            rows = written(rows, f"part{part}")
    return rows


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] | DataFrame = LISTED, id_col: str = "page_id", url_col: str = "url", max_bytes: int = LEVEL_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict, listed.

    The longest fitting rule decides (of equally long ones the first); else a host is blocked if it or a domain
    above it is listed. Null urls and urls without '://' have empty host and path and are allowed. An empty table
    gives an empty result; only the two named columns are read. ``rules`` become one expression: keep them to
    some hundreds; long lists belong in ``listed``. Repeated rows give repeated results; urls are read whole, however long.
    """
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(k,) for k in listed], "key string")
    rows = listed_hosts(rows, listed, max_bytes)
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ordered):
        domain, _, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"), "listed")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
