"""Column uses of units, worked out once for all units of one text.

Copies of a program, and programs that a generator made, hold the same statements. What a statement reads and writes depends on
its text and the known columns alone, but for FETCH, which names a cursor of another unit. So each text is lexed and resolved
once, and its units take the uses over, each at its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import newlines

#: Uses of all texts that are sent to every task instead of dealing the units out by text: some 10 MB.
FEW_USES = 1 << 16


def told_apart(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, texts) of units (path, unit, first, origin, text): kept are all units with their text's digest and their own line
    numbers; texts, units themselves with the digest as path, are the different texts, their lines numbered from 1."""
    own = F.slice("origin", F.col("first").cast("int"), newlines(F.col("text")) + 1)
    kept = written(units.select("path", "unit", "first", own.alias("own"), F.sha2("text", 256).alias("digest"), "text"), "kept")
    texts = kept.where("digest is not null").groupBy(F.col("digest").alias("path")).agg(F.first("text").alias("text"))
    return kept.drop("text"), texts.select("path", F.lit(0).alias("unit"), F.lit(1).cast("long").alias("first"), F.lit(None).cast("array<int>").alias("origin"), "text")


def handed_out(kept: DataFrame, uses: DataFrame) -> DataFrame:
    """The uses of texts as those of their units: path and unit are the unit's, line is the line in its file."""
    few = uses.limit(FEW_USES + 1).count() <= FEW_USES
    told = uses.select(F.col("path").alias("digest"), *[c for c in uses.columns if c not in ("path", "unit", "line")], (F.col("line") - 1).alias("at"))
    found = kept.join(F.broadcast(told) if few else told, "digest")
    # as the lexer places lines: by the unit's own numbers, past them by counting on
    line = F.coalesce(F.get("own", F.col("at")), F.col("first") + F.col("at")).cast("int")
    found = found.select("path", "unit", *[c for c in told.columns if c not in ("digest", "at")], line.alias("line")).select(*uses.columns)
    return found if few else written(found, "uses")
