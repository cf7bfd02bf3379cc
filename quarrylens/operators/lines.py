"""Logical lines of COBOL source and units of SQL text within files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COBOL_KINDS = ["COBOL", "COPYBOOK", "DCLGEN"]
#: Embedded statements that neither read nor write a table's columns.
SKIPPED = ["INCLUDE", "WHENEVER", "COMMIT", "ROLLBACK", "OPEN", "CLOSE", "CONNECT", "SET", "BEGIN", "END", "PREPARE", "EXECUTE", "DESCRIBE"]


def is_free_format(text: Column, lines: Column) -> Column:
    """By directive in the first 200 lines, or where over a fifth of the first 500 non-blank lines are coded:
    columns 1-6 hold other than one number, or none, between blanks."""
    told = F.substring_index(text, "\n", 200).rlike(r"(?i)>>[^\S\n]*SOURCE[^\S\n]+(?:FORMAT[^\S\n]+)?(?:IS[^\S\n]+)?FREE")
    sample = F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, 500)
    coded = F.size(F.filter(sample, lambda x: ~F.substring(x, 1, 6).rlike(r"^\s*[0-9]*\s*$")))
    # most source has a number or blanks at the head of every line: one look at the text tells that, not one a line
    odd = text.rlike(r"(?dm)^(?![0-9]{6}| {6}| *$)")
    return (text.contains(">>") & told) | (odd & (coded > 0.2 * F.size(sample)))


def logical_lines(lines: Column, free: Column) -> Column:
    """array<struct<line, code, more>>: columns 8-72 of fixed format without comments, continuations told by ``more``; free format as it is."""
    # columns 7-72, cut once a line
    tails = F.transform(lines, lambda x: F.substring(x, 7, 66))
    note = lambda x: reduce(Column.__or__, [x.startswith(c) for c in "*/Dd"])
    fixed = F.transform(tails, lambda x, i: F.struct((i + 1).alias("line"), F.when(~note(x), F.rtrim(F.substring(x, 2, 65))).alias("code"), x.startswith("-").alias("more")))
    fixed = F.filter(fixed, lambda x: x["code"] != "")
    loose = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.when(~F.ltrim(x).startswith("*>") & (F.trim(x) != ""), F.rtrim(x)).alias("code"), F.lit(False).alias("more")))
    return F.when(free, F.filter(loose, lambda x: x["code"].isNotNull())).otherwise(fixed)


def cobol_blobs(files: DataFrame) -> DataFrame:
    """Adds blob (logical lines joined by line feeds) and origin (the original number of each).

    A continuation (column 7 is '-') is joined, left-stripped, to the line before it, whose number it takes.
    """
    # a column a step: each is made once a file, however often the next one reads it
    rows = files.withColumn("lines", F.split("text", "\n", -1))
    rows = rows.withColumn("logical", logical_lines(F.col("lines"), is_free_format(F.col("text"), F.col("lines"))))
    # a line feed before every line that does not continue another, but the first
    joined = F.transform("logical", lambda x, i: F.when(x["more"], F.ltrim(x["code"])).when(i == 0, x["code"]).otherwise(F.concat(F.lit("\n"), x["code"])))
    rows = rows.withColumn("blob", F.array_join(joined, ""))
    return rows.withColumn("origin", F.transform(F.filter("logical", lambda x: ~x["more"]), lambda x: x["line"])).drop("lines", "logical")


def embedded_sql(blobs: DataFrame) -> DataFrame:
    """Units (path, unit, first, origin, text) of EXEC SQL bodies; ``first`` is the logical line the body starts on.

    Statements whose first word is one of SKIPPED give no unit. A host variable's value in SET is no column use.
    """
    # patterns begin with a letter, and look back for the word's begin: to try a boundary at every character takes far longer.
    # Where each begins, without dealing or sorting: its mark, which no text holds, stands on the line that its words end on
    bare = F.when(F.col("blob").contains("\x01"), F.translate("blob", "\x01", ".")).otherwise(F.col("blob"))
    marked = F.split(F.regexp_replace(bare, r"(?i)EXEC(?<=\bEXEC)(\s+)SQL\b", "$1\x01"), "\n", -1)
    marks = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\x01"), F.lit("")))
    firsts = F.flatten(F.transform(marked, lambda x, i: F.when(x.contains("\x01"), F.array_repeat(i + 1, marks(x))).otherwise(F.array().cast("array<int>"))))
    # the split stays inside the explode: of a plain column Spark would infer that it is not empty, and work out the blob once more for that
    parts = blobs.select("path", "origin", "blob", firsts.alias("firsts"))
    parts = parts.select("path", "origin", "firsts", F.posexplode(F.split("blob", r"(?i)EXEC(?<=\bEXEC)\s+SQL\b")).alias("unit", "part")).where("unit > 0")
    parts = parts.withColumn("first", F.get("firsts", F.col("unit") - 1).cast("long")).withColumn("text", F.get(F.split("part", r"(?i)END-EXEC(?<=\bEND-EXEC)\b", 2), 0))
    head = F.upper(F.regexp_extract("text", "([A-Za-z]+)", 1))
    return parts.where(~head.isin(*SKIPPED)).select("path", "unit", "first", "origin", "text")
