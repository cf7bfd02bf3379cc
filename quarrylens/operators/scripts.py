"""Statements of scripts of any size, from chunks that are lexed apart.

A chunk of lines does not tell whether it begins in a literal or a comment. It is lexed for each of the three states it may
begin in, which gives a small function: the state it ends in and the number of statements that end in it, for each state
at its begin. Such functions compose, so a prefix scan over blocks, then over the chunks of a block, tells every chunk's
own state and the number of its first statement. Then each chunk is cut, once, and the pieces of a statement that runs over
several chunks are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import newlines

#: Literal, comments, delimited name, end of a statement, anything else: the token table's pattern as far as it hides text.
_PIECE = r"""(?s)('[^']*+(?:''[^']*+)*+'?|--[^\n]*|/\*/|/\*.*?(?:\*/|\z)|"[^"\n]+"|;|[^'"/\-;]+|.)"""
_CLOSED = r"(?s)\A'[^']*+(?:''[^']*+)*+'\z"
#: What opens the states plain, literal and comment; a blank keeps the comment's opener apart from a '/' after it.
_OPENERS = ("", "'", "/* ")
_MARK = "\0"
_EFFECT = "array<struct<to:int,ends:long>>"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))


def effect(text: Column) -> Column:
    """For each state at the begin (0 plain, 1 literal, 2 comment): the state at the end, and how many statements end."""

    def of(opener: str) -> Column:
        pieces = _pieces(F.concat(F.lit(opener), text))
        last = F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit(""))
        comment = last.startswith("/*") & (last != "/*/") & (~last.endswith("*/") | (F.char_length(last) < 4))
        to = F.when(last.startswith("'") & ~last.rlike(_CLOSED), 1).when(comment, 2).otherwise(0)
        return F.struct(to.cast("int").alias("to"), F.size(F.filter(pieces, lambda x: x == ";")).cast("long").alias("ends"))

    return F.array(*[of(x) for x in _OPENERS])


def composed(first: Column, then: Column) -> Column:
    """The effect of one chunk, then another."""
    return F.transform(first, lambda x: F.struct(F.get(then, x["to"])["to"].alias("to"), (x["ends"] + F.get(then, x["to"])["ends"]).alias("ends")))


def _in_order(order: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


def _nothing() -> Column:
    return F.array(*[F.struct(F.lit(i).cast("int").alias("to"), F.lit(0).cast("long").alias("ends")) for i in range(3)])


def _running(rows: Column, begin: Column) -> Column:
    """The effect of all before each row, from ``begin`` on: array of struct(at, effect)."""
    empty = F.array().cast(f"array<struct<at:long,effect:{_EFFECT}>>")
    step = lambda acc, x: F.struct(composed(acc["now"], x["effect"]).alias("now"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["now"].alias("effect")))).alias("out"))
    return F.aggregate(rows, F.struct(begin.alias("now"), empty.alias("out")), step)["out"]


def begins(chunks: DataFrame) -> DataFrame:
    """(path, block, chunk, state, stmt) of chunks (path, block, chunk, effect): the state and the statement each begins in.

    Only effects are gathered: those of one block's chunks, and one for each block of a file.
    """
    blocks = chunks.select("path", "block", F.col("chunk").alias("at"), "effect").groupBy("path", "block").agg(_in_order("at", "effect").alias("rows"))
    whole = F.aggregate("rows", _nothing(), lambda acc, x: composed(acc, x["effect"]))
    files = blocks.select("path", F.col("block").alias("at"), whole.alias("effect")).groupBy("path").agg(_in_order("at", "effect").alias("rows"))
    entry = files.select("path", F.explode(_running(F.col("rows"), _nothing())).alias("e")).select("path", F.col("e.at").alias("block"), F.col("e.effect").alias("entry"))
    inner = blocks.join(entry, ["path", "block"]).select("path", "block", F.explode(_running(F.col("rows"), F.col("entry"))).alias("e"))
    # a file begins plain
    return inner.select("path", "block", F.col("e.at").alias("chunk"), F.get("e.effect", 0)["to"].alias("state"), F.get("e.effect", 0)["ends"].alias("stmt"))


def line_chunks(lines: DataFrame, size: int = 4096) -> DataFrame:
    """(path, block, chunk, line, text) of lines (path, block, id, value); ``id`` ascends along a block, ``line`` is the first line's number.

    A value may hold carriage returns, which end lines too.
    """
    rows = lines.withColumn("value", F.regexp_replace(F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""), "\r", "\n"))
    text = F.concat(F.array_join(F.transform(_in_order("id", "value"), lambda x: x["value"]), "\n"), F.lit("\n"))
    chunks = rows.groupBy("path", "block", F.floor(F.col("id") / size).alias("chunk")).agg(text.alias("text")).withColumn("n", newlines(F.col("text")))
    chunks = written(chunks, "chunks")
    blocks = chunks.groupBy("path", "block").agg(F.sum("n").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(earlier("path", "block")), F.lit(0)).alias("before"))
    within = chunks.select("path", "block", "chunk", F.coalesce(F.sum("n").over(earlier("path", "block", "chunk")), F.lit(0)).alias("inner"))
    place = within.join(blocks, ["path", "block"]).select("path", "block", "chunk", (F.col("before") + F.col("inner") + 1).alias("line"))
    return chunks.drop("n").join(place, ["path", "block", "chunk"])


def statement_units(chunks: DataFrame) -> DataFrame:
    """Units (path, unit, first, origin, text) of the statements of chunks (path, block, chunk, line, text).

    A unit is a statement's text up to its ';', from where the one before ends. Statements without any text give none.
    Repeated paths are not expected; an empty table has no units. A statement is the least that one task holds.
    """
    own = begins(chunks.select("path", "block", "chunk", effect(F.col("text")).alias("effect")))
    opener = F.get(F.array(*[F.lit(x) for x in _OPENERS]), F.col("state"))
    marked = F.transform(_pieces(F.concat(opener, F.col("text"))), lambda x: F.when(x == ";", _MARK).otherwise(F.replace(x, F.lit(_MARK), F.lit(" "))))
    joined = F.array_join(marked, "")
    # the opener is not the file's own
    cut = F.split(F.substring(joined, F.char_length(opener) + 1, F.char_length(joined)), _MARK, -1)
    parts = chunks.join(own, ["path", "block", "chunk"]).select("path", "block", "chunk", "line", "stmt", cut.alias("cut"))
    parts = parts.select("path", "block", "chunk", "line", "stmt", F.posexplode("cut").alias("k", "text"))
    earlier = Window.partitionBy("path", "block", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "block", "chunk", (F.col("stmt") + F.col("k")).alias("stmt"), "text", (F.col("line") + F.coalesce(F.sum(newlines(F.col("text"))).over(earlier), F.lit(0))).alias("line"))
    units = parts.groupBy("path", "stmt").agg(F.min("line").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk", "text"))), lambda x: x["text"]), "").alias("text"))
    return units.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("path", (F.col("stmt") + 1).cast("int").alias("unit"), F.col("first").cast("long").alias("first"), F.lit(None).cast("array<int>").alias("origin"), "text")
