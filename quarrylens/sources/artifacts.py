"""Artifact libraries as rows: one per file, with its library, member, kind and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import decoded, library_of, masked, member_of
from quarrylens.operators.scripts import line_chunks, statement_units

#: Files above this many bytes are reported as CHUNKED; scripts among them are lexed in chunks, by many tasks.
CHUNK_THRESHOLD_BYTES = 8 << 20
#: Kinds whose text is a sequence of statements.
SCRIPTS = ["SQL", "CONTROL"]


def _roots(roots: str | list[str]) -> list[str]:
    return [roots] if isinstance(roots, str) else list(roots)


def list_artifacts(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """path, library, member, length, mtime and uri of every file under the roots; no file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_roots(roots))
    return rows.select("path", library_of(F.col("path")).alias("library"), member_of(F.col("path")).alias("member"), "length", F.col("modificationTime").alias("mtime"), F.col("_metadata.file_path").alias("uri"))


def _tolerant(reader: DataFrameReader) -> DataFrameReader:
    """Files that cannot be read, or are gone since they were listed, give what was read of them instead of an error."""
    return reader.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")


def _lines(spark: SparkSession, roots: list[str], above: int) -> DataFrame:
    """(uri, block, id, value) of the lines of files above so many bytes; Spark deals a file's bytes out in blocks."""
    rows = _tolerant(spark.read.format("text")).option("lineSep", "\n").load(roots).where(F.col("_metadata.file_size") > above)
    return rows.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def read_library(spark: SparkSession, roots: str | list[str], wanted: DataFrame | None = None, threshold: int = CHUNK_THRESHOLD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, units). files: path, library, member, length, mtime, text, kind, error, chunked; units as the lexer takes them.

    ``wanted`` (path) picks files. A file that cannot be read has null text, kind UNKNOWN and an error; so has one of
    which fewer bytes came than it is long. Files above ``threshold`` bytes are read as lines, in blocks. Those that are
    scripts by their first chunk have null text and are ``chunked``: their statements are among the units. Others of that
    size are put together again. Empty files have the empty text; no files give no rows.
    """
    roots = _roots(roots)
    listed = list_artifacts(spark, roots)
    listed = written(listed if wanted is None else listed.join(wanted.select("path"), "path", "left_semi"), "listed")
    content = _tolerant(spark.read.format("binaryFile")).load(roots).where(F.col("length") <= threshold).select("path", "content")
    small = with_text(listed.where(F.col("length") <= threshold).join(content, "path", "left"))
    small = small.drop("uri").withColumns({"error": F.when(F.col("text").isNull(), "content could not be read"), "chunked": F.lit(False)})
    big = listed.where(F.col("length") > threshold)
    columns = [c for c in listed.columns if c != "uri"]
    if not big.limit(1).count():
        return small, no_units(spark)
    found = written(_lines(spark, roots, threshold).join(big.select("uri", "path"), "uri").drop("uri"), "lines")
    # each line but perhaps the last ended in a line feed
    size = found.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    whole = big.join(size, "path").where("bytes - length in (0, 1)").select("path")
    chunks = written(line_chunks(found.join(whole, "path", "left_semi")), "chunks")
    heads = chunks.groupBy("path").agg(F.min_by("text", F.struct("block", "chunk")).alias("head"))
    heads = heads.select("path", masked(F.col("head")).alias("bare"))
    heads = written(heads.select("path", kind_of(F.col("bare"), F.col("path")).alias("kind")), "heads")
    scripts = heads.where(F.col("kind").isin(*SCRIPTS))
    rest = chunks.join(heads.join(scripts, "path", "left_anti"), "path", "left_semi").groupBy("path")
    rest = rest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk", "text"))), lambda x: x["text"]), "").alias("text"))
    large = big.join(heads, "path", "left").join(rest, "path", "left")
    chunked = F.coalesce(F.col("kind").isin(*SCRIPTS), F.lit(False))
    error = F.when(F.col("kind").isNull(), "content could not be read")
    large = large.select(*columns, "text", F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), error.alias("error"), chunked.alias("chunked"))
    return small.unionByName(large), statement_units(chunks.join(scripts, "path", "left_semi"))


def no_units(spark: SparkSession) -> DataFrame:
    """No statements, in the columns that the lexer takes."""
    return spark.createDataFrame([], "path string, unit int, first long, origin array<int>, text string")


def read_artifacts(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """path, library, member, length, mtime, content of every file under the roots, each file in one row; content null if it cannot be read."""
    content = _tolerant(spark.read.format("binaryFile")).load(_roots(roots)).select("path", "content")
    return list_artifacts(spark, roots).drop("uri").join(content, "path", "left")


def kind_of(text: Column, path: Column) -> Column:
    """What a file is, by its text, then by its name: COBOL, COPYBOOK, DCLGEN, SQL, JCL, PROC, CONTROL, SORT, BIND or UNKNOWN.

    A file is JCL by its `//` lines, a procedure if a PROC statement comes before any JOB; COBOL by its divisions;
    a DCLGEN by a table declaration without divisions; a copybook by level numbers with PIC or a name; decks by
    their first control statement; SQL by its first statement or extension.
    """
    first = F.regexp_extract(F.regexp_replace(text, r"(?s)^(?:\s|--[^\n]*(?:\n|$)|\*[^\n]*(?:\n|$))+", ""), r"^\s*([A-Za-z]+)", 1)
    first = F.upper(first)
    jcl = text.rlike(r"(?m)^//[A-Z0-9@#$]*\s+(?:JOB|EXEC|PROC|DD|JCLLIB|PEND)\b")
    job = text.rlike(r"(?m)^//[A-Z0-9@#$]+\s+JOB\b")
    level = r"(?im)^.{0,7}\s*\d{1,2}\s+[A-Z0-9][A-Z0-9-]*(?:\.|\s+(?:PIC|REDEFINES|OCCURS|USAGE|COMP|VALUE))"
    return (
        F.when(jcl & job, "JCL")
        .when(jcl & text.rlike(r"(?m)^//[A-Z0-9@#$]*\s+PROC\b"), "PROC")
        .when(jcl, "JCL")
        .when(text.rlike(r"(?i)\b(?:IDENTIFICATION|ID)\s+DIVISION\b|\bPROCEDURE\s+DIVISION\b|\bPROGRAM-ID\b"), "COBOL")
        .when(text.rlike(r"(?i)\bDECLARE\s+[\w.@#$\"]+\s+TABLE\b") & text.rlike(r"(?i)\bEXEC\s+SQL\b"), "DCLGEN")
        .when(F.lower(path).rlike(r"\.(?:sql|ddl|spsql)$"), "SQL")
        .when(first.isin("LOAD", "UNLOAD", "REORG", "RUNSTATS", "COPY", "QUIESCE", "CHECK", "RECOVER", "REBUILD", "REPAIR", "MODIFY", "TEMPLATE", "LISTDEF", "OPTIONS") & text.rlike(r"(?i)\b(?:TABLE|TABLESPACE|INDEX|LIST|DSN|EVENT)\b"), "CONTROL")
        .when(first.isin("SORT", "MERGE", "OUTFIL", "OUTREC", "INREC", "INCLUDE", "OMIT", "OPTION", "JOINKEYS", "SUM") & text.rlike(r"(?i)\b(?:FIELDS|FNAMES|COND|COPY|BUILD|OVERLAY)\s*="), "SORT")
        .when(first.isin("BIND", "REBIND", "FREE") | (first.isin("DSN") & text.rlike(r"(?i)\b(?:BIND|REBIND)\b")), "BIND")
        .when(first.isin("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "DECLARE", "WITH", "GRANT", "SET", "COMMENT", "LOCK", "BEGIN", "REVOKE"), "SQL")
        .when(text.rlike(level), "COPYBOOK")
        .otherwise("UNKNOWN")
    )


def with_text(rows: DataFrame) -> DataFrame:
    """Adds text and kind; content is dropped. Null content is an unreadable file: text stays null, kind UNKNOWN."""
    rows = rows.withColumn("text", decoded(F.col("content"))).drop("content")
    # a column of its own: each test of the kind reads the masked text, which is made once
    rows = rows.withColumn("bare", masked(F.col("text")))
    return rows.withColumn("kind", F.when(F.col("text").isNotNull(), kind_of(F.col("bare"), F.col("path"))).otherwise("UNKNOWN")).drop("bare")
