"""JCL and procedures: statements, steps, data sets, decks, instream text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import dsn_parts

#: Programs that run SQL and utility statements from instream data.
SQL_RUNNERS = ["DSNTEP2", "DSNTEP4", "DSNTIAD", "DSNTIAUL"]
UTILITY_RUNNERS = ["DSNUTILB", "DSNUTILS", "DSNUTILU", "DSNUPROC"]


def jcl_lines(files: DataFrame) -> DataFrame:
    """One row per line of JCL and PROC files: line, code, and for statements name, op, operands; in_step, in_dd, stream.

    Comments are dropped and continued operands joined to their statement. ``stream`` marks instream data lines,
    which belong to the DD before them.
    """
    rows = files.where(F.col("kind").isin("JCL", "PROC")).select("path", "member", F.posexplode(F.split("text", "\n", -1)).alias("at", "code"))
    rows = rows.withColumn("line", F.col("at") + 1).where(~F.col("code").startswith("//*"))
    statement = F.col("code").startswith("//")
    order = Window.partitionBy("path").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    head = r"^//([A-Z0-9@#$.]*)\s+(JOB|EXEC|DD|PROC|PEND|JCLLIB|SET|INCLUDE|IF|ELSE|ENDIF|OUTPUT)\b\s*(.*)$"
    op = F.regexp_extract("code", head, 2)
    rows = rows.withColumn("statement", statement & (op != "")).withColumn("name", F.when(F.col("statement"), F.upper(F.regexp_extract("code", head, 1)))).withColumn("op", F.when(F.col("statement"), F.upper(op)))
    # instream data runs from a DD * or DD DATA to /* or the next //
    opens = F.col("statement") & (F.col("op") == "DD") & F.regexp_extract("code", head, 3).rlike(r"^(?:\*|DATA)(?:[,\s]|$)")
    mark = F.when(opens, "open").when(statement | F.col("code").startswith("/*"), "shut")
    rows = rows.withColumn("stream", (F.last(mark, ignorenulls=True).over(upto) == "open") & ~statement & ~F.col("code").startswith("/*"))
    # a statement's number; its continuations are // lines with blanks and no operation
    rows = rows.withColumn("stmt", F.sum(F.col("statement").cast("int")).over(upto)).where(F.col("statement") | F.col("stream") | (statement & F.col("code").rlike(r"^//\s+\S")))
    return rows.withColumn("operands", F.when(F.col("statement"), F.regexp_extract("code", head, 3)).when(~F.col("stream"), F.regexp_extract("code", r"^//\s+(.*)$", 1)))


def steps_and_dds(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, dds, streams).

    steps: path, job, step, seq, pgm, proc, resolved_pgm, line. dds: path, job, step, seq, dd, dsn, disp, base, tail,
    is_member. streams: path, job, step, seq, dd, first, text of instream data. A step of a procedure has the
    procedure's name as job. resolved_pgm is the program that a TSO step runs, else pgm.
    """
    # one shuffle by path serves the statements and the windows over a file; steps and data sets both read what comes out
    joined = lines.where(~F.col("stream")).repartition("path").groupBy("path", "stmt").agg(F.first("member").alias("member"), F.min("line").alias("line"), F.min_by("name", "line").alias("name"), F.min_by("op", "line").alias("op"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "operands"))), lambda x: F.regexp_replace(x["operands"], r"\s.*$", "")), "").alias("operands"))
    order = Window.partitionBy("path").orderBy("stmt").rowsBetween(Window.unboundedPreceding, 0)
    rows = joined.withColumn("job", F.last(F.when(F.col("op").isin("JOB", "PROC") & (F.col("name") != ""), F.col("name")), ignorenulls=True).over(order))
    rows = rows.withColumn("seq", F.sum((F.col("op") == "EXEC").cast("int")).over(order)).withColumn("step", F.last(F.when(F.col("op") == "EXEC", F.col("name")), ignorenulls=True).over(order))
    rows = rows.withColumn("dd", F.last(F.when((F.col("op") == "DD") & (F.col("name") != ""), F.col("name")), ignorenulls=True).over(order))
    rows = written(rows.withColumn("job", F.coalesce("job", "member")).drop("member"), "statements")
    pgm = F.upper(F.regexp_extract("operands", r"(?i)\bPGM=([A-Z0-9@#$*.]+)", 1))
    proc = F.upper(F.regexp_extract("operands", r"(?i)^(?:PROC=)?([A-Z0-9@#$]+)", 1))
    execs = rows.where("op = 'EXEC'").select("path", "job", "step", "seq", pgm.alias("pgm"), F.when(pgm == "", proc).otherwise("").alias("proc"), "line")
    dsn = F.regexp_extract("operands", r"(?i)\bDSN(?:AME)?=('[^']*'|[^,(]+(?:\([^)]*\))?)", 1)
    disp = F.regexp_extract("operands", r"(?i)\bDISP=(\([^)]*\)|[A-Z]+)", 1)
    dds = rows.where("op = 'DD' and seq > 0").select("path", "job", "step", "seq", "dd", F.replace(dsn, F.lit("'"), F.lit("")).alias("dsn"), disp.alias("disp")).where("dsn <> ''")
    dds = dds.withColumn("d", dsn_parts(F.col("dsn"))).select("*", "d.base", "d.tail", "d.is_member").drop("d")
    text = lines.where("stream").groupBy("path", "stmt").agg(F.min("line").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda x: F.substring(x["code"], 1, 72)), "\n").alias("text"))
    streams = text.join(rows.select("path", "stmt", "job", "step", "seq", "dd"), ["path", "stmt"])
    run = streams.where("dd = 'SYSTSIN'").groupBy("path", "seq").agg(F.max(F.upper(F.regexp_extract("text", r"(?i)\bRUN\s+PROG(?:RAM)?\s*\(\s*([A-Z0-9@#$]+)", 1))).alias("run"))
    steps = execs.join(run, ["path", "seq"], "left").withColumn("resolved_pgm", F.when(F.coalesce("run", F.lit("")) != "", F.col("run")).otherwise(F.col("pgm"))).drop("run")
    return steps.select("path", "job", "step", "seq", "pgm", "proc", "resolved_pgm", "line"), dds, streams


def stream_units(streams: DataFrame, steps: DataFrame) -> DataFrame:
    """Units (path, unit, first, origin, text) of instream SQL and utility statements: only under programs that read them."""
    readers = steps.where(F.col("resolved_pgm").isin(*SQL_RUNNERS) | F.col("pgm").isin(*UTILITY_RUNNERS, *SQL_RUNNERS))
    found = streams.where("dd in ('SYSIN', 'SYSPUNCH')").join(readers.select("path", "seq"), ["path", "seq"]).withColumnRenamed("first", "begin")
    return found.select("path", (F.lit(100_000) + F.col("stmt")).cast("int").alias("unit"), F.lit(1).cast("long").alias("first"), F.transform(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1), lambda i: (i + F.col("begin")).cast("int")).alias("origin"), "text")


def deck_references(dds: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decks, unresolved): DDs that name a member, joined on library and member; and members of deck libraries found nowhere.

    A member is only wired to the library that the DD names. ``unresolved`` also tells of decks of the same member
    name in other libraries, which stay apart.
    """
    members = dds.where(F.col("is_member"))
    decks = files.where(F.col("kind").isin("CONTROL", "SORT", "SQL", "BIND", "UNKNOWN")).select(F.col("path").alias("deck_path"), "library", "member", F.col("kind").alias("deck_kind"))
    wired = members.join(decks, (members["base"] == decks["library"]) & (members["tail"] == decks["member"]))
    found = wired.select("path", "job", "step", "seq", "dd", "dsn", "deck_kind", "deck_path")
    missing = members.where(F.col("dd").isin("SYSIN", "SYSTSIN", "SORTCNTL", "TOOLIN")).join(decks, (members["base"] == decks["library"]) & (members["tail"] == decks["member"]), "left_anti").select("path", "dsn", "tail")
    near = decks.select(F.col("member").alias("tail"), "library").groupBy("tail").agg(F.sort_array(F.collect_set("library")).alias("elsewhere"))
    lost = missing.distinct().join(near, "tail", "left").select("path", F.concat(F.col("dsn"), F.lit(" is not in the index"), F.when(F.col("elsewhere").isNotNull(), F.concat(F.lit("; same member in "), F.array_join("elsewhere", ", "))).otherwise("")).alias("detail"))
    # decks that no step names, though some step names their member in another library
    named = found.select("deck_path").distinct()
    taken = members.select("tail", "base").distinct()
    apart = decks.where("deck_kind = 'CONTROL'").join(named, "deck_path", "left_anti").join(taken, (decks["member"] == taken["tail"]) & (decks["library"] != taken["base"]))
    orphan = apart.select(F.col("deck_path").alias("path"), F.concat(F.lit("no step names "), "library", F.lit("("), "member", F.lit("); steps name "), "base", F.lit("("), "member", F.lit(")")).alias("detail"))
    return found, lost.unionByName(orphan)
