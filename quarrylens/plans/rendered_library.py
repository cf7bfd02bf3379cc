"""Whole answers over a library rendered from customers and nations: programs, copies, calls, jobs, decks, DDL.

Where ``rendered`` asks one operator at a time, these queries index a library and ask the public queries, so closures,
joins of definitions and blind spots have to work together. The SQL tells the answers from the keys alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.storage import written
from quarrylens.functions.text import member_of

from .fields import boundary_fields, field_dependencies
from .index import Index, index_of
from .rendered import DDL, _table, _text, artifacts, fixed
from .tables import table_dependencies

_VIEW = "CREATE VIEW SHOP.BIG AS SELECT ORDER_ID, TOTAL FROM SHOP.ORDERS;\n"
_DCLGEN = ["    EXEC SQL DECLARE SHOP.ORDERS TABLE", "    ( ORDER_ID CHAR(10) NOT NULL, STATUS CHAR(1),", "      TOTAL DECIMAL(11,2) ) END-EXEC.", "01  DCLORD.", "    10 ORDER-ID  PIC X(10).", "    10 STATUS-X  PIC X.", "    10 TOTAL     PIC S9(9)V99 COMP-3."]


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts: a program and a job a customer, a deck and its job a nation, the DDL and a DCLGEN.

    By the customer's key: 0 mod 4 reads, 1 writes, 2 calls the program before it, 3 mod 8 calls that one, 7 mod 16 reads
    a view, 15 mod 16 reads another table and shares a data set with one customer in 97. Decks of even nations load the table.
    """
    rows = _table(spark, sf_dir, "customer", "c_custkey")
    key = F.col("c_custkey")
    host = _text(":WS-K", key % 7)
    pick = lambda a, b, c, d, e, f: F.when(key % 4 == 0, a).when(key % 4 == 1, b).when(key % 4 == 2, c).when(key % 8 == 3, d).when(key % 16 == 7, e).otherwise(f)
    before = _text("    CALL 'C", key - 1, "'.")
    code = [
        "IDENTIFICATION DIVISION.", _text("PROGRAM-ID. C", key, "."), "DATA DIVISION.", "WORKING-STORAGE SECTION.",
        F.when(key % 4 < 2, "    COPY DCLORD.").otherwise("01  WS-X PIC X."), _text("01  WS-K", key % 7, " PIC X(10)."), "PROCEDURE DIVISION.",
        pick("    EXEC SQL SELECT STATUS, TOTAL", "    EXEC SQL UPDATE SHOP.ORDERS", before, before, "    EXEC SQL SELECT TOTAL INTO :WS-X", "    EXEC SQL SELECT BRAND INTO :WS-X"),
        pick("      INTO :STATUS-X, :TOTAL FROM SHOP.ORDERS", "      SET TOTAL = :TOTAL, STATUS = 'FROM SHOP.GHOST'", _text("    CALL 'LOST", key % 10, "'."), "    CONTINUE.", "      FROM SHOP.BIG", "      FROM SHOP.PART"),
        pick(_text("      WHERE ORDER_ID = ", host, " END-EXEC."), "      WHERE ORDER_ID = :ORDER-ID END-EXEC.", "    CALL 'DFHEI1'.", "    CONTINUE.", "    END-EXEC.", "    END-EXEC."),
        "*    CALL 'GHOST'.", "    STOP RUN.",
    ]
    jcl = lambda job, *told: F.concat_ws("\n", _text("//", job, " JOB 1"), F.lit("//* EXEC PGM=C1"), *told)
    nations = _table(spark, sf_dir, "nation", "n_nationkey")
    n = F.col("n_nationkey")
    parts = [
        artifacts(rows, "SHOP.COBOL", _text("C", key), fixed(code)),
        artifacts(rows, "SHOP.JCL", _text("J", key), jcl(_text("J", key), _text("//S1 EXEC PGM=C", key), _text("//OUT DD DSN=DATA.D", key % 97, ",DISP=SHR"))),
        artifacts(nations, "SHOP.DECKS", _text("D", n), _text("LOAD DATA INTO TABLE SHOP.", F.when(n % 2 == 0, "ORDERS").otherwise("PART"), "\n (", F.when(n % 2 == 0, "ORDER_ID").otherwise("BRAND"), " POSITION(1) CHAR(10))\n")),
        artifacts(nations, "SHOP.JCL", _text("T", n), jcl(_text("T", n), F.lit("//L EXEC PGM=DSNUTILB"), _text("//SYSIN DD DSN=SHOP.DECKS(D", n, "),DISP=SHR"))),
        artifacts(spark.range(1), "SHOP.DDL", F.lit("SHOP.sql"), F.lit(DDL + _VIEW)),
        artifacts(spark.range(1), "SHOP.DCL", F.lit("DCLORD"), fixed(_DCLGEN)),
    ]
    return written(reduce(DataFrame.unionByName, parts), "answer")


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return index_of(library(spark, sf_dir))


def _facts(part: str, frame: DataFrame, member: Column | str, detail: Column, number: Column | str) -> DataFrame:
    told = [F.lit(x) if isinstance(x, str) else x for x in (part, member)]
    return frame.select(told[0].alias("part"), told[1].alias("member"), detail.alias("detail"), (F.lit(0) if number == "" else F.col(number)).cast("long").alias("number"))


def _answer(spark: SparkSession, sf_dir: str, include_read: bool) -> DataFrame:
    result = table_dependencies(_index(spark, sf_dir), "SHOP.ORDERS", include_read=include_read)
    f = result.frames
    words = lambda *names: F.concat_ws(" ", *names)
    parts = [
        _facts("target", f["targets"], F.col("table"), F.col("why"), ""),
        _facts("reference", f["refs"], F.col("member"), words("table", "access", "what", "kind"), "line"),
        _facts("program", f["programs"], F.col("name"), F.lit(""), "depth"),
        _facts("step", f["steps"], F.col("job"), words("step", "resolved_pgm", F.concat_ws(",", F.transform("decks", lambda d: d["dsn"])), F.concat_ws(",", F.transform("datasets", lambda d: d["dsn"]))), "line"),
        _facts("data", f["data_links"], F.col("job"), words("step", "dataset", "via_job"), "hop"),
        _facts("blind spot", f["blind_spots"], member_of(F.col("path")), words("kind", "detail"), "line"),
        *[_facts("note", x, "", F.col("note"), "") for x in result.notes_frames],
    ]
    return written(reduce(DataFrame.unionByName, parts), "answer")


def table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on a table: targets, references, programs with their call depth, steps with decks and data sets,
    steps linked by data, blind spots and notes."""
    return _answer(spark, sf_dir, True)


def table_query_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for what changes the table: references that only read, and what only they reach, are left out."""
    return _answer(spark, sf_dir, False)


def column_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table, their uses with the definitions of host variables, bindings, layout dependents, accesses, notes."""
    f = field_dependencies(_index(spark, sf_dir), "SHOP.ORDERS").frames
    home = F.when(F.col("host_def_path") != "", member_of(F.col("host_def_path"))).otherwise("")
    parts = [
        _facts("column", f["columns"], F.col("name"), F.concat_ws(" ", "table", "sql_type", "origin"), "seq"),
        _facts("use", f["uses"], F.col("member"), F.concat_ws("|", "column", "table", "access", "context", "stmt", "host_var", home, "host_def_line", "host_def_pic"), "line"),
        _facts("binding", f["bindings"], F.col("member"), F.concat_ws("|", "column", "table", "host_field", "pic"), "line"),
        _facts("layout", f["layout_dependents"], F.col("member"), F.col("why"), ""),
        _facts("access", f["table_access"], F.col("table"), F.concat_ws(",", "access"), ""),
        _facts("note", f["notes"], "", F.col("note"), ""),
        _facts("blind spot", f["blind_spots"], member_of(F.col("path")), F.concat_ws(" ", "kind", "detail"), "line"),
    ]
    return written(reduce(DataFrame.unionByName, parts), "answer")


def program_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each program exchanges with the table: a column's direction, host variables, picture and number of places."""
    result = field_dependencies(_index(spark, sf_dir), "SHOP.ORDERS")
    rows = written(boundary_fields(result, by_member=True), "answer")
    return rows.select("member", "table", "column", "direction", F.concat_ws(",", "host_vars").alias("host_vars"), "pic", F.size("provenance").alias("places"))


_KEYS = "c AS (SELECT c_custkey AS k FROM customer), n AS (SELECT n_nationkey AS k FROM nation)"
#: What depends on the table but for readers' references: ``near`` holds the keys of programs that do.
_DEPENDENTS = """
SELECT 'target' AS part, 'ORDERS' AS member, 'the table itself' AS detail, 0 AS number
UNION ALL SELECT 'target', 'BIG', 'view over SHOP.ORDERS', 0
UNION ALL SELECT 'reference', 'C' || k, 'ORDERS WRITE UPDATE COBOL', 8 FROM c WHERE k % 4 = 1
UNION ALL SELECT 'reference', 'D' || k, 'ORDERS WRITE LOAD INTO TABLE CONTROL', 1 FROM n WHERE k % 2 = 0
UNION ALL SELECT 'reference', 'SHOP', 'ORDERS DDL CREATE TABLE SQL', 1
UNION ALL SELECT 'reference', 'DCLORD', 'ORDERS DECLARE DECLARE TABLE DCLGEN', 1
UNION ALL SELECT 'program', 'C' || k, '', CASE WHEN k % 4 = 2 THEN 1 WHEN k % 8 = 3 THEN 2 ELSE 0 END FROM near
UNION ALL SELECT 'step', 'J' || k, 'S1 C' || k || '  DATA.D' || (k % 97), 3 FROM near
UNION ALL SELECT 'step', 'T' || k, 'L DSNUTILB SHOP.DECKS(D' || k || ') SHOP.DECKS(D' || k || ')', 3 FROM n WHERE k % 2 = 0
UNION ALL SELECT 'data', 'J' || c.k, 'S1 DATA.D' || d || ' ' || via || '/S1', 1 FROM c JOIN (SELECT k % 97 AS d, min('J' || k) AS via FROM near GROUP BY 1) v ON c.k % 97 = d WHERE c.k NOT IN (SELECT k FROM near)
UNION ALL SELECT 'blind spot', min('C' || k), 'UNRESOLVED-CALL CALL LOST' || (k % 10) || ': no source in the index', 9 FROM c WHERE k % 4 = 2 GROUP BY k % 10
UNION ALL SELECT 'note', '', count(*) || ' calls of IBM CICS modules: DFHEI1', 0 FROM c WHERE k % 4 = 2"""
_USES = """u AS (
SELECT 'C' || k AS member, x AS "column", 'ORDERS' AS t, a, w, s, CASE h WHEN 'WS-K' THEN 'WS-K' || (k % 7) ELSE h END AS h, CASE d WHEN 'own' THEN 'C' || k ELSE d END AS d, dl, dp, l FROM c JOIN (VALUES
('STATUS', 'READ', 'SELECT', 'SELECT', 'STATUS-X', 'DCLORD', 6, 'X', 8, 0), ('TOTAL', 'READ', 'SELECT', 'SELECT', 'TOTAL', 'DCLORD', 7, 'S9(9)V99 COMP-3', 8, 0), ('ORDER_ID', 'READ', 'WHERE', 'SELECT', 'WS-K', 'own', 6, 'X(10)', 10, 0),
('TOTAL', 'WRITE', 'SET', 'UPDATE', 'TOTAL', 'DCLORD', 7, 'S9(9)V99 COMP-3', 9, 1), ('STATUS', 'WRITE', 'SET', 'UPDATE', '', '', 0, '', 9, 1), ('ORDER_ID', 'READ', 'WHERE', 'UPDATE', 'ORDER-ID', 'DCLORD', 5, 'X(10)', 10, 1)) v(x, a, w, s, h, d, dl, dp, l, m) ON k % 4 = m
UNION ALL SELECT 'C' || k, 'TOTAL', 'BIG', 'READ', 'SELECT', 'SELECT', 'WS-X', 'C' || k, 5, 'X', 8 FROM c WHERE k % 16 = 7
UNION ALL SELECT 'D' || k, 'ORDER_ID', 'ORDERS', 'WRITE', 'LOAD', 'LOAD INTO TABLE', '', '', 0, '', 2 FROM n WHERE k % 2 = 0
UNION ALL SELECT 'SHOP', x, 'ORDERS', 'READ', 'SELECT', 'CREATE VIEW', '', '', 0, '', 3 FROM (VALUES ('ORDER_ID'), ('TOTAL')) v(x))"""
_SQL = {
    "table_query": f"WITH {_KEYS}, near AS (SELECT k FROM c WHERE k % 16 <> 15) {_DEPENDENTS} UNION ALL SELECT 'reference', 'C' || k, 'ORDERS READ SELECT COBOL', 9 FROM c WHERE k % 4 = 0 UNION ALL SELECT 'reference', 'C' || k, 'BIG READ SELECT COBOL', 9 FROM c WHERE k % 16 = 7 UNION ALL SELECT 'reference', 'SHOP', 'ORDERS READ SELECT SQL', 3",
    # readers that copy the declaration stay: its DECLARE is no read
    "table_query_writers": f"WITH {_KEYS}, near AS (SELECT k FROM c WHERE k % 8 <> 7) {_DEPENDENTS}",
    "column_query": f"""WITH {_KEYS}, {_USES} SELECT 'use' AS part, member, concat_ws('|', "column", t, a, w, s, h, d, dl, dp) AS detail, l AS number FROM u
UNION ALL SELECT 'column', x, 'ORDERS ' || y || ' CREATE TABLE', i FROM (VALUES ('ORDER_ID', 'CHAR(10) NOT NULL', 0), ('STATUS', 'CHAR(1)', 1), ('TOTAL', 'DECIMAL(11,2)', 2)) v(x, y, i)
UNION ALL SELECT 'binding', 'DCLORD', x, i FROM (VALUES ('ORDER_ID|ORDERS|ORDER-ID|X(10)', 5), ('STATUS|ORDERS|STATUS-X|X', 6), ('TOTAL|ORDERS|TOTAL|S9(9)V99 COMP-3', 7)) v(x, i)
UNION ALL SELECT 'layout', 'C' || k, 'COPY DCLORD', 0 FROM c WHERE k % 4 < 2
UNION ALL SELECT 'access', x, y, 0 FROM (VALUES ('ORDERS', 'DDL,DECLARE,READ,WRITE'), ('BIG', 'READ')) v(x, y)
UNION ALL SELECT 'note', '', 'BIG is a view over SHOP.ORDERS; its uses are reported under its own name', 0""",
    "program_boundaries": f"""WITH {_KEYS}, {_USES} SELECT member, t AS "table", "column", CASE WHEN a = 'WRITE' THEN 'out' WHEN w = 'WHERE' THEN 'filter' ELSE 'in' END AS direction, h AS host_vars, CASE WHEN t = 'BIG' THEN '' WHEN "column" = 'ORDER_ID' THEN 'X(10)' WHEN "column" = 'STATUS' THEN 'X' ELSE 'S9(9)V99 COMP-3' END AS pic, CAST(1 AS INT) AS places FROM u""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (table_query, table_query_writers, column_query, program_boundaries)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["library", "oracle_sql", "queries"]
