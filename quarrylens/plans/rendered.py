"""Queries over artifacts rendered from table rows, with SQL that tells the expected facts from the columns alone.

The engine has to parse what it is given: comments, literals, continuations and text beyond column 72 name tables
and columns that must not come out. Each rendering is a projection, so the rows are read once and in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.storage import FILES_A_TASK, spread, written
from quarrylens.functions.text import dsn_parts, library_of, masked, member_of
from quarrylens.functions.vendor import classified
from quarrylens.operators import definitions, jobs, lexer, lines, references, scripts, texts
from quarrylens.operators.uses import column_uses
from quarrylens.sources.artifacts import with_text

from .fields import copybook_closure
from .tables import call_closure, data_links, dependent_steps, expanded_targets

DDL = "CREATE TABLE SHOP.ORDERS (ORDER_ID CHAR(10) NOT NULL, STATUS CHAR(1), TOTAL DECIMAL(11,2));\nCREATE TABLE SHOP.PART (PART_ID INTEGER NOT NULL, BRAND CHAR(10), TYPE VARCHAR(25));\n"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def fixed(code: list[Column | str]) -> Column:
    """Fixed-format source: numbers in 1-6, '*' or '~' (continuation) at the head of a line sets column 7, a table's name in 73-80."""
    rows = []
    for i, line in enumerate(code, 1):
        mark = {"*": "*", "~": "-"}.get(line[:1], " ") if isinstance(line, str) else " "
        body = F.lit(line[1:] if mark != " " else line) if isinstance(line, str) else line
        # code that would run beyond column 72 is an error of the rendering, not a shorter line
        body = F.when(F.char_length(body) <= 65, F.rpad(body, 65, " ")).otherwise(F.raise_error(F.concat(F.lit("beyond column 72: "), body)))
        rows.append(F.concat(F.lit(f"{i * 100:06d}{mark}"), body, F.lit("GHOSTTAB")))
    return F.concat_ws("\r\n", *rows)


def artifacts(rows: DataFrame, library: str, member: Column, text: Column) -> DataFrame:
    """path, library, member, length, text and kind of one artifact a row."""
    path = F.concat(F.lit(f"/{library}/"), member)
    found = rows.select(path.alias("path"), library_of(path).alias("library"), member_of(path).alias("member"), text.cast("binary").alias("content"))
    return with_text(found.withColumn("length", F.length("content").cast("long")))


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _dealt(rows: DataFrame, key: str, lines_each: int) -> DataFrame:
    """``rows``, over as many tasks as the source rendered from them needs: they are dealt out before it is made of them, as they are small."""
    return spread(rows, key, size=F.lit(82 * lines_each), per_task=FILES_A_TASK)


def _script(spark: SparkSession, text: str) -> DataFrame:
    return artifacts(spark.range(1), "SHOP.DDL", F.lit("SHOP.sql"), F.lit(text))


def _units(files: DataFrame, embedded: bool) -> DataFrame:
    if embedded:
        return lines.embedded_sql(lines.cobol_blobs(files.select("path", "text"))).select("path", "unit", F.col("first").cast("long").alias("first"), "origin", "text")
    return files.select("path", F.lit(0).alias("unit"), F.lit(1).cast("long").alias("first"), F.lit(None).cast("array<int>").alias("origin"), "text")


def _references(units: DataFrame) -> DataFrame:
    """Table references of units; of their tokens those alone are written that refer to a table."""
    toks = lexer.placed(lexer.structured(lexer.tokens(units)))
    return references.table_references(written(references.reference_tokens(toks), "names"))


def _placed(units: DataFrame) -> DataFrame:
    """Placed tokens, written, as many joins read them."""
    return written(lexer.placed(lexer.structured(lexer.tokens(units))), "tokens")


def _tokens(files: DataFrame, embedded: bool = False) -> DataFrame:
    """Placed tokens of SQL scripts and decks, or of the statements embedded in COBOL."""
    return _placed(_units(files, embedded))


def _uses(spark: SparkSession, files: DataFrame, embedded: bool = False, contexts: list[str] | None = None) -> DataFrame:
    script, units, kept = _script(spark, DDL), _units(files, embedded), None
    if contexts is not None and "FETCH" not in contexts:
        kept, units = texts.told_apart(units)
    toks = _placed(units.unionByName(_units(script, False)))
    declared = F.col("path") == "/SHOP.DDL/SHOP.sql"
    known = written(definitions.known_columns(definitions.defined_columns(toks.where(declared)), script), "known")
    uses = written(column_uses(toks.where(~declared), known, contexts)[0], "uses")
    uses = uses if kept is None else texts.handed_out(kept, uses)
    return uses.withColumn("member", member_of(F.col("path"))).select("member", "column", "table", "access", "context", "host_var", "line")


def order_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program an order: its status picks SELECT INTO, UPDATE or INSERT."""
    rows = _dealt(_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey", 11)
    host = _text(":WS-K", F.col("o_orderkey") % 7)
    pick = lambda f, o, p: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", o).otherwise(p)
    first = pick("SELECT STATUS, TOTAL INTO :WS-STATUS, :WS-TOTAL", "UPDATE SHOP.ORDERS SET TOTAL = :WS-TOTAL", "INSERT INTO SHOP.ORDERS (ORDER_ID, TOTAL)")
    second = pick(_text("FROM SHOP.ORDERS WHERE ORDER_ID = ", host), _text("WHERE ORDER_ID = ", host), _text("VALUES (", host, ", :WS-TOTAL)"))
    code = ["IDENTIFICATION DIVISION.", _text("PROGRAM-ID. P", F.col("o_orderkey"), "."), "*  SELECT GHOST FROM SHOP.GHOST", "WORKING-STORAGE SECTION.", "01  WS-T PIC X(30) VALUE 'FROM SHOP.GHOST'.", "PROCEDURE DIVISION.", "    EXEC SQL", _text("  ", first), _text("  ", second), "    END-EXEC.", "    STOP RUN."]
    return artifacts(rows, "SHOP.COBOL", _text("P", F.col("o_orderkey")), fixed(code))


def mask_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("A '", F.col("p_name"), "''' B -- ", F.col("p_type"), "\nC /* ", F.col("p_brand"), "\n*/ D")
    return _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand").select("p_partkey", masked(text).alias("masked"))


def cobol_logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_type")
    files = artifacts(rows, "L", _text("M", F.col("p_partkey")), F.concat(fixed(["*  COMMENT", _text("MOVE LOW-", F.col("p_type"))]), F.lit("\r\n"), F.lit("000300-    "), F.rpad(_text("-X", F.col("p_partkey"), " TO Y."), 61, " "), F.lit("GHOSTTAB\r\n000400 STOP RUN.")))
    return lines.cobol_blobs(files).select("member", "blob", F.array_join(F.col("origin").cast("array<string>"), ",").alias("origin"))


def paren_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    deep = (F.col("p_size") % 6 + 1).cast("int")
    files = artifacts(rows, "L", _text("M", F.col("p_partkey"), ".sql"), _text("SELECT ", F.repeat(F.lit("F("), deep), "A, ')'", F.repeat(F.lit(")"), deep), ", B FROM SHOP.T;"))
    return _tokens(files).groupBy(member_of(F.col("path")).alias("member")).agg(F.max("level").alias("deepest"), F.max(F.when(F.col("grp") == -1, F.col("slot"))).alias("commas"))


def _order_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_references(_units(order_programs(spark, sf_dir), True)), "refs")


def table_refs_by_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_refs(spark, sf_dir).groupBy("schema", "table_name", "access", "stmt_name").agg(F.count("*").alias("refs"))


def writers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_refs(spark, sf_dir).where("access <> 'READ'").select(member_of(F.col("path")).alias("member"), "stmt_name", "line")


def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_refs(spark, sf_dir).where(F.col("table_name").like("ORD%")).groupBy("schema", "table_name").agg(F.count("*").alias("refs"))


def _order_uses(context: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _uses(spark, order_programs(spark, sf_dir), embedded=True, contexts=[context])

    return query


def group_order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    name = F.when(F.col("p_size") % 2 == 0, "TYPE").otherwise("BRAND")
    files = artifacts(rows, "L", _text("M", F.col("p_partkey"), ".sql"), _text("SELECT COUNT(*) FROM SHOP.PART -- ORDER BY GHOST\nGROUP BY ", name, "\nORDER BY ", name, " DESC, 1;"))
    return _uses(spark, files, contexts=["GROUP BY", "ORDER BY"]).select("member", "column", "context", "line")


def cursor_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(_table(spark, sf_dir, "customer", "c_custkey"), "c_custkey", 8)
    code = ["IDENTIFICATION DIVISION.", _text("PROGRAM-ID. C", F.col("c_custkey"), "."), "PROCEDURE DIVISION.", "    EXEC SQL DECLARE CUR1 CURSOR FOR", "      SELECT ORDER_ID, TOTAL FROM SHOP.ORDERS END-EXEC.", "    EXEC SQL OPEN CUR1 END-EXEC.", "    EXEC SQL FETCH CUR1", _text("      INTO :ID-", F.col("c_custkey"), ", :TOT END-EXEC.")]
    return _uses(spark, artifacts(rows, "L", _text("C", F.col("c_custkey")), fixed(code)), embedded=True, contexts=["FETCH"]).select("member", "column", "host_var", "line")


def deck_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    files = artifacts(rows, "L", _text("D", F.col("s_suppkey")), F.when(F.col("s_suppkey") % 2 == 0, "LOAD DATA INDDN SYSREC INTO TABLE SHOP.ORDERS\n (ORDER_ID POSITION(1) CHAR(10), TOTAL POSITION(11) DECIMAL)\n").otherwise("LOAD DATA INDDN SYSREC INTO TABLE SHOP.ORDERS\n"))
    return _uses(spark, files, contexts=["LOAD"]).select("member", "column", "access")


def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    items = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_size") % 5).cast("int")), lambda i: F.concat(F.lit("C"), i.cast("string"), F.when(i == 0, " CHAR(3) NOT NULL").otherwise(" DECIMAL(9,2)"))), ",\n")
    files = artifacts(rows, "L", _text("M", F.col("p_partkey"), ".sql"), _text("CREATE TABLE SHOP.T", F.col("p_partkey"), " (", items, ",\nPRIMARY KEY (C0));"))
    return written(definitions.defined_columns(_tokens(files)), "defined").select("table", "name", F.col("seq").cast("int").alias("seq"), "sql_type", "nullable", "origin")


def dclgen_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    code = [_text("    EXEC SQL DECLARE SHOP.S", F.col("s_suppkey"), " TABLE"), "    ( SUPP_ID CHAR(8) NOT NULL, S_NAME VARCHAR(40),", "      BAL DECIMAL(9,2) ) END-EXEC.", "01  DCLSUPP.", "    10 SUPP-ID   PIC X(8).", "    10 S-NAME.", "       49 S-NAME-LEN  PIC S9(4) COMP.", "       49 S-NAME-TEXT PIC X(40).", "    10 BALANCE-X  PIC S9(7)V99 COMP-3."]
    files = artifacts(rows, "L", _text("DCL", F.col("s_suppkey")), fixed(code))
    items = definitions.data_items(lines.cobol_blobs(files))
    found, _ = definitions.host_bindings(items, definitions.defined_columns(_tokens(files, embedded=True)), files)
    return found.select("table", "column", "host_field", "pic", "line")


def call_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = lambda name, callee: fixed(["IDENTIFICATION DIVISION.", _text("PROGRAM-ID. ", name, "."), "PROCEDURE DIVISION.", "*    CALL 'GHOST'.", _text("    CALL '", callee, "'."), "    STOP RUN."])
    parts = [artifacts(_table(spark, sf_dir, t, *cols), "L", name, program(name, callee)) for t, cols, name, callee in (
        ("region", ["r_regionkey"], _text("R", F.col("r_regionkey")), F.lit("BASE")),
        ("nation", ["n_nationkey", "n_regionkey"], _text("N", F.col("n_nationkey")), _text("R", F.col("n_regionkey"))),
        ("customer", ["c_custkey", "c_nationkey"], _text("C", F.col("c_custkey")), _text("N", F.col("c_nationkey"))),
    )]
    blobs = lines.cobol_blobs(reduce(DataFrame.unionByName, parts))
    names = definitions.programs(blobs)
    edges = definitions.calls(blobs).join(names.withColumnRenamed("name", "caller"), "path").select("caller", "callee")
    edges = written(edges, "edges")
    return call_closure(edges, spark.createDataFrame([("R1",)], "name string"))


def vendor_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    callee = F.when(F.col("event_type") == "click", "DFHEI1").when(F.col("event_type") == "view", "CEEDATE").otherwise(_text("APP", F.col("user_id") % 10))
    files = artifacts(rows, "L", _text("E", F.col("event_id")), fixed(["IDENTIFICATION DIVISION.", "PROCEDURE DIVISION.", _text("    CALL '", callee, "' USING X."), "*    CALL 'GHOST'."]))
    return classified(definitions.calls(lines.cobol_blobs(files)), "callee").groupBy("callee", F.col("vendor.label").alias("label")).agg(F.count("*").alias("calls"))


def _event_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    text = F.concat_ws("\n", _text("//J", F.col("event_id"), " JOB (ACCT),'X'"), F.lit("//* EXEC PGM=GHOST"), _text("//S1 EXEC PGM=", F.upper("event_type")), _text("//IN DD DSN=DATA.U", F.col("user_id"), "(+1),"), F.lit("//      DISP=(NEW,CATLG)"), F.lit("//SYSPRINT DD SYSOUT=*"))
    files = artifacts(rows, "L", _text("J", F.col("event_id")), text)
    steps, dds, _ = jobs.steps_and_dds(written(jobs.jcl_lines(files), "jcl"), files)
    return steps, dds


def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, dds = _event_jobs(spark, sf_dir)
    found = written(steps.join(dds.select("path", "seq", "dd", "base", "disp", "is_member"), ["path", "seq"]), "job_steps")
    return found.select("job", "step", "resolved_pgm", "dd", "base", "disp", "is_member", "line")


def dataset_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, dds = (written(x, "jobs") for x in _event_jobs(spark, sf_dir))
    empty = spark.createDataFrame([], "path string, seq long, dd string, dsn string, deck_kind string, deck_path string")
    found = data_links(SimpleNamespace(dds=dds), steps.where("resolved_pgm = 'ERROR'"), empty, 1)
    return found.select("job", "step", "dataset", "hop")


def view_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    files = artifacts(rows, "L", _text("V", F.col("n_nationkey"), ".sql"), _text("CREATE VIEW SHOP.V", F.col("n_nationkey"), " AS SELECT A FROM SHOP.R", F.col("n_regionkey"), " WHERE B = 'SHOP.R1';\nCREATE SYNONYM Y", F.col("n_nationkey"), " FOR SHOP.V", F.col("n_nationkey"), ";"))
    return expanded_targets(SimpleNamespace(spark=spark, objects=written(references.objects(_tokens(files)), "objects")), "SHOP.R1")


def merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MERGE a supplier; the size of its key picks the UPDATE's column."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    column = F.when(F.col("s_suppkey") % 2 == 0, "STATUS").otherwise("TOTAL")
    text = _text("MERGE INTO SHOP.ORDERS AS O USING SHOP.PART AS P -- SHOP.GHOST\n ON O.ORDER_ID = P.BRAND\n WHEN MATCHED THEN UPDATE SET ", column, " = 'SET GHOST = 1'\n WHEN NOT MATCHED THEN INSERT (ORDER_ID, TOTAL) VALUES (P.BRAND, 0);")
    files = artifacts(rows, "L", _text("G", F.col("s_suppkey"), ".sql"), text)
    return _uses(spark, files).where("access = 'WRITE' or context = 'ON'").select("member", "column", "table", "access", "context", "line")


def union_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch of a UNION reads its own table."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    files = artifacts(rows, "L", _text("U", F.col("s_suppkey"), ".sql"), _text("SELECT STATUS FROM SHOP.ORDERS WHERE TOTAL > ", F.col("s_suppkey"), "\nUNION ALL SELECT BRAND FROM SHOP.PART\nUNION SELECT TYPE FROM SHOP.PART;"))
    return _uses(spark, files, contexts=["SELECT", "WHERE"]).select("member", "column", "table", "context", "line")


def star_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star stands for all columns, a qualified one for those of its own table."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    text = F.when(F.col("s_suppkey") % 2 == 0, "SELECT * FROM SHOP.ORDERS;").otherwise("SELECT P.*, O.STATUS FROM SHOP.ORDERS O JOIN SHOP.PART P ON P.BRAND = O.STATUS;")
    files = artifacts(rows, "L", _text("S", F.col("s_suppkey"), ".sql"), text)
    return _uses(spark, files, contexts=["SELECT"]).select("member", "column", "table")


def insert_from_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the SELECT of an INSERT belong to the SELECT's tables; those of the list are written."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    files = artifacts(rows, "L", _text("I", F.col("s_suppkey"), ".sql"), _text("INSERT INTO SHOP.ORDERS (ORDER_ID, STATUS)\n SELECT BRAND, TYPE FROM SHOP.PART WHERE PART_ID = ", F.col("s_suppkey"), ";"))
    return _uses(spark, files, contexts=["SELECT", "WHERE", "INSERT"]).select("member", "column", "table", "access", "context", "line")


def undefined_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the table's definition lacks are told where the block has one table; a routine's parameter is not."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    text = F.when(key % 3 == 0, "SELECT GONE FROM SHOP.ORDERS WHERE GONE = :X\n ORDER BY GONE;").when(key % 3 == 1, "DELETE FROM SHOP.ORDERS WHERE GONE IS NULL;").otherwise(_text("UPDATE SHOP.ORDERS SET STATUS = 'A'\n WHERE GONE IN (:H1, :H", key, ") AND TOTAL = PARM;"))
    return _uses(spark, artifacts(rows, "L", _text("N", key, ".sql"), text)).select("member", "column", "access", "context", "host_var", "line")


def tuple_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and values of SET (a, b) = (x, y) are paired by place; those of a SELECT belong to its own table."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    text = F.when(key % 2 == 0, _text("UPDATE SHOP.ORDERS SET (STATUS, TOTAL) = (:S", key, ", :T), ORDER_ID = :K\n WHERE STATUS = 'A';")).otherwise("UPDATE SHOP.ORDERS SET (STATUS, TOTAL) =\n (SELECT TYPE, PART_ID FROM SHOP.PART WHERE BRAND = :B);")
    return _uses(spark, artifacts(rows, "L", _text("Z", key, ".sql"), text)).select("member", "column", "table", "access", "context", "host_var", "line")


def outer_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated subqueries: a qualifier of a block around, one or two levels out, names that block's table."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    one = _text("DELETE FROM SHOP.ORDERS O\n WHERE EXISTS (SELECT 1 FROM SHOP.PART P\n WHERE P.BRAND = O.ORDER_ID AND O.TOTAL > :T", key, ");")
    two = F.lit("SELECT O.STATUS FROM SHOP.ORDERS O WHERE ORDER_ID IN (SELECT BRAND FROM SHOP.PART P\n WHERE TYPE IN (SELECT TYPE FROM SHOP.PART Q WHERE Q.PART_ID = O.TOTAL\n AND BRAND = P.TYPE UNION SELECT STATUS FROM SHOP.ORDERS P WHERE P.TOTAL = 1));")
    return _uses(spark, artifacts(rows, "L", _text("Q", key, ".sql"), F.when(key % 2 == 0, one).otherwise(two))).select("member", "column", "table", "context", "host_var", "line")


def chunked_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script of two lines a part, its literals and comments full of ';', in blocks and chunks that cut through them."""
    rows = _table(spark, sf_dir, "part", "p_partkey")
    key = F.col("p_partkey")
    told = F.explode(F.array(F.struct((key * 2).alias("id"), _text("SELECT A FROM SHOP.T", key, " WHERE B = 'x; -- ").alias("value")), F.struct((key * 2 + 1).alias("id"), F.lit("DELETE FROM SHOP.GHOST; it''s' /* ; ' */;").alias("value"))))
    script = rows.select(F.lit("/L/ALL.sql").alias("path"), F.floor(key / 97).alias("block"), told.alias("t")).select("path", "block", "t.id", "t.value")
    return _references(scripts.statement_units(scripts.line_chunks(script, 16))).select("table_name", "access", F.col("line").cast("long").alias("line"))


def assembled_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements put together from three literals and a field, for suppliers of an odd key from one that is not known."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    fill = F.when(key % 2 == 0, _text("    MOVE 'SHOP.T", key, "' TO W-TAB.")).otherwise("    ACCEPT W-TAB.")
    files = artifacts(rows, "L", _text("Q", key), fixed(["IDENTIFICATION DIVISION.", "01  W-VERB PIC X(9) VALUE 'DELETE '.", "PROCEDURE DIVISION.", fill, "    STRING W-VERB 'FROM ' W-TAB", "      ' WHERE A = 1' DELIMITED BY SIZE INTO W.", "    EXEC SQL PREPARE S1 FROM :W END-EXEC."]))
    units = definitions.assembled_units(lines.cobol_blobs(files)).select("path", "unit", F.col("first").cast("long").alias("first"), "origin", "text")
    return _references(units).select(member_of(F.col("path")).alias("member"), "table_name", "access", "line")


def create_index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    files = artifacts(rows, "L", _text("X", F.col("s_suppkey"), ".sql"), _text("CREATE UNIQUE INDEX SHOP.I", F.col("s_suppkey"), " ON SHOP.PART (BRAND ASC, PART_ID DESC);"))
    return _uses(spark, files, contexts=["INDEX"]).select("member", "column", "table", "access")


def alter_add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a declaration, then those that ALTER TABLE adds, which may be null."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    table = _text("SHOP.A", F.col("s_suppkey"))
    files = artifacts(rows, "L", _text("A", F.col("s_suppkey"), ".sql"), _text("CREATE TABLE ", table, " (K INTEGER NOT NULL, V CHAR(2));\nALTER TABLE ", table, " ADD COLUMN W", F.col("s_suppkey") % 3, " DECIMAL(7,2);"))
    known = definitions.known_columns(definitions.defined_columns(_tokens(files)), files)
    return known.select("table", "name", "seq", "sql_type", "nullable")


def free_format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-format source, by its directive or by text in columns 1-6, keeps whole lines."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    text = F.when(F.col("s_suppkey") % 2 == 0, _text(">>SOURCE FORMAT IS FREE\n*> GHOST\nMOVE ", F.col("s_suppkey"), " TO A.")).otherwise(_text("PROGRAM-ID. F", F.col("s_suppkey"), ".\nPROCEDURE DIVISION.\n  *> GHOST\nSTOP RUN."))
    return lines.cobol_blobs(artifacts(rows, "L", _text("F", F.col("s_suppkey")), text)).select("member", "blob", F.array_join(F.col("origin").cast("array<string>"), ",").alias("origin"))


def copybook_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs (orders) copy a customer's book, which copies a nation's, which copies a region's: three hops, no more."""
    book = lambda name, copied: fixed(["01  W-AREA.", "    05 W-A PIC X.", _text("    COPY ", copied, "."), "*    COPY GHOST."])
    parts = [artifacts(_table(spark, sf_dir, t, *cols), "L", name, text) for t, cols, name, text in (
        ("orders", ["o_orderkey", "o_custkey"], _text("P", F.col("o_orderkey")), fixed(["IDENTIFICATION DIVISION.", "DATA DIVISION.", _text("    COPY C", F.col("o_custkey"), "."), "PROCEDURE DIVISION."])),
        ("customer", ["c_custkey", "c_nationkey"], _text("C", F.col("c_custkey")), book("C", _text("N", F.col("c_nationkey")))),
        ("nation", ["n_nationkey", "n_regionkey"], _text("N", F.col("n_nationkey")), book("N", _text("R", F.col("n_regionkey")))),
        ("region", ["r_regionkey"], _text("R", F.col("r_regionkey")), book("R", F.lit("BEYOND"))),
    )]
    files = written(reduce(DataFrame.unionByName, [*parts, artifacts(spark.range(1), "L", F.lit("BEYOND"), F.lit("       01  B-AREA.\n           05 B-A PIC X.\n"))]), "books")
    index = SimpleNamespace(files=files, copy_refs=written(definitions.copy_references(lines.cobol_blobs(files)), "copies"))
    found = copybook_closure(index, files.where("kind = 'COBOL'").select("path"))
    return found.where("hop > 0").select(member_of(F.col("path")).alias("member"), member_of(F.col("def_path")).alias("book"), "hop")


def deck_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's deck is the member of the library that its DD names, not its twin in another library."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    job = artifacts(rows, "L", _text("J", key), F.concat_ws("\n", _text("//J", key, " JOB 1"), F.lit("//S EXEC PGM=DSNUTILB"), _text("//SYSIN DD DSN=", F.when(key % 3 == 0, "MAIN.DECKS").when(key % 3 == 1, "TEST.DECKS").otherwise("LOST.DECKS"), "(D", key, "),DISP=SHR")))
    decks = [artifacts(rows, lib, _text("D", key), F.lit("LOAD DATA INTO TABLE SHOP.ORDERS\n")) for lib in ("MAIN.DECKS", "TEST.DECKS")]
    steps, dds, _ = jobs.steps_and_dds(written(jobs.jcl_lines(job), "jcl"), job)
    found, _ = jobs.deck_references(dds, reduce(DataFrame.unionByName, decks))
    return found.select("job", "step", "dd", "dsn", "deck_kind", library_of(F.col("deck_path")).alias("library"))


def proc_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that run a program, and steps that call a procedure which does, also through another procedure."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    text = (
        F.when(key % 4 == 0, _text("//P", key, " PROC\n//IN EXEC PGM=", F.when(key % 8 == 0, "TARGET").otherwise("OTHER"), "\n// PEND\n"))
        .when(key % 4 == 1, _text("//P", key, " PROC\n//MID EXEC P", key - 1, "\n// PEND\n"))
        .otherwise(_text("//J", key, " JOB 1\n//* EXEC PGM=TARGET\n//TOP EXEC P", key - F.when(key % 4 == 2, 1).otherwise(3), "\n"))
    )
    files = artifacts(rows, "L", _text(F.when(key % 4 < 2, "P").otherwise("J"), key), text)
    steps, dds, _ = jobs.steps_and_dds(written(jobs.jcl_lines(files), "jcl"), files)
    none = files.select("path", F.lit(0).alias("line"), "kind").limit(0)
    found, _ = dependent_steps(SimpleNamespace(steps=written(steps, "steps"), dds=written(dds, "dds"), files=files), none, spark.createDataFrame([("TARGET",)], "name string"))
    return found.select("job", "step")


def dynamic_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL in a literal counts in programs that prepare statements, and in those alone."""
    rows = _table(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    last = F.when(key % 2 == 0, "    EXEC SQL PREPARE S1 FROM :W END-EXEC.").otherwise("    DISPLAY W.")
    files = artifacts(rows, "L", _text("Y", key), fixed(["IDENTIFICATION DIVISION.", "PROCEDURE DIVISION.", _text("    MOVE 'DELETE FROM SHOP.T", key, "' TO W."), last]))
    units = definitions.dynamic_units(lines.cobol_blobs(files)).select("path", "unit", F.col("first").cast("long").alias("first"), "origin", "text")
    return _references(units).select(member_of(F.col("path")).alias("member"), "table_name", "access", "line")


def data_set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    dsn = F.when(F.col("p_size") % 3 == 0, _text("LIB.CNTL(M", F.col("p_partkey"), ")")).when(F.col("p_size") % 3 == 1, _text("'DATA.P", F.col("p_partkey"), "(+1)'")).otherwise(_text("&&T", F.col("p_partkey")))
    return rows.select("p_partkey", dsn_parts(dsn).alias("d")).select("p_partkey", "d.base", "d.tail", "d.is_member")


def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    jcl = artifacts(_table(spark, sf_dir, "region", "r_regionkey"), "L", _text("J", F.col("r_regionkey")), _text("//J", F.col("r_regionkey"), " JOB 1\n//S EXEC PGM=X\n"))
    sort = artifacts(_table(spark, sf_dir, "nation", "n_nationkey"), "L", _text("S", F.col("n_nationkey")), F.lit("  SORT FIELDS=(1,10,CH,A)\n"))
    deck = artifacts(_table(spark, sf_dir, "supplier", "s_suppkey"), "L", _text("D", F.col("s_suppkey")), F.lit("LOAD DATA INTO TABLE SHOP.T\n"))
    every = reduce(DataFrame.unionByName, [jcl, sort, deck, order_programs(spark, sf_dir), _script(spark, DDL)])
    return every.groupBy("library", "kind").agg(F.count("*").alias("files"))


_ORDERS = """o AS (SELECT 'P' || o_orderkey AS member, o_orderstatus AS s, 'WS-K' || (o_orderkey % 7) AS k FROM orders)"""
_STMT = "CASE s WHEN 'F' THEN 'SELECT' WHEN 'O' THEN 'UPDATE' ELSE 'INSERT' END"
_USE = "SELECT member, {column} AS \"column\", 'ORDERS' AS \"table\", '{access}' AS access, '{context}' AS context, {host} AS host_var, {line} AS line FROM o WHERE s {of}"


def _use(column: str, access: str, context: str, host: str, line: int, of: str) -> str:
    return _USE.format(column=f"'{column}'", access=access, context=context, host=host, line=line, of=of)


_SQL = {
    "mask_sql": "SELECT p_partkey, 'A ''' || repeat(' ', length(p_name) + 2) || ''' B ' || repeat(' ', 3 + length(p_type)) || chr(10) || 'C ' || repeat(' ', 3 + length(p_brand)) || chr(10) || '   D' AS masked FROM part",
    "cobol_logical_lines": "SELECT 'M' || p_partkey AS member, 'MOVE LOW-' || p_type || '-X' || p_partkey || ' TO Y.' || chr(10) || 'STOP RUN.' AS blob, '2,4' AS origin FROM part",
    "paren_depth": "SELECT 'M' || p_partkey AS member, p_size % 6 + 1 AS deepest, CAST(1 AS BIGINT) AS commas FROM part",
    "table_refs_by_access": f"WITH {_ORDERS} SELECT 'SHOP' AS schema, 'ORDERS' AS table_name, CASE s WHEN 'F' THEN 'READ' ELSE 'WRITE' END AS access, {_STMT} AS stmt_name, count(*) AS refs FROM o GROUP BY s",
    "writers_only": f"WITH {_ORDERS} SELECT member, {_STMT} AS stmt_name, 8 AS line FROM o WHERE s <> 'F'",
    "table_listing": "SELECT 'SHOP' AS schema, 'ORDERS' AS table_name, count(*) AS refs FROM orders",
    "select_into_pairing": f"WITH {_ORDERS} {_use('STATUS', 'READ', 'SELECT', chr(39) + 'WS-STATUS' + chr(39), 8, '= ' + chr(39) + 'F' + chr(39))} UNION ALL {_use('TOTAL', 'READ', 'SELECT', chr(39) + 'WS-TOTAL' + chr(39), 8, '= ' + chr(39) + 'F' + chr(39))}",
    "where_predicates": f"WITH {_ORDERS} {_use('ORDER_ID', 'READ', 'WHERE', 'k', 9, '<> ' + chr(39) + 'P' + chr(39))}",
    "update_set_writes": f"WITH {_ORDERS} {_use('TOTAL', 'WRITE', 'SET', chr(39) + 'WS-TOTAL' + chr(39), 8, '= ' + chr(39) + 'O' + chr(39))}",
    "insert_columns": f"WITH {_ORDERS} {_use('ORDER_ID', 'WRITE', 'INSERT', 'k', 8, '= ' + chr(39) + 'P' + chr(39))} UNION ALL {_use('TOTAL', 'WRITE', 'INSERT', chr(39) + 'WS-TOTAL' + chr(39), 8, '= ' + chr(39) + 'P' + chr(39))}",
    "group_order_by": "SELECT 'M' || p_partkey AS member, CASE WHEN p_size % 2 = 0 THEN 'TYPE' ELSE 'BRAND' END AS \"column\", c AS context, l AS line FROM part, (VALUES ('GROUP BY', 2), ('ORDER BY', 3)) v(c, l)",
    "cursor_fetch": "SELECT 'C' || c_custkey AS member, c AS \"column\", CASE c WHEN 'TOTAL' THEN 'TOT' ELSE 'ID-' || c_custkey END AS host_var, 8 AS line FROM customer, (VALUES ('ORDER_ID'), ('TOTAL')) v(c)",
    "deck_columns": "SELECT 'D' || s_suppkey AS member, c AS \"column\", 'WRITE' AS access FROM supplier, (VALUES ('ORDER_ID'), ('STATUS'), ('TOTAL')) v(c) WHERE s_suppkey % 2 = 1 OR c <> 'STATUS'",
    "ddl_columns": "SELECT 'T' || p_partkey AS \"table\", 'C' || i AS name, CAST(i AS INT) AS seq, CASE i WHEN 0 THEN 'CHAR(3) NOT NULL' ELSE 'DECIMAL(9,2)' END AS sql_type, i > 0 AS nullable, 'CREATE TABLE' AS origin FROM part, range(5) r(i) WHERE i <= p_size % 5",
    "dclgen_bindings": "SELECT 'S' || s_suppkey AS \"table\", c AS \"column\", h AS host_field, p AS pic, l AS line FROM supplier, (VALUES ('SUPP_ID', 'SUPP-ID', 'X(8)', 5), ('S_NAME', 'S-NAME', 'X(40)', 6), ('BAL', 'BALANCE-X', 'S9(7)V99 COMP-3', 9)) v(c, h, p, l)",
    "call_depths": "SELECT 'R1' AS name, 0 AS depth UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'C' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    "vendor_calls": "SELECT CASE event_type WHEN 'click' THEN 'DFHEI1' WHEN 'view' THEN 'CEEDATE' ELSE 'APP' || (user_id % 10) END AS callee, CASE event_type WHEN 'click' THEN 'IBM CICS' WHEN 'view' THEN 'IBM Language Environment' END AS label, count(*) AS calls FROM events GROUP BY 1, 2",
    "job_steps": "SELECT 'J' || event_id AS job, 'S1' AS step, upper(event_type) AS resolved_pgm, 'IN' AS dd, 'DATA.U' || user_id AS base, '(NEW,CATLG)' AS disp, false AS is_member, 3 AS line FROM events",
    "dataset_lineage": "SELECT 'J' || event_id AS job, 'S1' AS step, 'DATA.U' || user_id AS dataset, 1 AS hop FROM events WHERE event_type <> 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "view_targets": "SELECT 'SHOP' AS schema, 'R1' AS \"table\", 'the table itself' AS why UNION ALL SELECT 'SHOP', 'V' || n_nationkey, 'view over SHOP.R1' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '', 'Y' || n_nationkey, 'synonym for SHOP.V' || n_nationkey FROM nation WHERE n_regionkey = 1",
    "merge_columns": "SELECT 'G' || s_suppkey AS member, CASE c WHEN 'SET' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'STATUS' ELSE 'TOTAL' END ELSE n END AS \"column\", t AS \"table\", a AS access, c AS context, l AS line FROM supplier, (VALUES ('ORDER_ID', 'ORDERS', 'READ', 'ON', 2), ('BRAND', 'PART', 'READ', 'ON', 2), ('', 'ORDERS', 'WRITE', 'SET', 3), ('ORDER_ID', 'ORDERS', 'WRITE', 'INSERT', 4), ('TOTAL', 'ORDERS', 'WRITE', 'INSERT', 4)) v(n, t, a, c, l)",
    "union_branches": "SELECT 'U' || s_suppkey AS member, n AS \"column\", t AS \"table\", c AS context, l AS line FROM supplier, (VALUES ('STATUS', 'ORDERS', 'SELECT', 1), ('TOTAL', 'ORDERS', 'WHERE', 1), ('BRAND', 'PART', 'SELECT', 2), ('TYPE', 'PART', 'SELECT', 3)) v(n, t, c, l)",
    "star_expansion": "SELECT 'S' || s_suppkey AS member, n AS \"column\", t AS \"table\" FROM supplier, (VALUES ('ORDER_ID', 'ORDERS', 0), ('STATUS', 'ORDERS', 0), ('TOTAL', 'ORDERS', 0), ('PART_ID', 'PART', 1), ('BRAND', 'PART', 1), ('TYPE', 'PART', 1), ('STATUS', 'ORDERS', 1)) v(n, t, odd) WHERE s_suppkey % 2 = odd",
    "insert_from_select": "SELECT 'I' || s_suppkey AS member, n AS \"column\", t AS \"table\", a AS access, c AS context, l AS line FROM supplier, (VALUES ('ORDER_ID', 'ORDERS', 'WRITE', 'INSERT', 1), ('STATUS', 'ORDERS', 'WRITE', 'INSERT', 1), ('BRAND', 'PART', 'READ', 'SELECT', 2), ('TYPE', 'PART', 'READ', 'SELECT', 2), ('PART_ID', 'PART', 'READ', 'WHERE', 2)) v(n, t, a, c, l)",
    "chunked_statements": "SELECT 'T' || p_partkey AS table_name, 'READ' AS access, 2 * row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part",
    "assembled_sql": "SELECT 'Q' || s_suppkey AS member, 'T' || s_suppkey AS table_name, 'WRITE' AS access, 5 AS line FROM supplier WHERE s_suppkey % 2 = 0",
    "undefined_columns": "SELECT 'N' || s_suppkey AS member, n AS \"column\", a AS access, c AS context, h || CASE h WHEN 'H' THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS host_var, l AS line FROM supplier, (VALUES ('GONE', 'READ', 'SELECT', '', 1, 0), ('GONE', 'READ', 'WHERE', 'X', 1, 0), ('GONE', 'READ', 'ORDER BY', '', 2, 0), ('GONE', 'READ', 'WHERE', '', 1, 1), ('STATUS', 'WRITE', 'SET', '', 1, 2), ('GONE', 'READ', 'WHERE', 'H1', 2, 2), ('GONE', 'READ', 'WHERE', 'H', 2, 2), ('TOTAL', 'READ', 'WHERE', '', 2, 2)) v(n, a, c, h, l, m) WHERE s_suppkey % 3 = m",
    "outer_qualifiers": "SELECT 'Q' || s_suppkey AS member, n AS \"column\", t AS \"table\", c AS context, CASE h WHEN 'T' THEN 'T' || s_suppkey ELSE '' END AS host_var, l AS line FROM supplier, (VALUES ('BRAND', 'PART', 'WHERE', '', 3, 0), ('ORDER_ID', 'ORDERS', 'WHERE', '', 3, 0), ('TOTAL', 'ORDERS', 'WHERE', 'T', 3, 0), ('STATUS', 'ORDERS', 'SELECT', '', 1, 1), ('ORDER_ID', 'ORDERS', 'WHERE', '', 1, 1), ('BRAND', 'PART', 'SELECT', '', 1, 1), ('TYPE', 'PART', 'WHERE', '', 2, 1), ('TYPE', 'PART', 'SELECT', '', 2, 1), ('PART_ID', 'PART', 'WHERE', '', 2, 1), ('TOTAL', 'ORDERS', 'WHERE', '', 2, 1), ('BRAND', 'PART', 'WHERE', '', 3, 1), ('TYPE', 'PART', 'WHERE', '', 3, 1), ('STATUS', 'ORDERS', 'SELECT', '', 3, 1), ('TOTAL', 'ORDERS', 'WHERE', '', 3, 1)) v(n, t, c, h, l, m) WHERE s_suppkey % 2 = m",
    "tuple_set": "SELECT 'Z' || s_suppkey AS member, n AS \"column\", t AS \"table\", a AS access, c AS context, h || CASE h WHEN 'S' THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS host_var, l AS line FROM supplier, (VALUES ('STATUS', 'ORDERS', 'WRITE', 'SET', 'S', 1, 0), ('TOTAL', 'ORDERS', 'WRITE', 'SET', 'T', 1, 0), ('ORDER_ID', 'ORDERS', 'WRITE', 'SET', 'K', 1, 0), ('STATUS', 'ORDERS', 'READ', 'WHERE', '', 2, 0), ('STATUS', 'ORDERS', 'WRITE', 'SET', '', 1, 1), ('TOTAL', 'ORDERS', 'WRITE', 'SET', '', 1, 1), ('TYPE', 'PART', 'READ', 'SELECT', '', 2, 1), ('PART_ID', 'PART', 'READ', 'SELECT', '', 2, 1), ('BRAND', 'PART', 'READ', 'WHERE', 'B', 2, 1)) v(n, t, a, c, h, l, m) WHERE s_suppkey % 2 = m",
    "create_index_columns": "SELECT 'X' || s_suppkey AS member, n AS \"column\", 'PART' AS \"table\", 'READ' AS access FROM supplier, (VALUES ('BRAND'), ('PART_ID')) v(n)",
    "alter_add_columns": "SELECT 'A' || s_suppkey AS \"table\", CASE i WHEN 0 THEN 'K' WHEN 1 THEN 'V' ELSE 'W' || (s_suppkey % 3) END AS name, CAST(i AS INT) AS seq, CASE i WHEN 0 THEN 'INTEGER NOT NULL' WHEN 1 THEN 'CHAR(2)' ELSE 'DECIMAL(7,2)' END AS sql_type, i > 0 AS nullable FROM supplier, range(3) r(i)",
    "free_format_lines": "SELECT 'F' || s_suppkey AS member, CASE s_suppkey % 2 WHEN 0 THEN '>>SOURCE FORMAT IS FREE' || chr(10) || 'MOVE ' || s_suppkey || ' TO A.' ELSE 'PROGRAM-ID. F' || s_suppkey || '.' || chr(10) || 'PROCEDURE DIVISION.' || chr(10) || 'STOP RUN.' END AS blob, CASE s_suppkey % 2 WHEN 0 THEN '1,3' ELSE '1,2,4' END AS origin FROM supplier",
    "copybook_reach": "SELECT 'P' || o_orderkey AS member, CASE h WHEN 1 THEN 'C' || o_custkey WHEN 2 THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END AS book, h AS hop FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey, (VALUES (1), (2), (3)) v(h)",
    "deck_wiring": "SELECT 'J' || s_suppkey AS job, 'S' AS step, 'SYSIN' AS dd, CASE s_suppkey % 3 WHEN 0 THEN 'MAIN' ELSE 'TEST' END || '.DECKS(D' || s_suppkey || ')' AS dsn, 'CONTROL' AS deck_kind, CASE s_suppkey % 3 WHEN 0 THEN 'MAIN' ELSE 'TEST' END || '.DECKS' AS library FROM supplier WHERE s_suppkey % 3 < 2",
    "proc_expansion": "WITH s AS (SELECT s_suppkey AS k, s_suppkey - s_suppkey % 4 AS base FROM supplier), m AS (SELECT max(s_suppkey) AS hi, min(s_suppkey) AS lo FROM supplier) SELECT CASE WHEN k % 4 < 2 THEN 'P' ELSE 'J' END || k AS job, CASE k % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'MID' ELSE 'TOP' END AS step FROM s, m WHERE base % 8 = 0 AND base >= lo",
    "dynamic_sql": "SELECT 'Y' || s_suppkey AS member, 'T' || s_suppkey AS table_name, 'WRITE' AS access, 3 AS line FROM supplier WHERE s_suppkey % 2 = 0",
    "data_set_names": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'LIB.CNTL' WHEN 1 THEN 'DATA.P' || p_partkey ELSE '&&T' || p_partkey END AS base, CASE p_size % 3 WHEN 0 THEN 'M' || p_partkey WHEN 1 THEN 'P' || p_partkey ELSE '&&T' || p_partkey END AS tail, p_size % 3 = 0 AS is_member FROM part",
    "artifact_kinds": "SELECT 'L' AS library, 'JCL' AS kind, count(*) AS files FROM region UNION ALL SELECT 'L', 'SORT', count(*) FROM nation UNION ALL SELECT 'L', 'CONTROL', count(*) FROM supplier UNION ALL SELECT 'SHOP.COBOL', 'COBOL', count(*) FROM orders UNION ALL SELECT 'SHOP.DDL', 'SQL', 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (merge_columns, union_branches, star_expansion, insert_from_select, undefined_columns, tuple_set, outer_qualifiers, chunked_statements, assembled_sql, create_index_columns, alter_add_columns, free_format_lines, copybook_reach, deck_wiring, proc_expansion, dynamic_sql, mask_sql, cobol_logical_lines, paren_depth, table_refs_by_access, writers_only, table_listing, group_order_by, cursor_fetch, deck_columns, ddl_columns, dclgen_bindings, call_depths, vendor_calls, job_steps, dataset_lineage, view_targets, data_set_names, artifact_kinds)
    uses = {"select_into_pairing": "SELECT", "where_predicates": "WHERE", "update_set_writes": "SET", "insert_columns": "INSERT"}
    return {f.__name__: f for f in plain} | {name: _order_uses(context) for name, context in uses.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["artifacts", "fixed", "oracle_sql", "order_programs", "queries"]
