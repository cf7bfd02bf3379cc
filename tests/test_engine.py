"""The engine end to end over the freight library, and its parts on small texts."""

import json
import os

import pytest
from pyspark.sql import functions as F

import quarrylens as q
from quarrylens.functions.storage import written
from quarrylens.functions.text import dsn_parts, masked
from quarrylens.functions.vendor import classified, classify_module, load_overrides
from quarrylens.operators import definitions, lexer, lines, references
from quarrylens.plans import fields
from quarrylens.plans.index import split_spec
from tests import library


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("freight"))
    stats = q.index(spark, library.write(f"{top}/src"), f"{top}/index")
    assert (stats["files"], stats["scanned"], stats["skipped"]) == (len(library.MEMBERS), len(library.MEMBERS), 0)
    return f"{top}/index"


@pytest.fixture(scope="module")
def fld(spark, db):
    return q.get_field_dependencies(spark, "RAIL.WAGON", db)


@pytest.fixture(scope="module")
def res(spark, db):
    return q.query(spark, "RAIL.WAGON", db)


def uses(result, member, *what, **want):
    return {tuple(u[w] for w in what) for u in result.uses if u.member == member and all(u[k] == v for k, v in want.items())}


def tokens_of(spark, *statements):
    units = spark.createDataFrame([(str(i), 0, 1, None, s) for i, s in enumerate(statements)], "path string, unit int, first long, origin array<int>, text string")
    return lexer.placed(lexer.structured(lexer.tokens(units)))


#: A statement and the references it makes, each as access, schema.table.
STATEMENTS = [
    ("SELECT KM -- FROM X.NO\n FROM R.TRIP", "READ R.TRIP"),
    ("SELECT /* JOIN X.NO */ 'FROM X.NO' FROM TRIP", "READ .TRIP"),
    ("WITH FAR (ID) AS (SELECT ID FROM R.TRIP WHERE KM > 9), NEAR AS (SELECT 1 FROM FAR) SELECT * FROM NEAR, FAR", "READ R.TRIP"),
    ("SELECT F.X FROM TABLE(SPLIT('a,b')) AS F, R.TRIP", "READ R.TRIP"),
    ("SELECT DEPOT FROM R.WAGON WHERE NR = 4 FOR UPDATE OF DEPOT", "READ R.WAGON"),
    ("DELETE FROM R.WAGON W WHERE EXISTS (SELECT 1 FROM R.TRIP T WHERE T.NR = W.NR)", "READ R.TRIP, WRITE R.WAGON"),
    ("SELECT 1 FROM R.A, R.B X FULL OUTER JOIN R.C ON X.I = R.C.I CROSS JOIN R.D, R.E", "READ R.A, READ R.B, READ R.C, READ R.D, READ R.E"),
    ("INSERT INTO R.NEWER SELECT * FROM R.OLDER", "READ R.OLDER, WRITE R.NEWER"),
    ("IF V > 3 THEN UPDATE R.WAGON SET A = 1", "WRITE R.WAGON"),
    ("MERGE INTO R.W USING (SELECT 1 FROM R.S) Z ON W.I = Z.I WHEN MATCHED THEN UPDATE SET A = 2", "READ R.S, WRITE R.W"),
    ("LOCK TABLE R.W IN EXCLUSIVE MODE", "LOCK R.W"),
    ("CREATE TABLE R.NEW_ONE (A INT)", "DDL R.NEW_ONE"),
    ("DROP TABLE R.NEW_ONE", "DDL R.NEW_ONE"),
    ("DECLARE R.W TABLE (A CHAR(1))", "DECLARE R.W"),
    ("SELECT A FROM DISTANT.R.W", "READ R.W"),
    ('UPDATE "Rolling Stock"."Wagon No" SET A = 1', "WRITE Rolling Stock.Wagon No"),
    ("SELECT A FROM (SELECT B FROM R.IN1 UNION SELECT C FROM R.IN2) Q WHERE A > ALL (SELECT D FROM R.IN3)", "READ R.IN1, READ R.IN2, READ R.IN3"),
]


def test_references_of_statements(spark):
    rows = references.table_references(tokens_of(spark, *[s for s, _ in STATEMENTS])).collect()
    for i, (statement, want) in enumerate(STATEMENTS):
        got = sorted({f"{r.access} {r['schema']}.{r.table_name}" for r in rows if r.path == str(i)})
        assert ", ".join(got) == want, statement
    assert split_spec("far.rail.wagon") == ("RAIL", "WAGON") and split_spec('"old stock".W') == ("old stock", "W") and split_spec("w") == ("", "W")


def test_masking_keeps_places(spark):
    texts = {"x 'y''z' -- c\n/* d\n*/ 'open": "x '    '     \n    \n   '    ", "/*/ q */r": "    q */r", "a''b": "a''b"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", masked(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in got} == texts


def test_logical_lines(spark):
    def blob(text):
        r = lines.cobol_blobs(spark.createDataFrame([("p", text)], "path string, text string")).first()
        return r.blob, list(r.origin)

    assert blob(library.card(["MOVE 1 TO A.", "*MOVE 2 TO B.", "SELECT X FROM R.WA", "~  GON", "STOP RUN."], "GHOST")) == ("MOVE 1 TO A.\nSELECT X FROM R.WAGON\nSTOP RUN.", [1, 3, 5])
    assert blob(">>SOURCE FORMAT IS FREE\n*> remark\nmove 1 to a.\n") == (">>SOURCE FORMAT IS FREE\nmove 1 to a.", [1, 3])
    assert blob("program-id. a.\nprocedure division.\n  stop run.") == ("program-id. a.\nprocedure division.\n  stop run.", [1, 2, 3])


def test_skipped_statements_give_no_units(spark):
    text = library.card(["    EXEC SQL INCLUDE SQLCA END-EXEC.", "    EXEC SQL SET :A = CURRENT DATE END-EXEC.", "    EXEC SQL", "      DELETE FROM R.T", "    END-EXEC.", "    EXEC SQL CLOSE C END-EXEC."])
    rows = lines.embedded_sql(lines.cobol_blobs(spark.createDataFrame([("p", text)], "path string, text string"))).collect()
    assert [(r.unit, r.first, r.text.strip()) for r in rows] == [(3, 3, "DELETE FROM R.T")]


def test_a_list_that_never_closes_runs_to_its_end(spark):
    rows = definitions.defined_columns(tokens_of(spark, "CREATE TABLE R.T (A CHAR(3), B DECIMAL(5,2) NOT NULL")).orderBy("seq").collect()
    assert [(r.name, r.sql_type, r.nullable) for r in rows] == [("A", "CHAR(3)", True), ("B", "DECIMAL(5,2) NOT NULL", False)]


def test_data_set_names(spark):
    want = {"RAIL.DUMP(+1)": ("RAIL.DUMP", "DUMP", False), "RAIL.DECKS(A1)": ("RAIL.DECKS", "A1", True), "'RAIL.X(0)'": ("RAIL.X", "X", False), "&&W(A)": ("&&W", "&&W", False)}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", dsn_parts(F.col("n")).alias("d")).collect()
    assert {r.n: tuple(r.d) for r in rows} == want


def test_vendor_modules(tmp_path):
    assert {n: (classify_module(n) or [None])[-1] for n in ("DFHXCPRH", "CEELOCT", "DSNALI", "ICEMAN", "MQOPEN", "WEIGH", "MQUEUE")} == {"DFHXCPRH": "cics", "CEELOCT": "le", "DSNALI": "db2", "ICEMAN": "sort", "MQOPEN": "mq", "WEIGH": None, "MQUEUE": None}
    (tmp_path / "own").write_text("# ours\nRAILX*   house tools\nGATE1 gate control  \n")
    own = load_overrides(str(tmp_path / "own"))
    assert classify_module("RAILXPRT", own) == ("house tools", "site") and classify_module("GATE1", own)[0] == "gate control" and classify_module("GATE12", own) is None


def test_table_references(res):
    by = lambda member: sorted((r.access, r.table, r.stmt) for r in res.refs if r.member == member)
    assert not {"SHED", "SIDING"} & {r.table for r in res.refs}
    assert by("WEIGH") == [("READ", "WAGON", "SELECT")] and by("REPAINT") == [("WRITE", "WAGON", "UPDATE")]
    assert by("SWEEP") == [("READ", "WAGON", "SELECT")] and by("HEAVY") == [("READ", "BIG_WAGON", "SELECT")]
    assert by("REFILL") == [("READ", "TSWGN", "RUNSTATS TABLESPACE"), ("READ", "WAGON", "SELECT"), ("WRITE", "WAGON", "LOAD INTO TABLE")]
    assert [(r.line, r.confidence) for r in res.refs if r.member == "ADHOC"] == [(7, 40)]
    assert {(t, w) for _, t, w in res.targets} == {("WAGON", "the table itself"), ("BIG_WAGON", "view over RAIL.WAGON"), ("CAR", "synonym for RAIL.WAGON")}
    assert {r.line for r in res.refs if r.member == "REFILL"} == {5, 10, 17}


def test_programs_reached(res):
    depth = {n: p.depth for n, p in res.programs.items()}
    assert {"WEIGH": 0, "REPAINT": 0, "SWEEP": 0, "HEAVY": 0, "NIGHT": 1, "WEEK": 2}.items() <= depth.items()
    assert "CATERING" not in depth
    assert [d for _, _, k, d in res.blind_spots if k == "UNRESOLVED-CALL"] == ["CALL SCALE9: no source in the index"]
    assert any("IBM Language Environment" in n and "CEELOCT" in n for n in res.notes)


def test_jobs_steps_and_decks(res):
    steps = {(s.job, s.step): s for s in res.steps}
    assert set(steps) == {("PRWEIGH", "GO"), ("PROUTER", "INNER"), ("DAILY", "A1"), ("REFILL", "FILL"), ("REFILL", "STATS"), ("REFILL", "ASK"), ("EXPORT", "OUT")}
    assert (steps["PRWEIGH", "GO"].pgm, steps["PRWEIGH", "GO"].resolved_pgm) == ("IKJEFT1B", "WEIGH")
    (deck,) = steps["EXPORT", "OUT"].decks
    assert (deck.dd, deck.dsn, deck.kind) == ("SYSIN", "RAIL.DECKS(UNWGN)", "CONTROL") and "/RAIL.DECKS/" in deck.path
    lost = [d for _, _, k, d in res.blind_spots if k == "UNRESOLVED-DECK-REF"]
    assert any("RAIL.DECKS(GONE)" in d for d in lost) and any("TEST.DECKS" in d for d in lost)
    (link,) = [d for d in res.data_links if d.job == "EXPORT"]
    assert (link.step, link.dataset, link.via_job, link.hop) == ("ARRANGE", "RAIL.WGN.DUMP", "EXPORT/OUT", 1) and [d.kind for d in link.decks] == ["SORT"]


def test_writers_alone(spark, db):
    r = q.query(spark, "RAIL.WAGON", db, include_read=False, data_hops=0)
    assert {x.access for x in r.refs} >= {"WRITE"} and "READ" not in {x.access for x in r.refs} and r.data_links == []
    assert "REPAINT" in r.programs and "HEAVY" not in r.programs


def test_statements_put_together_from_constants(spark):
    put = lambda *code: code
    prepare = "    EXEC SQL PREPARE P FROM :S END-EXEC."
    programs = {
        "A": (["01  HEAD PIC X(20) VALUE 'UPDATE '.", "01  TBL PIC X(20)."], put("    MOVE 'RAIL.WAGON  X' TO TBL.", "    STRING HEAD DELIMITED BY SIZE TBL DELIMITED BY SPACE", "      ' SET A = 1' DELIMITED BY SIZE", "      INTO S END-STRING.", prepare)),
        "B": ([], put("    STRING 'DELETE ' 'FROM ' 'RAIL.TRIP' DELIMITED BY SIZE", "     INTO S1.", "    MOVE S1 TO S2 S3.", "    EXEC SQL EXECUTE IMMEDIATE :S3 END-EXEC.")),
        # what another statement fills is not known
        "C": ([], put("    STRING 'DELETE ' 'FROM ' 'RAIL.TRIP' INTO S.", "    ACCEPT S.", prepare)),
        "D": ([], put("    STRING 'DELETE FROM ' WHAT INTO S.", prepare)),
        # the last value before counts
        "E": ([], put("    MOVE 'X' TO T. MOVE 'RAIL.AAA' TO T.", "    STRING 'INSERT INTO ' T ' VALUES (''a'')' INTO S.", prepare, "    MOVE 'RAIL.BBB' TO T.")),
        "F": ([], put("    STRING 'DELETE FROM ' 'RAIL.TRIP' INTO S.", "    DISPLAY S.")),
    }
    files = spark.createDataFrame([(n, library.cobol(n, *p)) for n, p in programs.items()], "path string, text string")
    rows = definitions.assembled_units(lines.cobol_blobs(files)).collect()
    assert sorted((r.path, r.text, r.origin[r["first"] - 1]) for r in rows) == [("A", "UPDATE RAIL.WAGON SET A = 1", 9), ("B", "DELETE FROM RAIL.TRIP", 8), ("E", "INSERT INTO RAIL.AAA VALUES ('a')", 7)]


def test_long_vendor_lists(spark):
    own = [(f"P{i}", i % 2 == 0, f"label {i}", "site") for i in range(10_000)] + [("DFHX", False, "own CICS part", "site")]
    names = ["P17", "P170", "P18", "P1800X", "DFHXA", "dfhb", "MQOPEN", "MQOPENX", "", None]
    rows = spark.createDataFrame([(n,) for n in names * 2], "callee string")
    got = sorted({(r.callee, tuple(r.vendor) if r.vendor else None) for r in classified(rows, "callee", own).collect()}, key=repr)
    assert got == sorted({(n, classify_module(n, own) if n is not None else None) for n in names}, key=repr)
    assert classified(rows, "callee", own).count() == len(names) * 2


def test_reports_are_written_by_executors(spark, res, tmp_path):
    q.write_report(res, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report" / "refs"))
    assert back.count() == len(res.refs) and {r.member for r in back.collect()} == {x.member for x in res.refs}


def test_index_keeps_what_is_unchanged(spark, db):
    again = q.index(spark, os.path.join(os.path.dirname(db), "src"), db)
    assert (again["scanned"], again["skipped"]) == (0, len(library.MEMBERS))
    assert [t["stage"] for t in again["timing"]] == ["walk", "plan", "prune", "clear", "parse", "finalize"]
    with q.open_index(spark, db) as i:
        kinds = {r.member: r.kind for r in i.files.collect() if r.library != "TEST.DECKS"}
        assert {m: kinds[m] for m in ("DCLWAGON", "WGNWORK", "WEIGH", "PRWEIGH", "DAILY", "UNWGN", "BYDEPOT", "SCHEMA")} == {"DCLWAGON": "DCLGEN", "WGNWORK": "COPYBOOK", "WEIGH": "COBOL", "PRWEIGH": "PROC", "DAILY": "JCL", "UNWGN": "CONTROL", "BYDEPOT": "SORT", "SCHEMA": "SQL"}
        assert i.sql("SELECT count(DISTINCT table_name) AS n FROM table_refs WHERE access = 'LOCK'").first().n == 0
        assert i.stats()["files"] == len(library.MEMBERS)
    assert {r.table_name for r in q.list_tables(spark, db, like="%AGON")} == {"WAGON", "BIG_WAGON"}
    with pytest.raises(FileNotFoundError):
        q.open_index(spark, db + "-none")


def test_changed_and_deleted_files(spark, tmp_path):
    root, index = str(tmp_path / "src"), str(tmp_path / "index")
    library.write(root, {"L/UP.sql": "SELECT A FROM R.EAST;\n", "L/DOWN.sql": "SELECT A FROM R.WEST;\n"})
    q.index(spark, root, index)
    library.write(root, {"L/UP.sql": "DELETE FROM R.NORTH WHERE A = 10;\n"})
    os.remove(f"{root}/L/DOWN.sql")
    stats = q.index(spark, [root], index)
    assert (stats["scanned"], stats["skipped"], stats["files"]) == (1, 0, 1)
    assert [r.table_name for r in q.list_tables(spark, index)] == ["NORTH"]


def test_columns_and_bindings(fld):
    assert [(c.name, c.sql_type, c.nullable, c.origin) for c in fld.columns] == [("WAGON_NR", "CHAR(12) NOT NULL", False, "CREATE TABLE"), ("TARE_KG", "DECIMAL(7,1)", True, "CREATE TABLE"), ("NOTES", "VARCHAR(120)", True, "CREATE TABLE"), ("DEPOT", "CHAR(3)", True, "CREATE TABLE")]
    # TARE_KG has no field of its name: bound by its place
    assert {(b.column, b.host_field, b.pic, b.line) for b in fld.bindings} == {("WAGON_NR", "WAGON-NR", "X(12)", 5), ("TARE_KG", "WEIGHT", "S9(6)V9 COMP-3", 6), ("NOTES", "NOTES", "X(120)", 8), ("DEPOT", "DEPOT", "X(3)", 11)}
    assert set(fld.layout_dependents) == {"WGNWORK", "REPAINT", "SWEEP"}


def test_embedded_statements(fld):
    assert uses(fld, "WEIGH", "column", "host_var", context="SELECT") == {("TARE_KG", "WEIGHT"), ("DEPOT", "DEPOT")}
    assert uses(fld, "WEIGH", "column", "host_var", "line", context="WHERE") == {("WAGON_NR", "IN-NR", 15)}
    assert uses(fld, "WEIGH", "column", context="ON") == {("WAGON_NR",)}
    assert uses(fld, "REPAINT", "column", "host_var", access="WRITE") == {("NOTES", "NOTES"), ("TARE_KG", "WEIGHT")}
    assert uses(fld, "REPAINT", "column", "access", context="SET-EXPR") == {("TARE_KG", "READ")}
    assert uses(fld, "REPAINT", "column", "host_var", context="WHERE") == {("DEPOT", "DEPOT")}
    assert uses(fld, "SWEEP", "column", "host_var", context="FETCH") == {("WAGON_NR", "WAGON-NR"), ("NOTES", "NOTES")}
    assert uses(fld, "SWEEP", "column", context="ORDER BY") == {("DEPOT",), ("WAGON_NR",)}
    assert uses(fld, "SWEEP", "column", "host_var", context="WHERE", stmt="DECLARE CURSOR") == {("NOTES", "PATTERN")}
    assert uses(fld, "ADHOC", "column") == set() and any("ADHOC" in n for n in fld.notes)


def test_host_variables_are_found_through_copybooks(fld):
    (use,) = [u for u in fld.uses if u.member == "WEIGH" and u.host_var == "WEIGHT"]
    assert use.host_def_path.endswith("/DCLWAGON") and (use.host_def_line, use.host_def_pic) == (6, "S9(6)V9 COMP-3")
    (use,) = [u for u in fld.uses if u.member == "WEIGH" and u.host_var == "IN-NR"]
    assert use.host_def_path.endswith("/WEIGH") and use.host_def_line == 6


def test_scripts_and_decks(fld):
    assert uses(fld, "MOVES", "column", "context", stmt="MERGE", table="WAGON") >= {("WAGON_NR", "ON"), ("DEPOT", "SET"), ("WAGON_NR", "INSERT"), ("DEPOT", "INSERT")}
    assert uses(fld, "MOVES", "column", context="SELECT", table="WAGON") >= {("DEPOT",), ("NOTES",), ("WAGON_NR",)}
    assert uses(fld, "MOVES", "column", context="GROUP BY") == {("NOTES",)}
    assert uses(fld, "SCHEMA", "column", context="INDEX") == {("DEPOT",), ("WAGON_NR",)}
    assert uses(fld, "SCHEMA", "column", stmt="CREATE VIEW") == {("WAGON_NR",), ("TARE_KG",)}
    assert uses(fld, "REFILL", "column", "access", context="LOAD") == {("WAGON_NR", "WRITE"), ("DEPOT", "WRITE")}
    assert {u.column for u in fld.uses if u.member == "UNWGN" and "/RAIL.DECKS/" in u.path} == {"WAGON_NR", "TARE_KG"}
    assert {u.column for u in fld.uses if u.member == "UNWGN" and "/TEST.DECKS/" in u.path} == {"WAGON_NR", "TARE_KG", "NOTES", "DEPOT"}
    assert any("has no column list" in n for n in fld.notes)


def test_program_and_boundary(spark, db):
    b = q.db2_boundary(spark, "WEIGH", db)
    json.dumps(b)
    ends = {e["object"]: e for e in b["endpoints"]}
    assert set(ends) == {"WAGON", "TRIP"} and ends["WAGON"]["access"] == ["READ"]
    assert {(f["column"], f["direction"]): f["hostVars"] for f in ends["WAGON"]["fields"]} == {("TARE_KG", "in"): ["WEIGHT"], ("DEPOT", "in"): ["DEPOT"], ("WAGON_NR", "filter"): ["IN-NR"]}
    assert {f["column"]: f["hostVars"] for f in ends["TRIP"]["fields"] if f["direction"] == "filter"} == {"WAGON_NR": [], "KM": ["HI", "LO"]}
    with pytest.raises(LookupError):
        q.db2_boundary(spark, "NOBODY", db)


def test_summaries_and_reports(spark, db, fld, res):
    from quarrylens.plans.tables import table_summary

    s = fields.field_summary(fld)
    json.dumps(s)
    assert s["columns"]["DEPOT"]["type"] == "CHAR(3)" and {"REFILL", "MOVES"} <= set(s["columns"]["DEPOT"]["written_by"]) and "WEIGH" in s["columns"]["DEPOT"]["read_by"]
    assert "WEIGHT PIC S9(6)V9 COMP-3" in s["columns"]["TARE_KG"]["host_fields"]
    t = table_summary(res)
    assert {"REPAINT", "MOVES", "REFILL"} <= set(t["writers"]) and "EXPORT" in t["jobs"] and t["references"] == len(res.refs)
    table = json.loads(q.table_dependencies_json(spark, "RAIL.TRIP", db))
    assert {"SWEEP", "MOVES"} <= {r["member"] for r in table["refs"] if r["access"] == "WRITE"}
    assert [x["stage"] for x in table["timings"]] == ["targets", "refs", "closure", "jobs", "data-trace", "unresolved-calls", "blind-spots"]
    out = json.loads(q.field_dependencies_json(spark, "RAIL.TRIP", db))
    assert [c["name"] for c in out["columns"]] == ["TRIP_ID", "WAGON_NR", "KM", "FEE"]
    assert {"TRIP_ID", "WAGON_NR"} <= {u["column"] for u in out["uses"] if u["member"] == "MOVES" and u["context"] == "INSERT"}


def test_exports_and_logging(spark, db, res):
    import logging
    import subprocess
    import sys

    from quarrylens.functions.logs import PACKAGE_LOGGER, configure_logging, level_for

    assert all(hasattr(q, n) for n in ("index", "query", "open_index", "tables", "Result", "Store", "Analyzer"))
    with q.open_index(spark, db) as store:
        assert isinstance(store, q.Store)
        again = q.Analyzer(store).analyze("RAIL.WAGON", data_hops=0)
    assert len(again.refs) == len(res.refs) and again.data_links == []
    assert (level_for(), level_for(verbose=1), level_for(quiet=1), level_for(quiet=2), level_for(verbose=1, quiet=1)) == (logging.INFO, logging.DEBUG, logging.WARNING, logging.ERROR, logging.WARNING)
    before = len(logging.getLogger(PACKAGE_LOGGER).handlers)
    for _ in range(3):
        configure_logging(quiet=1)
    assert len(logging.getLogger(PACKAGE_LOGGER).handlers) <= before + 1
    top = os.path.dirname(os.path.dirname(os.path.abspath(q.__file__)))
    assert subprocess.check_output([sys.executable, "-c", "import logging, quarrylens; print(len(logging.getLogger().handlers))"], cwd=top).decode().strip() == "0"


def test_uses_that_no_definition_or_list_tells(spark):
    """Statements without a list of columns, and what they leave open."""
    from quarrylens.operators.uses import column_uses

    texts = ["CREATE TABLE R.T (A INTEGER, B CHAR(1));", "INSERT INTO R.T VALUES (:X, :Y);", "INSERT INTO R.NONE VALUES (:X);", "DELETE FROM R.T C WHERE C.GONE = :Z;", "SELECT A FROM R.T GROUP BY A HAVING MAX(B) > 1 AND A > :H;", "UPDATE R.T SET (A, B) = (:P, :Q), A = B WHERE A NOT IN (:I, :J);"]
    units = spark.createDataFrame([(str(i), 0, 1, None, t) for i, t in enumerate(texts)], "path string, unit int, first long, origin array<int>, text string")
    toks = written(lexer.placed(lexer.structured(lexer.tokens(units))), "tokens")
    files = spark.createDataFrame([("0", "DDL", "SQL")], "path string, member string, kind string")
    known = written(definitions.known_columns(definitions.defined_columns(toks), files), "known")
    found, holes, _ = column_uses(toks, known)
    got = {(r.path, r.column, r.access, r.context, r.host_var) for r in found.collect()}
    assert {x[1:] for x in got if x[0] == "1"} == {("A", "WRITE", "INSERT", "X"), ("B", "WRITE", "INSERT", "Y")}
    assert {x[1:] for x in got if x[0] == "3"} == {("GONE", "READ", "WHERE", "Z")}
    assert ("4", "A", "READ", "HAVING", "H") in got and not any(x[0] == "4" and x[3] == "WHERE" for x in got)
    assert {x[1:] for x in got if x[0] == "5"} == {("A", "WRITE", "SET", "P"), ("B", "WRITE", "SET", "Q"), ("A", "WRITE", "SET", ""), ("B", "READ", "SET-EXPR", ""), ("A", "READ", "WHERE", "I"), ("A", "READ", "WHERE", "J")}
    assert [(r.path, r.kind, r.detail) for r in holes.collect()] == [("2", "INSERT-NO-COLUMNS", "NONE")]
    narrow, _, _ = column_uses(toks, known, ["HAVING"])
    assert {(r.path, r.column, r.host_var) for r in narrow.collect()} == {("4", "A", "H")}
