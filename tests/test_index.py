"""Scripts in chunks, files that cannot be read, versions of the index, the stream."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import quarrylens as q
from quarrylens.functions.storage import written
from quarrylens.operators import lexer, scripts
from quarrylens.plans import index as ix
from quarrylens.sources import artifacts
from tests import library

TOKEN = re.compile(r"""(?s)'[^']*(?:''[^']*)*'?|--[^\n]*|/\*/|/\*.*?(?:\*/|\Z)|"[^"\n]+"|;|[^'"/\-;]+|.""")
BITS = ["SELECT A FROM S.T%d", "'it''s; x'", "'a\nb;", "';", "-- don't; stop\n", "/* c; ' \n", "*/", " ", "\n", ";", ";\n", "\"q;'x\"", "UPDATE S.U%d SET A = 1", "(", "/*/", "/", "*", "'", "--", "\r\n", "\0"]


def plain_statements(text):
    n, line, first, now, out = 0, 1, 1, "", []
    for piece in TOKEN.findall(text.replace("\r\n", "\n").replace("\r", "\n") + "\n"):
        if piece == ";":
            out.append((n + 1, first, now))
            n, first, now = n + 1, line, ""
        else:
            now += piece.replace("\0", " ")
            line += piece.count("\n")
    return [x for x in [*out, (n + 1, first, now)] if x[2].strip()]


@pytest.mark.parametrize("size", [1, 2, 7, 4096])
def test_statements_of_chunks_match_a_plain_scan(spark, size):
    rng = random.Random(size)
    texts = ["".join(b % rng.randrange(99) if "%" in b else b for b in (rng.choice(BITS) for _ in range(rng.randint(1, 60)))) for _ in range(60)]
    rows = [(str(i), k // 5, k, line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    chunks = scripts.line_chunks(spark.createDataFrame(rows, "path string, block long, id long, value string"), size)
    got = sorted((r.path, r.unit, r.first, r.text) for r in scripts.statement_units(chunks).collect())
    assert got == sorted((str(i), *x) for i, t in enumerate(texts) for x in plain_statements(t))
    assert scripts.statement_units(chunks.where("false")).count() == 0


def test_effects_compose(spark):
    rows = [("'a;", "b';c;"), ("/* ; ", "*/ ;"), ("x;--'\n", "y;"), ("/*", "/ */;"), ("'", "';'"), ("", ";")]
    found = spark.createDataFrame([(a + "\n", b) for a, b in rows], "a string, b string").select(scripts.composed(scripts.effect(F.col("a")), scripts.effect(F.col("b"))).alias("two"), scripts.effect(F.concat("a", "b")).alias("one")).collect()
    assert all(r.one == r.two for r in found)


def test_long_literals_do_not_overflow(spark):
    units = spark.createDataFrame([("p", 0, 1, None, "SELECT '" + "x''y" * 50_000 + "' FROM S.T; SELECT 'open " + "z" * 200_000)], "path string, unit int, first long, origin array<int>, text string")
    assert [(r.tok[:8], len(r.tok)) for r in lexer.tokens(units).where("kind = 'str'").orderBy("pos").collect()] == [("'x''yx''", 200_002), ("'open zz", 200_006)]


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("big"))
    filler = "".join(f"SELECT C{i % 7} FROM RAIL.FILLER WHERE NOTE = 'no; UPDATE RAIL.GHOST' /* ; */;\r\n" for i in range(3000))
    library.write(root, {"L/HUGE.sql": "DELETE FROM RAIL.HEAD\n WHERE A = 1;\n" + filler.replace("\r\n", "\n") + "UPDATE RAIL.TAIL SET A = 'x\n;y' WHERE B = 2", "L/SMALL.sql": "SELECT A FROM RAIL.LITTLE;\n", "L/GONE.sql": "SELECT A FROM RAIL.LOST;\n", "L/HUGECOB": library.cobol("HUGECOB", [], ["    EXEC SQL SELECT A INTO :B FROM RAIL.FROMCOB END-EXEC."] + ["    DISPLAY 'X'."] * 3000)})
    return root


def refs_of(rows):
    return sorted((r.path.rsplit("/", 1)[-1], r.line, r.table_name, r.access, r.stmt_name) for r in rows.collect())


def test_a_script_in_chunks_gives_what_it_gives_whole(spark, big, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        stats = ix.build_index(spark, big, str(tmp_path / "chunks"), threshold=20_000)
        ix.build_index(spark, big, str(tmp_path / "whole"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stats["scanned"] == 4
    with q.open_index(spark, str(tmp_path / "chunks")) as a, q.open_index(spark, str(tmp_path / "whole")) as b:
        got = refs_of(a.table_refs)
        assert got == refs_of(b.table_refs) and len(got) > 3000
        assert {("HUGE.sql", 1, "HEAD", "WRITE", "DELETE"), ("HUGE.sql", 3003, "TAIL", "WRITE", "UPDATE"), ("HUGECOB", 6, "FROMCOB", "READ", "SELECT")} <= set(got)
        assert {r.kind for r in a.files.collect()} == {"SQL", "COBOL"}
        assert [(r.kind, r.path[-8:]) for r in a.blind_spots.collect()] == [("CHUNKED", "HUGE.sql")]
        assert b.blind_spots.count() == 0
        # one statement is the most that a task has to hold of the script
        assert a.tokens.groupBy("path", "unit").count().agg(F.max("count")).first()[0] < 60


def test_lines_of_a_file_come_in_several_blocks(spark, big):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = written(artifacts._lines(spark, [big], 20_000), "lines")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lines.where("uri like '%HUGE.sql'").select("block").distinct().count() > 4
    assert lines.where("uri like '%SMALL.sql'").count() == 0


def broken(path, n=4096):
    """A checksum file that does not fit: reading fails as from a bad disk."""
    folder, name = os.path.split(path)
    with open(f"{folder}/.{name}.crc", "wb") as f:
        f.write(b"crc\0\0\0\2\0" + b"\1\2\3\4" * n)


def test_unreadable_files_are_told(spark, big, tmp_path):
    broken(f"{big}/L/GONE.sql")
    broken(f"{big}/L/HUGE.sql")
    stats = ix.build_index(spark, big, str(tmp_path / "index"), threshold=20_000)
    assert stats["files"] == 4
    with q.open_index(spark, str(tmp_path / "index")) as i:
        assert sorted((r.path.rsplit("/", 1)[-1], r.kind, r.error is None) for r in i.files.collect()) == [("GONE.sql", "UNKNOWN", False), ("HUGE.sql", "UNKNOWN", False), ("HUGECOB", "COBOL", True), ("SMALL.sql", "SQL", True)]
        assert {r.table_name for r in i.table_refs.collect()} == {"LITTLE", "FROMCOB"}
        assert sorted((r.path.rsplit("/", 1)[-1], r.kind) for r in i.blind_spots.collect()) == [("GONE.sql", "UNREADABLE"), ("HUGE.sql", "UNREADABLE")]
    assert artifacts.read_artifacts(spark, big).where("content is null").count() == 2


def members(n):
    return {f"L/M{i}.sql": f"SELECT A FROM R.T{i};\n" for i in range(n)}


def test_an_update_costs_what_it_touches(spark, tmp_path):
    root, at = str(tmp_path / "src"), str(tmp_path / "index")
    library.write(root, members(40))
    ix.build_index(spark, root, at, buckets=16)
    first = q.open_index(spark, at)
    assert len(set(first.live.values())) == 1 and len(first.live) > 8
    library.write(root, {"L/M7.sql": "DELETE FROM R.OTHER WHERE A = 10;\n"})
    stats = ix.build_index(spark, root, at)
    second = q.open_index(spark, at)
    assert (stats["scanned"], stats["skipped"], stats["pruned"]) == (1, 39, 0)
    assert sum(first.live[b] != w for b, w in second.live.items()) == 1
    (new,) = set(second.live.values()) - set(first.live.values())
    assert [x for x in os.listdir(f"{at}/data/write={new}/of=files") if x.startswith("bucket=")] == [f"bucket={next(b for b, w in second.live.items() if w == new)}"]
    assert {r.table_name for r in second.table_refs.collect()} == {f"T{i}" for i in range(40) if i != 7} | {"OTHER"}
    # the earlier version stays readable until it is cleared away
    assert {r.table_name for r in ix.open_index(spark, at, 1).table_refs.collect()} == {f"T{i}" for i in range(40)}
    assert ix.build_index(spark, root, at)["scanned"] == 0 and q.open_index(spark, at).version == 2
    assert ix.vacuum(spark, at) > 0 and ix.vacuum(spark, at) == 0
    assert second.table_refs.count() == q.open_index(spark, at).table_refs.count() == 40
    with pytest.raises(FileNotFoundError):
        ix.open_index(spark, at, 1)


def test_a_failed_update_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    root, at = str(tmp_path / "src"), str(tmp_path / "index")
    library.write(root, members(5))
    ix.build_index(spark, root, at)
    os.remove(f"{root}/L/M1.sql")
    library.write(root, {"L/M2.sql": "SELECT A FROM R.CHANGED;\n"})
    monkeypatch.setattr(ix, "token_facts", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ix.build_index(spark, root, at)
    monkeypatch.undo()
    assert {r.table_name for r in q.open_index(spark, at).table_refs.collect()} == {f"T{i}" for i in range(5)}
    # two updates from one version: the later one fails
    real, old = ix._commit, q.open_index(spark, at)

    def late(spark_, path, number, told):
        real(spark_, path, number, told)
        real(spark_, path, number, told)

    monkeypatch.setattr(ix, "_commit", late)
    with pytest.raises(RuntimeError):
        ix.build_index(spark, root, at)
    assert {r.table_name for r in q.open_index(spark, at).table_refs.collect()} == {"T0", "T3", "T4", "CHANGED"} and old.table_refs.count() == 5
    assert all(re.fullmatch(r"\.?[0-9]+\.json(\.crc)?", x) for x in os.listdir(f"{at}/log") if not x.endswith(".crc"))


def test_stream_takes_what_has_come(spark, tmp_path):
    root, at = str(tmp_path / "src"), str(tmp_path / "index")
    library.write(root, members(3))
    assert ix.stream_index(spark, root, at, buckets=4) == 1
    assert ix.stream_index(spark, root, at) == 1
    library.write(root, {"L/NEW.sql": "UPDATE R.LATE SET A = 1;\n", "K/UP": library.cobol("UP", [], ["    EXEC SQL DELETE FROM R.T1 END-EXEC."])})
    assert ix.stream_index(spark, root, at) == 2
    ix.build_index(spark, root, str(tmp_path / "full"))
    with q.open_index(spark, at) as a, q.open_index(spark, str(tmp_path / "full")) as b:
        assert refs_of(a.table_refs) == refs_of(b.table_refs)
        assert sorted(r.path for r in a.files.collect()) == sorted(r.path for r in b.files.collect())


def test_timer():
    told = []
    timer = ix.StageTimer(told.append)
    assert timer.report() == ""
    with timer.stage("a"), timer.stage("b"):
        pass
    timer.start()
    assert timer.since("c") >= 0
    assert [x["stage"] for x in timer.timings()] == ["b", "a", "c"] and len(told) == 3
    assert [line.split()[0] for line in timer.report().split("\n")] == ["b", "a", "c", "total"]
