"""Units of one text are folded once a batch; each keeps its own lines. References need few of the tokens."""

import pyarrow as pa

from quarrylens.operators import lexer, references


def test_alike_units_are_lexed_once_and_keep_their_lines(monkeypatch):
    texts = ["SELECT A\nFROM T;", "DELETE FROM U", "SELECT A\nFROM T;", None, "SELECT A\nFROM T;"] + ["SELECT '" + "x" * lexer._SHORT + "'"] * 2
    seen, real = [], lexer._lexed
    monkeypatch.setattr(lexer, "_lexed", lambda text, *rest: seen.append(text) or real(text, *rest))
    origin = [[None, 70], None, [5, 9, 11], None, [3], [8], None]
    first = [1, 4, 2, 1, None, 1, None]
    kinds = {"path": pa.string(), "unit": pa.int32(), "first": pa.int64(), "text": pa.string(), "origin": pa.list_(pa.int32())}
    columns = {"path": list("abcdefg"), "unit": range(7), "first": first, "text": texts, "origin": origin}
    batch = pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], list(kinds))
    got = {}
    for b in lexer._folded(iter([batch])):
        for r in b.to_pylist():
            got.setdefault(r["path"], []).append((r["tok"], r["line"]))
    assert len([t for t in seen if t == texts[0]]) == 1
    assert [x for _, x in got["a"]] == [1, 1, 70, 70, 70]
    assert [x for _, x in got["c"]] == [5, 5, 9, 9, 9]
    assert [x for _, x in got["e"]] == [3, 3, None, None, None]
    assert got["b"] == [("DELETE", 4), ("FROM", 4), ("U", 4)]
    assert [x for _, x in got["f"]] == [8, 8]
    assert [x for _, x in got["g"]] == [None, None]
    assert "d" not in got


def test_references_come_from_the_tokens_that_are_kept(spark):
    texts = ["WITH C AS (SELECT A FROM S.T), D(X) AS (SELECT 1 FROM C) SELECT * FROM C, D, E JOIN F ON 1 = 1;", "REORG TABLESPACE DB.TS; UNLOAD TABLESPACE DB.U1;", "MERGE INTO A USING B ON A.X = B.X WHEN MATCHED THEN UPDATE SET X = 1;", "CREATE UNIQUE INDEX I ON S.T (A);", "UPDATE C SET A = 1; SELECT A FROM B FOR UPDATE OF A"]
    units = spark.createDataFrame([(f"p{i}", 0, 1, t) for i, t in enumerate(texts)], "path string, unit int, first long, text string").selectExpr("path", "unit", "first", "cast(null as array<int>) as origin", "text")
    toks = lexer.placed(lexer.structured(lexer.tokens(units))).persist()
    kept = references.reference_tokens(toks)
    told = lambda rows: sorted(map(str, references.table_references(rows).collect()))
    assert told(kept) == told(toks)
    assert 0 < kept.count() < toks.count() / 3
    toks.unpersist()
