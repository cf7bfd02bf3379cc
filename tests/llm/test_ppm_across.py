import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from unittest import mock

import numpy as np
import pyarrow as pa

import __spark_entry__
from quarrylens.functions.storage import shared_dir
from quarrylens.llm import ppm


def brute(rows):
    """Scores by a trie over whole texts: contexts are the ORDER bytes before, wherever the word marks stand."""
    streams = {i: b" " + b"".join(w + b" " for w in ppm.words_of(t)) + ppm.END for i, t in rows}
    trie = defaultdict(Counter)
    for i, s in streams.items():
        if zlib.crc32(str(i).encode()) % 10:
            for at in range(1, len(s)):
                for o in range(min(at, ppm.ORDER) + 1):
                    trie[s[at - o : at]][s[at]] += 1

    def code(s, at):
        out, total = set(), 0.0
        for o in range(min(at, ppm.ORDER), -1, -1):
            left = {b: k for b, k in trie.get(s[at - o : at], {}).items() if b not in out}
            if not left:
                continue
            size = sum(left.values()) + len(left)
            if s[at] in left:
                return total + math.log10(left[s[at]] / size)
            total += math.log10(len(left) / size)
            out |= set(left)
        return total - math.log10(256 - len(out))

    return {i: sum(code(s, at) for at in range(1, len(s))) for i, s in streams.items()}


def test_contexts_run_across_word_marks(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 20_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(90_001, None), (90_002, ""), (90_003, " \t "), (90_004, "THE the Ä \x1c x"), (90_005, "a b c d e f g"), (90_006, "\x00 \x00\x00 ab\x00 abc abcd abcde")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ppm.score_texts(df, across=True).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert np.allclose([got[i] for i in want], list(want.values()), rtol=1e-9)


def test_registered_query_tells_word_order(spark, tmp_path):
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs away from it") for i in range(30)]
    rows.append((100, " ".join(reversed(rows[0][1].split()))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in __spark_entry__.queries()["op7_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[0] > got[100] + 1


def test_blocks_stay_small_and_what_is_read_no_more_is_deleted(spark):
    """A worker holds 16 MB of text at a time; of the tables between stages only those that the answer reads are left."""
    text = " ".join(f"w{n}" for n in range(100_000))
    rows = [pa.RecordBatch.from_pydict({"id": [i], "text": [text]}) for i in range(30)]
    held = {}
    with mock.patch.object(ppm.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
        for b in ppm._blocks(True, ppm.BLOCK_BYTES)(iter(rows)):
            for block, sizes in zip(b.column("block").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                held[block] = held.get(block, 0) + sum(sizes or [])
    assert len(held) > 1
    assert max(held.values()) <= (16 << 20) + len(text) + 3

    home = Path(shared_dir(spark).removeprefix("file:"))
    before = set(home.iterdir())
    assert ppm.score_texts(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), across=True).count() == 2
    assert sorted(p.name.split("-")[0] for p in set(home.iterdir()) - before) == ["blocks", "lengths", "words"]
