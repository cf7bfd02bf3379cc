"""Runs of words against a definition that compares all places, and the query against plain rules."""

import hashlib
import random
import zlib

import numpy as np

from quarrylens.llm import periodic
from quarrylens.llm.queries import planted_repeats, op11_periodic_runs


def plain_runs(w, least=12):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if len(stretch) >= max(least, 2 * q) and min(d for d in range(1, q + 1) if stretch[d:] == stretch[:-d]) == q:
                out.add((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_match_the_definition():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randint(0, 90), rng.choice([1, 2, 3, 30])
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        for least in (2, 5, 12):
            assert periodic.periodic_stretches(np.array(w, np.int32), least) == plain_runs(w, least)


def test_long_texts_with_short_and_long_periods():
    noise = np.random.default_rng(2).integers(0, 5000, 60000).astype(np.int32)
    for q, begin, length in ((1, 100, 40000), (7, 5, 50001), (123, 1000, 9000), (9001, 17, 40000)):
        w = noise.copy()
        w[begin : begin + length] = w[begin : begin + q][np.arange(length) % q]
        w[begin - 1], w[begin + length] = -1, -2
        assert (begin, length, q) in periodic.periodic_stretches(w)
    two = np.tile(np.arange(1500, dtype=np.int32), 20)
    assert periodic.periodic_stretches(two) == [(0, 30000, 1500)]


def test_runs_of_documents(spark):
    line = "a b c d e f "
    rows = [(1, line * 3, "x"), (2, None, "x"), (3, "", None), (4, " \x0b\t\n", "y"), (1, line * 3, "x"), (5, "é é " * 12, "z"), (6, "a\x0bb\x0cc\rd " * 4, "z"), (None, line, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=repr)
    assert got == sorted([
        (1, 18, [(0, 18, 6)], "a b c d e f"), (1, 18, [(0, 18, 6)], "a b c d e f"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 12, [(0, 12, 1)], "é é"), (6, 16, [(0, 16, 4)], "a b c d"), (None, 6, [], "a b c d e f"),
    ], key=repr)
    assert periodic.periodic_runs(docs.where("false")).collect() == []
    assert periodic.periodic_runs(docs, least=6).where("doc_id is null").first().runs == []


def test_query_follows_its_rules(spark, tmp_path):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("alpha beta gamma delta".split() + [f"w{rng.randrange(99)}"]) for _ in range(rng.randint(0, 70))) for i in range(600)}
    texts |= {600: None, 601: "", 602: " x  y\n" * 9, 603: "one"}
    # a tenth of ids repeat their words, also where the text is null, empty or one word
    texts |= {i: t for t, i in zip((None, "", "w", "a  b"), (i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert planted_repeats(docs).count() == len(texts)
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    seen = 0
    for i, text in texts.items():
        words = planted((text or "").split(), i)
        runs = plain_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
        seen += len(runs)
    assert seen > 20
