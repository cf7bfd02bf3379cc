import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from quarrylens.llm import ppm


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*ppm.words_of(t), ppm.END] for i, t in rows}
    c = Counter(w for i, _ in rows if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    trie = defaultdict(Counter)
    for w, k in c.items():
        s = b" " + (w if w == ppm.END else w + b" ")
        for i in range(1, len(s)):
            for o in range(min(i, ppm.ORDER) + 1):
                trie[s[i - o : i]][s[i]] += k

    def code(w):
        s, total = b" " + (w if w == ppm.END else w + b" "), 0.0
        for i in range(1, len(s)):
            out = set()
            for o in range(min(i, ppm.ORDER), -1, -1):
                left = {b: k for b, k in trie.get(s[i - o : i], {}).items() if b not in out}
                if not left:
                    continue
                size = sum(left.values()) + len(left)
                if s[i] in left:
                    total += math.log10(left[s[i]] / size)
                    break
                total += math.log10(len(left) / size)
                out |= set(left)
            else:
                total -= math.log10(256 - len(out))
        return total

    codes = {}
    for i in tokens:
        for w in tokens[i]:
            codes.setdefault(w, code(w)) if w not in codes else None
    return {i: (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i]), sum(codes[w] for w in tokens[i])) for i, _ in rows}


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 20_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(90_001, None), (90_002, ""), (90_003, " \t "), (90_004, "THE the Ä \x1c x"), (90_005, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = {r.doc_id: r for r in ppm.score_texts(df).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for i, w in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert np.allclose([g.base_score, g.score], w[4:], rtol=1e-9), i
    out = [g for g in got.values() if g.held_out]
    monkeypatch.setattr(ppm, "ORDER", 1)
    shallow = brute(rows)
    assert sum(g.score for g in out) > 0.85 * sum(shallow[g.doc_id][5] for g in out)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = ppm.score_texts(df).collect()
    assert len(rows) == 3 and all(r.train_tokens == 8 for r in rows)
    assert ppm.score_texts(df.limit(0)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in ppm.score_texts(spark.createDataFrame([(i, "x") for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect())
