import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import exact_dedup, packing, toxicity, url_filter

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "a\tb"), (6, "x" * 50_000), (7, "a b "), (7, "a b "), (9, " "), (None, "a b")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")


def test_exact_dedup_matches_brute_force(spark):
    rows = exact_dedup.exact_duplicates(docs(spark), capacity=1).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    low = {t: min(i for i in ids if i is not None) for t, ids in groups.items()}
    want = sorted((i or 0, low[t], len(groups[t]), i == low[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    kept = exact_dedup.without_copies(docs(spark)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 6, 7, 7, 9]


def test_directory_doubles_until_buckets_fit(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    index, cells = exact_dedup.build_index(rows, capacity=100)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 4000
    depths = {r.local_depth for r in cells.collect()}
    assert min(depths) >= 5
    assert index.groupBy("bucket", "key").count().where("count > 1").count() == 0


def test_colliding_keys_are_chained(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.lit(7).cast("long") + exact_dedup.F.length(c) * 0)
    rows = exact_dedup.exact_duplicates(docs(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in rows) == [(1, 1), (2, 2), (3, 1)]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        d, _, p = rule.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p):
            return host, path, rule, verdict
    bad = any(host == k or host.endswith("." + k) for k in url_filter.LISTED)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x", "http://org", "http://x.org/", "https://b.com/de/x#y", "http://com/fr/", None, "nothing", "",
            "http://cheap-pills.example.com/en/4", "http://a.cheap-pills.example.com", "http://notcheap-pills.example.com/", "http://h/p://q", "x" * 30_000 + "://h.com/de/", "http://ÄB.com/de/"]
    urls += [f"http://h{i}.example.net/en/{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(rows).collect()}
    assert got == {i: brute_judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 60).selectExpr("concat('k', id) as key")
    universe = spark.range(0, 900).selectExpr("concat('k', id) as key")
    levels = url_filter.build_cascade(listed, universe, bits_per_key=4, hashes=2)
    assert len(levels) > 2
    hits = universe.where(url_filter.member(levels, url_filter.F.col("key"))).collect()
    assert {r.key for r in hits} == {f"k{i}" for i in range(60)}
    with pytest.raises(ValueError):
        url_filter.build_cascade(listed, universe, max_bytes=8)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\t'1é中\u00a0<|>endoftx", max_size=60))
def test_piecewise_tokens_equal_whole_tokens(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    (data,) = packing.tokenizer(BPE).encode([text])
    assert np.frombuffer(data, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, size=1024):
    tok = packing.tokenizer(BPE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in texts:
        (p,) = tok.encode([text or ""])
        data = p + b"\0\0\0\0"
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(data) // 4
            assert r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(data) // 4
    used = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        used += at if at & (at - 1) == 0 else size
    return used / sum(r.length for r in rows)


def test_packing(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    assert check_packing(packing.pack(table, BPE).collect(), texts) < 1.01
    odd = [(1, None), (2, ""), (3, "a  b   c \n \n d"), (4, "word " * 9000), (5, "x" * 30_000)]
    check_packing(packing.pack(docs(spark, odd), BPE).collect(), odd)
    assert packing.pack(docs(spark, []), BPE).count() == 0


def test_packing_over_block_borders():
    packer = packing.Packer(64, block=500)
    rng, out, sizes = np.random.default_rng(0), [], {}
    for i in range(200):
        n = int(rng.integers(0, 90))
        sizes[i] = n + 1
        out += packer.add(i, rng.integers(0, 5, n).astype("<u4").tobytes(), np.arange(5) == 0)
    out += packer.flush()
    got = defaultdict(int)
    for d, start, n, *_ in out:
        assert start == got[d]
        got[d] += n
    assert got == sizes


@given(st.lists(st.integers(1, 9), min_size=1, max_size=9), st.data())
def test_cuts_are_optimal(gaps, data):
    pos = [0, *np.cumsum(gaps).tolist()]
    pen = [0.0] + [data.draw(st.sampled_from([0.0, 1.0, 4.0])) for _ in gaps]
    size = 10

    def cost(chosen):
        return sum(size - (pos[b] - pos[a]) + pen[b] for a, b in zip(chosen, chosen[1:]))

    best = {0: 0.0}
    for j in range(1, len(pos)):
        best[j] = min(best[i] + size - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= size)
    assert cost(packing.cuts(pos, pen, size)) == best[len(pos) - 1]


def test_toxicity_on_held_out_rows(spark):
    table, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(table, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs(spark), labels).collect()
    assert len(rows) == len(TEXTS) and all(r.score is not None and r.held_out is not None for r in rows)
    untrained = toxicity.toxicity(docs(spark), labels.limit(0)).collect()
    assert len(untrained) == len(TEXTS) and not any(r.predicted for r in untrained)
    assert toxicity.without_toxic(docs(spark), labels.limit(0)).count() == len(TEXTS)
    one_kind = spark.createDataFrame([(i, 0) for i in range(1, 8)], "doc_id long, toxic int")
    assert not any(r.predicted for r in toxicity.toxicity(docs(spark), one_kind).collect())
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.without_toxic(docs(spark), labels).columns == ["doc_id", "text", "key"]


def test_toxicity_learns_from_so_many_bytes(spark):
    """Rows are taken in the order of the id's hash while their features fit; all that fit are learnt from as before."""
    bad, good = "awful vile words here", "calm kind words there"
    rows = [(i, bad if i % 2 else good) for i in range(1, 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    whole = toxicity.train(table, labels)
    size = 4 * len(np.unique(toxicity.features(bad, 20)))
    n = table.where(toxicity.fold(toxicity.F.col("doc_id"), 5) != 0).count()
    for kept in (n, 60):
        at, w, bias = toxicity.train(table, labels, max_bytes=size * kept)
        want = whole if kept == n else toxicity.train(table, labels, max_train=kept)
        assert np.array_equal(at, want[0]) and np.array_equal(w, want[1]) and bias == want[2]
    assert toxicity.train(table, labels, max_bytes=0)[2] == toxicity.UNTRAINED


def test_toxic_weights_match_a_plain_ftrl(spark):
    """The learner by its definition, one coordinate at a time."""
    rng = np.random.default_rng(2)
    rows = [(rng.choice(40, size=6, replace=False), int(rng.random() < 0.4)) for _ in range(120)]
    model = toxicity.Ftrl(bits=6, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n = [0.0] * 64, [0.0] * 64

    def weight(i):
        if abs(z[i]) <= 0.3:
            return 0.0
        return -(z[i] - (0.3 if z[i] > 0 else -0.3)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    for at, label in rows:
        model.learn(np.array(at), label)
        w = [weight(i) for i in at]
        g = 1 / (1 + np.exp(-sum(w))) - label
        for i, x in zip(at, w, strict=True):
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * x
            n[i] += g * g
    assert np.allclose(model.weights()[:64], [weight(i) for i in range(64)])
