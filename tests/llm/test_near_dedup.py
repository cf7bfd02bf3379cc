import random
from collections import defaultdict

import numpy as np

from quarrylens.llm import near_dedup as nd
from quarrylens.llm.common import components


def brute_classes(rows):
    sets = {i: nd.shingles(t) for i, t in rows}
    ids = sorted(i for i in sets if len(sets[i][0]))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i in ids:
        for s in sets[i][0].tolist():
            holders[s].append(i)
    pairs = {(a, b) for x in holders.values() for a in x for b in x if a < b}
    for a, b in pairs:
        if nd.similarity(sets[a], sets[b]) >= 0.8:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in sets}


def test_components_of_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7000, 5000), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000, 1002: 1000, 5000: 5000, 7000: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = nd.mix(np.arange(300, dtype=np.uint64))
    for shift in (0.0, 0.5, 2.0):
        a, b = rng.random(300) * 3, np.zeros(300)
        b = np.abs(a + rng.normal(0, shift, 300)) + 1e-6
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        x, y = nd.darts(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 2000)
        assert abs((x == y).mean() - want) < 0.04


def test_classes_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):  # one large group of near copies, each with its own change
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((100_000 + i, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # neighbours are similar, ends are not
        rows.append((200_000 + i, " ".join(chain[i * 8 : i * 8 + 110])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(df).collect()}
    assert got == brute_classes(rows)
    kept = {r.doc_id for r in nd.first_of_each_class(df).collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "a " * 20_000), (6, "a " * 20_000), (6, "a " * 20_000), (None, "one two"), (8, "one")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = sorted((r.doc_id or 0, r.class_id) for r in nd.near_duplicate_classes(df).collect())
    assert got == [(0, None), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (6, 5), (8, 8)]
    assert nd.near_duplicate_classes(df.limit(0)).count() == 0
    assert nd.first_of_each_class(df).columns == df.columns


def test_a_large_group_just_below_the_threshold_stays_apart_and_its_pairs_above_are_found(spark):
    """Copies of one text, each with changes of its own: most pairs are too unlike, planted ones are linked."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(0, 400, 6), 5):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:  # a planted partner with one change
            words[397] = "y"
            rows.append((10_000 + i, " ".join(words)))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = [i for i in range(0, 500, 10) if want[10_000 + i] == want[i]]
    assert len(planted) == 50 and sum(got[10_000 + i] == got[i] for i in planted) >= 0.99 * len(planted)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
