import numpy as np

from quarrylens.llm import embedding_dedup as ed


def brute(rows):
    ok = {i: np.array(v, float) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    links, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(ok)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (links[i], root(i), root(i) == i) for i, _ in rows}


def test_nearest_point_is_of_e8_and_closest():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = ed.nearest_e8(x)
    assert np.allclose(2 * p, np.rint(2 * p)) and np.allclose(p.sum(axis=1) % 2, 0)
    assert np.all(np.isin((2 * p) % 2, [0, 1]).all(axis=1))
    near = p[:, None] + ed.minimal_vectors()[None]
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - near) ** 2).sum(axis=2) + 1e-9).all()


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(150):
        base = rng.normal(size=48)
        for _ in range(int(rng.integers(1, 5))):
            c, noise = rng.choice([0.999, 0.98, 0.96, 0.94]), rng.normal(size=48)
            noise *= np.linalg.norm(base) / np.linalg.norm(noise)
            rows.append((len(rows), [float(e) for e in c * base + np.sqrt(1 - c * c) * noise]))
    hot = rng.normal(size=48)
    for i in range(150):
        rows.append((5000 + i, [float(e) for e in hot + rng.normal(size=48) * 0.12]))
    rows += [(9000 + i, rows[3][1]) for i in range(40)]
    rows += [(9500, None), (9501, []), (9502, [0.0] * 48), (9503, [float("nan")] * 48), (9504, [None, 1.0]), (9505, [float("inf")] + [1.0] * 47), (9506, [1.0, 0.0]), (9507, [2.0, 0.0]), (9508, [1e-300, 0.0]), (9509, [1e300, 1.0])]
    monkeypatch.setattr(ed, "BLOCK", 32)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicate_vectors(df).collect()}
    want = brute([r for r in rows if r[0] < 9500])
    # no link that is none, nearly all that are, and components exactly as the links that were found make them
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][0] for i in want) >= 0.99 * sum(w[0] for w in want.values())
    groups = {}
    for i in want:
        groups.setdefault(want[i][1], []).append(i)
    whole = [g for g in groups.values() if all(got[i][0] == want[i][0] for i in g)]
    assert len(whole) > 0.9 * len(groups) and all(got[i] == want[i] for g in whole for i in g)
    assert all(got[i][1] in groups[want[i][1]] and got[i][2] == (got[i][1] == i) for i in want)
    assert all(got[i] == (0, i, True) for i in range(9500, 9506))
    assert [got[i][0] for i in (9506, 9507, 9508, 9509)] == [3, 3, 3, 3] and {got[i][1] for i in (9506, 9507, 9508, 9509)} == {9506}


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 4.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in ed.near_duplicate_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False)]
    assert ed.near_duplicate_vectors(df.limit(0)).count() == 0
