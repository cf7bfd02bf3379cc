import numpy as np

from quarrylens.llm import embedding_dedup as ed


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_pairs_that_only_probe_a_shared_cell_are_counted(spark):
    """Pairs whose own cells are not among each other's, both probing the own cell of a third vector, far from them."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(40):
        a = unit(rng.normal(size=(20_000, 16)))
        b = unit(0.952 * a + np.sqrt(1 - 0.952**2) * unit(rng.normal(size=a.shape)))
        (own_a, probed_a), (own_b, probed_b) = ed.cells(a), ed.cells(b)
        meet = (own_a == own_b) | (probed_b == own_a[:, :, None]).any(axis=2) | (probed_a == own_b[:, :, None]).any(axis=2)
        both = (probed_a[:, :, :, None] == probed_b[:, :, None, :]).any(axis=(2, 3))
        for i in np.flatnonzero(~meet.any(axis=1) & both.any(axis=1) & ((a * b).sum(axis=1) >= ed.COSINE)):
            t = both[i].argmax()
            cell = next(c for c in probed_a[i, t] if c in probed_b[i, t])
            near = unit(unit(a[i] + b[i]) + 0.6 * unit(rng.normal(size=(20_000, 16))))
            near = near[(ed.cells(near)[0][:, t] == cell) & (near @ a[i] < 0.94) & (near @ b[i] < 0.94)]
            if len(near):
                rows += [a[i], b[i], near[0]]
        if rows:
            break
    assert rows
    rows = rows[:3]
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicate_vectors(df).collect())
    assert got == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]


def test_vectors_travel_exactly():
    """Single precision where it is exact, double elsewhere, also for rows of both kinds together."""
    single = np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32).astype(np.float64)
    for x in (single, single + 1e-12, np.concatenate([single, single + 1e-12, np.full((1, 5), 1e300)])):
        packed = ed._packed(x)
        assert (ed._unpacked(packed, 5) == x).all()
    assert {len(p) for p in ed._packed(single)} == {20} and {len(p) for p in ed._packed(single + 1e-12)} == {40}
