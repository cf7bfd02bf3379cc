import numpy as np
import pyarrow as pa

from quarrylens.llm import ppm


def _turns(block, texts):
    """Rows of one block as the last step gets them: answers, then a row of texts a document."""
    streams = [ppm.stream_of(t) for t in texts]
    grams = np.unique(np.concatenate([ppm.grams_of(np.frombuffer(s, np.uint8), True) for s in streams]))
    rows = [{"turn": 2 * block, "gram": int(g), "word": None, "value": -float(block + 1)} for g in grams if g >= 0]
    rows += [{"turn": 2 * block, "gram": None, "word": w, "value": 1.0} for w in {*b" ".join(streams).split(), ppm.END}]
    docs = [{"block": block, "doc_ids": [100 * block + n], "held": [False], "sizes": [len(s)], "packed": pa.compress(s, codec="zstd", asbytes=True)} for n, s in enumerate(streams)]
    for b in ppm._bundled(iter(pa.Table.from_pylist(docs).to_batches())):
        rows += [{"turn": 2 * r["block"] + 1, "gram": None, "word": r["word"], "value": None} for r in b.to_pylist()]
    return rows, {100 * block + n: -(block + 1.0) * (len(s) - 1) for n, s in enumerate(streams)}


def test_blocks_of_a_task_are_scored_as_their_rows_come():
    """Batches cut through answers and texts; a block is scored by its own answers, of which one block's are held at a time."""
    parts = [_turns(b, ["a b c", "the b", None, "c c c a"]) for b in range(5)]
    rows, want = [r for p, _ in parts for r in p], {k: v for _, w in parts for k, v in w.items()}
    schema = pa.schema([("turn", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("value", pa.float64())])
    for n in (1, 3, 7, len(rows)):
        batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=n)
        got = {r["doc_id"]: r["score"] for b in ppm._scored(True, 9, 10.0)(iter(batches)) for r in b.to_pylist()}
        assert got == want


def test_counts_of_sorted_pieces_are_summed():
    rng = np.random.default_rng(3)
    pieces = [np.unique(rng.integers(0, 500, n), return_counts=True) for n in (0, 1, 300, 4000)]
    grams, n = ppm._summed(np.concatenate([g for g, _ in pieces]), np.concatenate([c for _, c in pieces]))
    assert (np.diff(grams) > 0).all() and n.sum() == 4301
    assert dict(zip(grams.tolist(), n.tolist())) == {g: sum(int(c[v == g].sum()) for v, c in pieces) for g in set(grams.tolist())}
