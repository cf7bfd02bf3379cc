"""Paths and roots against a tree that is built plainly, level by level."""

import hashlib
import zlib

from pyspark.sql import functions as F

from quarrylens.llm import merkle
from quarrylens.llm.queries import op12_merkle_manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, for each leaf its place and siblings, level by level)."""
    nodes, paths = list(leaves), [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, path in enumerate(paths):
            run, k = runs[at[i] // 8], at[i] % 8
            path.append((k, "".join(run[:k] + run[k + 1 :])))
            at[i] //= 8
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain_leaf(row, columns=("doc_id", "source", "lang", "n_chars", "text")):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))


def plain_manifest(rows):
    out, trees = [], {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    low = [plain_tree([plain_leaf(r) for r in trees[lang]]) for lang in order]
    root, shared = plain_tree([x[0] for x in low])
    for lang, (subroot, paths), above in zip(order, low, shared):
        for row, path in zip(trees[lang], paths):
            out.append((row, plain_leaf(row), subroot, root, path + above))
    return out


def documents():
    rows = []
    for i in range(1, 1400):
        lang = ["big", None, "", "é", "z", "big", "big"][i % 7] if i > 20 else f"lang{i}"
        rows.append({"doc_id": i, "text": [f"Some Text {i}", None, "", "ÄÉ aB" * 30][i % 4], "lang": lang, "source": None if i % 5 == 0 else "src", "n_chars": None if i % 11 == 0 else i})
    # repeated rows, an id with two texts, null ids
    return rows + rows[30:45] + [{**rows[50], "text": "another"}, {**rows[60], "doc_id": None}, {**rows[60], "doc_id": None}]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_paths_within_a_block_and_what_is_held():
    for n in (*range(1, 75), 511, 512, 513, 4096):
        leaves = [sha(str(i)).encode() for i in range(n)]
        height = next(h for h in range(9) if n <= 8**h)
        root, want = plain_tree([x.decode() for x in leaves])
        assert merkle.block_root(leaves, height).decode() == root
        most = 0
        for (held, levels), path in zip(merkle.authentication_paths(leaves, height), want, strict=True):
            assert [(at, b"".join(run[:at] + run[at + 1 :]).decode()) for at, run in levels] == path
            most = max(most, held)
        # the eight nodes of a level's run, those of its next one, and few that wait
        assert most <= 24 * max(1, height)


def test_a_block_that_is_not_alone_has_full_height():
    leaves = [sha("x").encode()]
    assert merkle.height_of(0, 1) == 0 and merkle.height_of(0, 512) == 3 and merkle.height_of(3, 1) == 3
    assert merkle.block_root(leaves, 3).decode() == sha(sha(sha(sha("x"))))


def test_manifest_matches_a_plain_tree(spark):
    rows = documents()
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "rank", "path", "digest", "node")}).repartition(7)
    got = sorted((r.doc_id or -1, r.leaf, r.received_leaf, r.subroot, r.root, tuple((p.position, p.siblings) for p in r.path)) for r in merkle.manifest(docs).collect())
    want = sorted((row["doc_id"] or -1, leaf, leaf, subroot, root, tuple(path)) for row, leaf, subroot, root, path in plain_manifest(rows))
    assert got == want
    assert merkle.manifest(docs.where("false")).collect() == []
    one = merkle.manifest(docs.where("doc_id = 1")).first()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op12_merkle_manifest(spark, str(tmp_path)).collect())
    want = []
    for row, leaf, subroot, root, path in plain_manifest(rows):
        node = leaf
        if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
            node = plain_leaf({**row, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])})
        for at, siblings in path:
            node = sha(siblings[: 64 * at] + node + siblings[64 * at :])
        want.append((row["doc_id"] or -1, leaf, subroot, root, sha("".join(s for _, s in path)), node, node == root))
    assert got == sorted(want)
    assert {x[-1] for x in got} == {True, False}
