"""Every stage of the pipeline on its own predecessor's rows, against plain rules."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quarrylens.llm import near_dedup as nd
from quarrylens.llm import pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(160)]
    toxic = [i for i in range(160) if i % 4 == 0]
    for i in toxic:
        texts[i] = " ".join(x for w in texts[i].split()[:20] for x in (w, "vile", "rotten"))
    base = texts[5].split()
    texts += [texts[1], texts[1].replace(" ", "  "), " ".join([*base[:-1], "changed"]), "mail a.b@c.de now and then", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    top = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), rows, set(toxic)


def test_stages_decide_as_plain_rules_do(spark, folder):
    top, rows, toxic = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, top)
        assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            gone = before.keys() - kept[name].keys()
            assert gone <= toxic and len(gone) > 0.9 * len(toxic)
        elif name == "exact_dedup":
            seen, want = set(), {}
            for i in sorted(before):
                norm = re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or "")
                if norm not in seen:
                    seen.add(norm)
                    want[i] = before[i]
            assert kept[name] == want and 160 not in want and 161 not in want
        elif name == "minhash_near_dedup":
            assert kept[name] == {i: t for i, t in before.items() if not any(j < i and nd.similarity(nd.shingles(t), nd.shingles(u)) >= 0.8 for j, u in before.items())}
            assert 162 not in kept[name]
        else:
            assert kept[name] == {i: t if t is None else pii.redact(t, pii.find(t, pii.model())[1]) for i, t in before.items()}
            assert kept[name][163] == "mail [EMAIL] now and then"
    last = kept["pii"]
    pieces = corpus_pipeline.run(spark, top).collect()
    assert {p.doc_id for p in pieces} == last.keys()
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert all(lengths[p.doc_id] == p.doc_tokens for p in pieces)
    ends = {}
    for p in pieces:
        ends.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= 1024
        assert np.array_equal([o for o, _ in spans[1:]], np.cumsum([n for _, n in spans])[:-1])


def test_an_empty_corpus_gives_no_pieces(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
