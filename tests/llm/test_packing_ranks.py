import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylens.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKED = packing.WordTokenizer(BPE, packing.ranks_of(BPE))


def ids_of(texts):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def check(texts):
    assert RANKED.by_rank is not None
    got = [list(memoryview(x).cast("I")) for x in RANKED.encode(texts)]
    assert got == ids_of(texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aabcdehnorst  '\n\t.é'ß12Ωя漢 \u0085<|>", max_size=40), max_size=4))
def test_ids_by_rank_are_those_of_the_library(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    check([t.encode("utf-8", "replace").decode() for t in texts])


def test_ids_of_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    check([*texts, "<|endoftext|> x", "a " * 50_000])


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    import json

    with open(BPE, encoding="utf-8") as file:
        held = json.load(file)
    held["model"]["merges"] = held["model"]["merges"][::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(held))
    assert packing.ranks_of(str(path)) is None
