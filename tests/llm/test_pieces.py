import itertools
import struct

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdethion  .\n▁é中ß\t<s>0x1A", max_size=40))
def test_ids_are_those_of_the_library(text):
    (ids,) = P.pieces(PATH, "bpe").encode([text])
    assert ids.tolist() == SP.encode(text)


def test_whole_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = P.encode(table, PATH).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: SP.encode(t) for i, t in texts.items()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    back = P.decode(P.encode(table, PATH), PATH).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_edges(spark):
    odd = [(1, None), (2, ""), (3, " "), (4, "   a  b "), (5, "x" * 5000), (6, "\u0000퟿😀"), (6, "\u0000퟿😀")]
    df = spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in P.encode(df, PATH).collect()}
    assert got == {i: SP.encode(t) if t else [] for i, t in odd}
    assert P.encode(df.limit(0), PATH).count() == 0
    assert [r.text for r in P.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).orderBy("doc_id").collect()] == [None, ""]


@given(st.lists(st.text(alphabet="abcx", min_size=1, max_size=7), min_size=1, max_size=6))
def test_unigram_viterbi_is_best(words):
    table = {p: (i, s) for i, (p, s) in enumerate({"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.1, "bc": -4.0, "abc": -6.0, "ca": -4.5}.items())}
    model = P.Pieces(table, None, 99, "unigram")
    for word, ids in model.segment(sorted(set(words))):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            if all(p in table or len(p) == 1 for p in parts):
                score = sum(table[p][1] if p in table else model.floor for p in parts)
                best = score if best is None else max(best, score)
        named = {i: s for i, s in table.values()}
        if 99 not in ids:
            assert abs(sum(named[i] for i in ids) - best) < 1e-9


def unigram_model(path, fallback):
    """A model file of given pieces and scores, for the library and ours alike; nothing is trained."""
    field = lambda n, body: bytes([n << 3 | 2]) + (bytes([len(body)]) if len(body) < 128 else bytes([len(body) & 127 | 128, len(body) >> 7])) + body
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))
    normal = {"▁": -3.0, "a": -4.0, "b": -4.5, "c": -5.0, "▁a": -4.2, "ab": -5.5, "▁ab": -6.25, "bc": -6.0, "abc": -8.5, "ca": -7.0, "▁▁": -5.25, "é": -9.0}
    told = [piece("<unk>", 0.0, 2), piece("<s>", 0.0, 3), piece("</s>", 0.0, 3)]
    told += [piece(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else []
    told += [piece(p, s, 1) for p, s in normal.items()]
    trainer = b"\x18\x01" + (b"\x98\x02\x01" if fallback else b"")
    normalizer = field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    path.write_bytes(b"".join(told) + field(2, trainer) + field(3, normalizer))
    return str(path)


def test_unigram_models_through_spark(spark, tmp_path):
    """Ids of the library, with byte pieces and with the unknown piece; what decodes is the text, or the library's mark of the unknown."""
    texts = [None, "", " ", "abc", "abcabc ca", "  ab  bc ", "abxbc", "xyz", "é a\u0000中中b", "abc " * 3000]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, "abc"])], "doc_id long, text string, ids int")
    for fallback in (True, False):
        path = unigram_model(tmp_path / f"{fallback}.model", fallback)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        coded = P.encode(rows, path, kind="unigram")
        got = {r.doc_id: r for r in coded.collect()}
        want = {i: library.encode(t) if t else [] for i, t in enumerate([*texts, "abc"])}
        assert {i: r.ids for i, r in got.items()} == want
        assert all(r.n_ids == len(r.ids) for r in got.values()) and all(got[i].round_trip for i in (0, 1, 3, 4, 9))
        back = {r.doc_id: r.text for r in P.decode(coded, path, kind="unigram").collect()}
        assert back == {i: library.decode(x) for i, x in want.items()}
        assert P.encode(rows.limit(0), path, kind="unigram").count() == 0
