"""What a worker remembers of pieces stays small, as workers outlive the stage."""

import sys

import public_tokenizers

from quarrylens.llm import packing


def test_remembered_pieces_are_bounded():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = packing.WordTokenizer(path, packing.ranks_of(path))
    most = 0
    for i in range(0, 300_000, 10_000):
        text = " ".join(f"w{n}x" for n in range(i, i + 10_000))
        assert len(tok.encode([text])) == 1
        most = max(most, sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in tok.known.items()))
    assert 0 < most < 24 << 20
    last = tok.encode([text])[0]
    assert last == packing.WordTokenizer(path).encode([text])[0]


def test_rare_words_of_plain_texts_are_not_remembered():
    """Words that come once cost a worker no memory; ids are the library's, for texts at and beyond the bound too."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, plain = packing.WordTokenizer(path, packing.ranks_of(path)), packing.WordTokenizer(path)
    texts = [" ".join(f"w{n}x" for n in range(i, i + 5_000)) for i in range(0, 20_000, 5_000)]
    odd = ["", " ", "a" * packing._WHOLE, " " * packing._WHOLE, "a b " * (packing._WHOLE // 4) + "c", "中 a b", "a b  c", "\r\n \n x", "<|endoftext|> 's"]
    assert tok.encode(texts) == plain.encode(texts)
    assert not tok.known
    assert tok.encode([*odd, *texts, *odd]) == plain.encode([*odd, *texts, *odd])
