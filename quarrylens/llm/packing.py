"""Order-preserving packing of documents into sequences by dynamic programming.

Documents are tokenised, joined in order and cut into windows of at most ``size`` tokens. Cut candidates are the
ends of documents and sentences, and points inside long sentences; a window costs its padding plus a penalty for
where it is cut. With F(j) the least cost of all up to candidate j,
F(j) = min over i with pos(j) - pos(i) <= size of F(i) + pos(i), plus size - pos(j) + penalty(j):
a sliding-window minimum, kept in a monotone queue, so the work is linear in the candidates.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs in tokens of padding: a cut at a sentence's end and one inside a sentence; at a document's end it is free.
AT_SENTENCE, IN_SENTENCE = 1.0, 8.0
#: A candidate at every multiple of so many tokens, of which the window's size is one: full windows can follow each other.
STRIDE = 64
#: Tokens whose windows are chosen together.
BLOCK = 1 << 20
_UNSAFE = re.compile(r"\s \s")
#: How byte-level vocabularies write a line feed.
_NEWLINE = "\u010a"
#: Bytes of pieces and ids that a worker remembers, about; then it starts anew. Workers outlive the stage, and so does this.
_CACHE_BYTES = 32 << 20


#: Pieces of these characters alone are split alike by both libraries, whatever their Unicode tables.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*+\Z")
#: Characters of a text of plain characters that is merged whole: most words of a corpus are rare, so looking them up costs
#: more than merging them again. Longer ones go by pieces, as the splitting rule steps back over a run of white space.
_WHOLE = 1 << 16
#: The splitting rule of byte-level vocabularies: a fixed value.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def ranks_of(path: str) -> dict[bytes, int] | None:
    """Token bytes with their ids, if merging by the least id gives what the vocabulary's list of pairs gives; else None.

    That is so if ids follow the order of the list, no two pairs give one token, and every token's own bytes, merged
    by pairs, give the token: two neighbours whose bytes make a token can then only be that token's pair.
    """
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, split = held["model"], held.get("pre_tokenizer") or {}
    plain = (model.get("type"), split.get("type"), split.get("use_regex"), split.get("add_prefix_space"), held.get("normalizer")) == ("BPE", "ByteLevel", True, False, None)
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # byte-level tokens write printable bytes as themselves and the others, in order, as characters from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or len(model["vocab"]) - len(set(ids)) - 256 > len(held["added_tokens"]):
        return None
    order = {p: n for n, p in enumerate(pairs)}
    for a, b in pairs:
        parts = list(a + b)
        while len(parts) > 1:
            n, at = min((order.get(p, len(order)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if n == len(order):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}


class WordTokenizer:
    """Token ids of texts by ``tokenizers``; pieces between single spaces are encoded once and remembered.

    The byte-level splitting rule always starts a new word at a space before a non-space, so the ids of a text are
    the ids of its pieces; texts with other runs of white space around a space are encoded whole. New pieces are
    encoded many in one string and told apart by the byte lengths of their tokens. With ``ranks`` texts of plain
    characters, and new pieces of them in other texts, are merged by rank, which gives the same ids sooner.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.by_rank = None
        if ranks is not None:
            import tiktoken

            self.by_rank = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.bytes_of, self.ending = np.zeros(size, np.int64), np.zeros(size, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():  # byte-level tokens: one character a byte
            self.bytes_of[i], self.ending[i] = len(token), token[-1] in ".!?" or _NEWLINE in token

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        self.held += 200 * len(pieces) + 4 * sum(map(len, pieces))
        joined = [p for p in pieces if p[:1] == " " and len(p) > 1 and not p[1].isspace()]
        plain = [p for p in joined if _PLAIN.match(p)] if self.by_rank else []
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            self._tell(part, np.array(self.by_rank.encode_ordinary("".join(part)), "<u4").tobytes())
        joined = [p for p in joined if p not in self.known] if plain else joined
        for i in range(0, len(joined), 4000):
            part = joined[i : i + 4000]
            self._tell(part, *self._encode(["".join(part)]))
        single = [p for p in pieces if p not in self.known]
        self.known.update(zip(single, self._encode(single), strict=True))

    def _tell(self, part: list[str], data: bytes) -> None:
        """Remember the ids of pieces that were encoded in one string."""
        ends = np.cumsum([len(p.encode("utf-8")) for p in part])
        at = (np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(data, "<u4")]), ends) + 1) * 4
        at = [0, *at.tolist()]
        self.known.update(zip(part, (data[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        if self.by_rank is None:
            return self._by_pieces(texts)
        whole = [len(t) <= _WHOLE and _PLAIN.match(t) is not None for t in texts]
        rest = iter(self._by_pieces([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [np.asarray(array("I", self.by_rank.encode_ordinary(t))).astype("<u4").tobytes() if w else next(rest) for t, w in zip(texts, whole, strict=True)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if self.held > _CACHE_BYTES:
            self.known, self.held = {}, 0
        cut = [[t] if "\0" in t or _UNSAFE.search(t) else t.replace(" ", "\0 ").split("\0") for t in texts]
        met: set[str] = set()
        for c in cut:
            if len(c) > 1:
                met.update(c)
        known = self.known
        self._learn([p for p in met if p not in known])
        get = known.__getitem__
        return [b"".join(map(get, c)) if len(c) > 1 else self._encode(c)[0] for c in cut]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str, ranks: dict[bytes, int] | None = None) -> WordTokenizer:
    """One for each file and worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path, ranks)
    return _TOKENIZERS[path]


def cuts(pos: list[int], penalty: list[float], size: int) -> list[int]:
    """Indices of the chosen cut candidates, from pos[0] to the last; gaps between candidates are at most ``size``."""
    best, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(float(pos[0]), 0, pos[0])])
    last = len(pos) - 1
    for j in range(1, len(pos)):
        p = pos[j]
        while queue[0][2] < p - size:
            queue.popleft()
        low, back[j], _ = queue[0]
        best[j] = low + size - p + penalty[j]
        value = best[j] + p
        if j != last:
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, j, p))
    out = [last]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Packer:
    """Takes documents in order, gives pieces (doc_id, start, length, crc, doc_tokens, window, offset)."""

    def __init__(self, size: int, block: int = BLOCK):
        self.size, self.block = size, block
        self.docs: list[tuple[object, int, int]] = []  # id, tokens before it in the buffer (may be negative), tokens
        self.ids: list[bytes] = []
        self.pos, self.penalty, self.end, self.window = [0], [0.0], 0, 0

    def add(self, doc_id: object, ids: bytes, ending: np.ndarray) -> Iterator[tuple]:
        """``ending`` tells of every token id whether a sentence or line ends with it."""
        begin = self.end
        ends = np.flatnonzero(ending[np.frombuffer(ids, "<u4")]) + 1
        total = (len(ids) >> 2) + 1
        grid = np.arange((begin // STRIDE + 1) * STRIDE, begin + total, STRIDE)
        at, which = np.unique(np.concatenate([[begin + total], begin + ends, grid]), return_index=True)
        self.pos.extend(at.tolist())
        self.penalty.extend(np.where(which == 0, 0.0, np.where(which <= len(ends), AT_SENTENCE, IN_SENTENCE)).tolist())
        self.ids += (ids, b"\0\0\0\0")
        self.end += total
        self.docs.append((doc_id, begin, total))
        if self.end >= self.block:
            yield from self.flush(False)

    def flush(self, final: bool = True) -> Iterator[tuple]:
        """Windows of what is held; unless it is the end, the last window stays open. Its rest goes in powers of two."""
        if not self.end:
            return
        chosen = [self.pos[i] for i in cuts(self.pos, self.penalty, self.size)]
        if len(chosen) > 2 or final:
            rest = chosen.pop()
            if final:
                at = chosen[-1]
                while at < rest:
                    at += min(self.size, 1 << (rest - at).bit_length() - 1)
                    chosen.append(at)
        else:
            return
        data = b"".join(self.ids)
        d = 0
        for lo, hi in zip(chosen, chosen[1:], strict=False):
            while self.docs[d][1] + self.docs[d][2] <= lo:
                d += 1
            k = d
            while k < len(self.docs) and self.docs[k][1] < hi:
                doc_id, begin, n = self.docs[k]
                a, b = max(lo, begin), min(hi, begin + n)
                yield doc_id, a - begin, b - a, zlib.crc32(data[4 * max(a, 0) : 4 * b]), n, self.window, a - lo
                k += 1
            self.window += 1
        done = chosen[-1]
        self.docs = [(i, begin - done, n) for i, begin, n in self.docs if begin + n > done]
        keep = self.pos.index(done)
        self.pos, self.penalty = [p - done for p in self.pos[keep:]], [0.0, *self.penalty[keep + 1 :]]
        self.ids, self.end = [data[4 * done :]] if len(data) > 4 * done else [], self.end - done


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each scan partition is packed by itself in its order, so no text is shuffled; sequence_id is the partition's
    number times 2**32 plus the window's. What is left at a partition's end goes into sequences whose lengths are
    powers of two. Null and empty texts are the single id 0; repeated rows are packed each; an empty table gives
    no pieces; very long texts are cut into as many windows as they need.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # a vocabulary: about a megabyte, whatever the input
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(tokenizer_path))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = tokenizer(tokenizer_path, ranks.value), Packer(size)
        first = TaskContext.get().partitionId() << 32

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [id_type, *[pa.int64()] * 6]
            columns[5] = [first + w for w in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column("id").to_pylist(), tok.encode(texts), strict=True):
                    rows.extend(packer.add(doc_id, ids, tok.ending))
                if rows:
                    yield out(rows)
        rows = list(packer.flush())
        if rows:
            yield out(rows)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(packed, schema).withColumnRenamed("id", id_col)
