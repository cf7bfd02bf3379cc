"""SentencePiece encoding and decoding by a forward pass that words share along their common prefixes.

Texts are cut into marked words (a run of marks and what follows up to the next mark; no piece crosses such a cut).
The distinct new words of a batch are sorted, which is the depth-first order of their trie, and the forward table
of the previous word is kept up to where the next one differs. For unigram models an entry is the best sum of
scores of a prefix and its last piece (Viterbi). Sums of scores do not give a BPE model's result; there an entry is
the last piece of the prefix's own encoding: the one piece that ends there and stays apart from the last piece
before it when both are merged alone. Either way the pieces are read off backwards. Characters that no piece holds
fall back to byte pieces, or to the unknown piece where the model has none.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
_SEGMENT = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
_CACHE_MAX = 1_000_000
#: Bytes of words, ids and decoded words that a worker remembers, about; then it starts anew.
_CACHE_BYTES = 400 << 20
_UNKNOWN = -1


class Pieces:
    """The normal pieces of a model with scores, and its byte pieces."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown_id: int, kind: str):
        if any(MARKER in p.lstrip(MARKER) for p in scores):
            raise ValueError("a piece crosses the start of a word")
        self.scores, self.byte_ids, self.unknown_id, self.kind = scores, byte_ids, unknown_id, kind
        self.longest = max(map(len, scores), default=1)
        self.text_of = {i: p.replace(MARKER, " ").encode() for p, (i, _) in scores.items()}
        self.text_of |= {i: bytes([b]) for b, i in enumerate(byte_ids or [])}
        self.floor = min((s for _, s in scores.values()), default=0.0) - 10
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        normal = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(normal, bytes_ if all(sp.is_byte(i) for i in bytes_) else None, sp.unk_id(), kind)

    def merged(self, word: str) -> list[str]:
        """BPE by definition: the best-scored neighbours merge, leftmost first, until none can."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.scores.get(parts[i] + parts[i + 1])
                if got and (best is None or got[1] > best):
                    best, at = got[1], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether two pieces, merged alone, give the two again; remembered."""
        if len(self.apart) > _CACHE_MAX:
            self.apart.clear()
        self.apart[a, b] = same = self.merged(a + b) == [a, b]
        return same

    @cached_property
    def endings(self) -> dict[str, bool]:
        """Every end of a piece, with whether it is a piece that merging its own characters gives: only such can be a last piece."""
        out = {p[i:]: False for p in self.scores for i in range(1, len(p))}
        out.update((p, len(p) == 1 or self.merged(p) == [p]) for p in self.scores)
        return out

    def _bpe_entries(self, word: str, same: int, last: list[str | None], start: list[int]) -> None:
        """Fills the table beyond the first ``same`` characters."""
        endings, apart = self.endings, self.apart
        for end in range(same + 1, len(word) + 1):
            last[end], start[end] = None, end - 1
            # ends of pieces that end here, shorter ones first; of those that can be last, the longest one holds
            begin, fits = end - 1, []
            while begin >= 0:
                piece = word[begin:end]
                found = endings.get(piece)
                if found is None:
                    break
                if found:
                    fits.append((begin, piece))
                begin -= 1
            for begin, piece in reversed(fits):
                before = last[begin]
                if before is not None:
                    stay = apart.get((before, piece))
                    if not (self._stay_apart(before, piece) if stay is None else stay):
                        continue
                last[end], start[end] = piece, begin
                break

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The ids of each word; words must be sorted."""
        table: list = [None]
        start, best, before = [0], [0.0], ""
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            more = len(word) - same
            table[same + 1 :] = [None] * more
            start[same + 1 :] = [0] * more
            if self.kind == "bpe":
                self._bpe_entries(word, same, table, start)
            else:
                best[same + 1 :] = [0.0] * more
                for end in range(same + 1, len(word) + 1):
                    top, table[end], start[end] = best[end - 1] + self.floor, None, end - 1
                    for begin in range(max(0, end - self.longest), end):
                        got = self.scores.get(word[begin:end])
                        if got and best[begin] + got[1] > top:
                            top, table[end], start[end] = best[begin] + got[1], word[begin:end], begin
                    best[end] = top
            out, end = [], len(word)
            while end:
                piece = table[end]
                if piece is not None:
                    out.append(self.scores[piece][0])
                elif self.byte_ids:
                    out.extend(self.byte_ids[b] for b in reversed(word[start[end] : end].encode("utf-8", "replace")))
                elif not (out and out[-1] == self.unknown_id):
                    out.append(self.unknown_id)
                end = start[end]
            before = word
            yield word, out[::-1]

    def _cut(self, texts: list[str | None]) -> list[list[str]]:
        """The marked words of each text; those not met before are segmented."""
        if self.held > _CACHE_BYTES:
            self.known, self.back, self.held = {}, {}, 0
        cut = [_SEGMENT.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        new = set()
        for c in cut:
            new.update(c)
        for word, ids in self.segment(sorted(new.difference(self.known))):
            self.known[word] = array("i", ids).tobytes()
            self.back[word] = self._bytes_of(ids)
            self.held += 200 + 10 * len(word)
        return cut

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<i4") for c in self._cut(texts)]

    def encode_and_back(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
        """The ids of each text and what they decode to; decoding is by piece, so a word's ids are decoded once."""
        cut = self._cut(texts)
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<i4") for c in cut]
        return ids, [_plain(b"".join(map(self.back.__getitem__, c))) for c in cut]

    def _bytes_of(self, ids: list[int]) -> bytes:
        get = self.text_of.get
        return b"".join([get(i, b" \xe2\x81\x87 ") for i in ids])

    def decode(self, ids: list[int]) -> str:
        return _plain(self._bytes_of(ids))


def _plain(data: bytes) -> str:
    """The text of decoded bytes, without the blank of the first mark."""
    text = data.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_LOADED: dict[tuple[str, str], Pieces] = {}


def pieces(path: str, kind: str) -> Pieces:
    """One for each model and worker."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Pieces.load(path, kind)
    return _LOADED[path, kind]


def encode(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, n_ids, ids_crc32, round_trip (whether decoding gives the text back).

    Null and empty texts have no ids; texts are encoded whole; repeated rows each; an empty table gives an empty
    result; only the two named columns are read. A mark in a text decodes to a space, so does not come back.
    """
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, kind)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                texts = b.column("text").to_pylist()
                ids, texts_back = model.encode_and_back(texts)
                offsets = np.cumsum([0, *map(len, ids)])
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<i4")]).astype(np.int32)))
                same = [back == (t or "") for back, t in zip(texts_back, texts, strict=True)]
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("id"), values, pa.array(map(len, ids), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["id", "ids", "n_ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encoded, f"id {kind_of_id}, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and text; null ids give null, no ids the empty text.

    Lists of any length are decoded whole; repeated rows give repeated results; an empty table an empty one; only the two
    named columns are read.
    """
    kind_of_id = rows.schema[id_col].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, kind)
        for b in batches:
            texts = [None if x is None else model.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decoded, f"id {kind_of_id}, text string").withColumnRenamed("id", id_col)
