"""Scoring texts by prediction by partial matching: a byte-context trie over the training documents.

A text is its lower-cased words with a mark before, between and after them, then an end, coded byte by byte in
contexts of up to ``ORDER`` preceding bytes, across word marks (or, for comparison, within the word alone). A byte
unseen in a context escapes to the next shorter one (method C: d distinct symbols in n escape with probability
d / (n + d)); symbols of the longer context are excluded there. Below order 0 all symbols left are equally likely.

With that order a byte's probability depends on its ``ORDER`` bytes of context alone. So the trie is a table of
(context, symbol) with counts, grown from all training documents, and every (context, symbol) that occurs anywhere
is coded once, order by order, with joins and sums over that table. Texts are held in blocks, compressed; a block
sends in the distinct contexts and words it holds with their counts, and gets their code lengths back.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.storage import discard

from .common import written

ORDER = 5
#: Bytes of text in a block, whose contexts are looked up together, and in a row of it. A worker takes some 25 bytes a byte of a
#: block, and keeps much of it for the stages after.
BLOCK_BYTES, ROW_BYTES = 16 << 20, 1 << 20
#: The mark before and after a word, and the end of a text; no word holds either byte.
MARK, END = b" ", b"\n"
SYMBOLS = 256
_DOCS = "block long, gram long, word binary, n long, doc_ids array<{kind}>, held array<boolean>, sizes array<long>, packed binary"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at white space (ASCII); the end of the text is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream_of(text: str | None) -> bytes:
    """The text as it is coded, from its first mark to its end; the first mark is context only."""
    words = words_of(text)
    return MARK + MARK.join([*words, END]) if words else MARK + END


def grams_of(data: np.ndarray, across: bool) -> np.ndarray:
    """For every byte of streams laid end to end: its context's length, its context and itself as a number; -1 for first marks.

    Contexts reach back to the stream's first mark, or, unless ``across`` is set, to the mark before the word.
    """
    end = data == END[0]
    starts = np.concatenate([[0], np.flatnonzero(end[:-1]) + 1])
    wide = data.astype(np.int64)
    gram = wide.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= wide[:-k] << (8 * k)
    if across:
        length = np.full(len(data), ORDER)
        for k in range(ORDER - 1, -1, -1):  # a stream that is shorter is set right by the one after it
            at = starts + k
            length[at[at < len(data)]] = k
    else:
        # a mark belongs to the word before it, unless it is the stream's first
        place, mark = np.arange(len(data)), data == MARK[0]
        reach = np.maximum.accumulate(np.where(mark, place, 0))
        reach = np.where(mark, np.concatenate([[0], reach[:-1]]), reach)
        reach[starts] = starts
        length = np.minimum(place - reach, ORDER)
    short = np.flatnonzero(length < ORDER)
    gram[short] &= (np.int64(1) << (8 * (length[short] + 1))) - 1
    gram |= length << 48
    gram[starts] = -1
    return gram


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, weights
    order = np.argsort(values, kind="stable")  # sorted pieces, laid end to end, are merged
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(weights[order], first)


class _Block:
    """Documents of a block: rows of compressed streams, counts of words and of contexts with their symbols."""

    def __init__(self, across: bool) -> None:
        self.across, self.bytes = across, 0
        self.words: Counter[bytes] = Counter()
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows: list[tuple] = []
        self.ids: list = []
        self.held: list[bool] = []
        self.streams: list[bytes] = []
        self.open = 0

    def add(self, doc_id: object, held: bool, text: str | None) -> None:
        stream = stream_of(text)
        if held:
            for w in {*stream.split(), END}:
                self.words.setdefault(w, 0)
        else:
            self.words.update(stream.split())
            self.words[END] += 1
        self.ids.append(doc_id)
        self.held.append(held)
        self.streams.append(stream)
        self.open += len(stream)
        self.bytes += len(stream)
        if self.open >= ROW_BYTES:
            self.close()

    def close(self) -> None:
        if not self.ids:
            return
        joined = b"".join(self.streams)
        sizes = np.fromiter(map(len, self.streams), np.int64, len(self.streams))
        grams = grams_of(np.frombuffer(joined, np.uint8), self.across)
        trains = np.repeat(~np.array(self.held), sizes)
        some = grams >= 0
        self.grams.append(np.unique(grams[some & trains], return_counts=True))
        held = np.unique(grams[some & ~trains])
        self.grams.append((held, np.zeros(len(held), np.int64)))
        if len(self.grams) > 12:
            self.grams = [self.merged()]
        self.rows.append((self.ids, self.held, sizes, pa.compress(joined, codec="zstd", asbytes=True)))
        self.ids, self.held, self.streams, self.open = [], [], [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([g for g, _ in self.grams]), np.concatenate([c for _, c in self.grams]))

    def batches(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.close()

        def batch(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns["block"] = pa.array(np.full(n, block))
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        grams, n = self.merged()
        yield batch(gram=pa.array(grams), n=pa.array(n))
        yield batch(word=pa.array(list(self.words), pa.binary()), n=pa.array(list(self.words.values()), pa.int64()))
        for ids, held, sizes, packed in self.rows:
            yield batch(doc_ids=pa.array([ids], schema.field("doc_ids").type), held=pa.array([held], pa.list_(pa.bool_())), sizes=pa.array([sizes], pa.list_(pa.int64())), packed=pa.array([packed], pa.binary()))


def _blocks(across: bool, block_bytes: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, schema = TaskContext.get().partitionId() << 32, _Block(across), None
        for b in batches:
            kind = b.schema.field("id").type
            schema = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("doc_ids", pa.list_(kind)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())])
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                block.add(doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0, text.as_py())
                if block.bytes >= block_bytes:
                    yield from block.batches(number, schema)
                    number, block = number + 1, _Block(across)
        if block.bytes and schema is not None:
            yield from block.batches(number, schema)

    return made


def coded(grams: DataFrame) -> DataFrame:
    """(gram, logp), written, of every (context, symbol) in grams (gram, n), n being its count in training.

    Orders are worked from 0 upward. ``fresh`` is the log10 probability of the symbol in this context if no longer
    one is known; ``after`` that of the symbol one order down once this context has been escaped from, its symbols
    excluded there. Contexts of order k count all bytes that have k bytes or more before them.
    """
    order = F.shiftright("gram", 48).cast("int")
    mask = lambda k: (1 << 8 * (k + 1)) - 1
    pairs = {ORDER: grams.where(order == ORDER).select("gram", "n", F.lit(True).alias("own"))}
    for k in range(ORDER - 1, -1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit(mask(k))).bitwiseOR(F.lit(k << 48))
        own = grams.where(order == k).select("gram", "n", F.lit(True).alias("own"))
        shorter = pairs[k + 1].select(suffix.alias("gram"), "n", F.lit(False).alias("own"))
        pairs[k] = written(own.unionByName(shorter).groupBy("gram").agg(F.sum("n").alias("n"), F.max("own").alias("own")), "pairs")
    context = F.shiftright("gram", 8)
    log = lambda x, y: F.log10(x) - F.log10(y)
    below, out, orders = None, None, []
    for k in range(ORDER + 1):
        rows = pairs[k].withColumn("ctx", context)
        sums = [F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds")]
        if k == 0:
            # one context of at most 256 symbols
            rows = rows.join(F.broadcast(rows.groupBy("ctx").agg(*sums)), "ctx").withColumn("after", -F.log10(F.lit(float(SYMBOLS)) - F.col("kinds"))).withColumn("low_fresh", -F.log10(F.lit(float(SYMBOLS))))
        else:
            rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask(k - 1))).bitwiseOR(F.lit((k - 1) << 48)))
            rows = rows.join(below, "low")
            stats = rows.groupBy("ctx").agg(*sums, F.sum(F.when(F.col("n") > 0, F.col("low_n"))).alias("mass"))
            rows = rows.join(stats, "ctx")
            free = F.col("low_kinds") - F.col("kinds")
            size = F.col("low_total") - F.col("mass") + free
            escape = F.when(free > 0, log(free, size)).otherwise(0.0) + F.col("low_after")
            rows = rows.withColumn("after", F.when(F.col("total") > 0, F.when(F.col("low_n") > 0, log(F.col("low_n"), size)).otherwise(escape)))
        size = F.col("total") + F.col("kinds")
        fresh = F.when(F.col("total") == 0, F.col("low_fresh")).when(F.col("n") > 0, log(F.col("n"), size)).otherwise(log(F.col("kinds"), size) + F.col("after"))
        rows = written(rows.select("gram", "n", "own", "total", "kinds", "after", fresh.alias("fresh")), "orders")
        orders.append(rows)
        if k < ORDER:
            discard(pairs[k])
        below = rows.select(F.col("gram").alias("low"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"), F.col("after").alias("low_after"), F.col("fresh").alias("low_fresh"))
        own = rows.where("own").select("gram", F.col("fresh").alias("logp"))
        out = own if out is None else out.unionByName(own)
    lengths = written(out, "lengths")
    for rows in orders:
        discard(rows)
    return lengths


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", across: bool = False) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id as text is 0 modulo 10 are held out of training; a null id trains. Null and
    empty texts are the end of text alone; very long texts are a block of their own; repeated rows count each; an
    empty table gives an empty result; only the two named columns are read. base_score is that of smoothed word
    counts; score is the log10 probability by PPM. With ``across`` contexts run across word marks; without, a
    token's score does not depend on those before it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = written(rows.mapInArrow(_blocks(across, BLOCK_BYTES), _DOCS.format(kind=kind)), "blocks")
    grams, words = blocks.where("gram is not null").select("block", "gram", "n"), blocks.where("word is not null").select("block", "word", "n")
    # a word has a row a block, so its window is small even for the commonest; one of its rows stands for the word
    of_word = Window.partitionBy("word")
    counted = words.select("block", "word", "n", F.sum("n").over(of_word).alias("c"), (F.col("block") == F.min("block").over(of_word)).alias("first"))
    counted = written(counted, "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("V")).first()
    known, floor = int(total["N"]), float(total["N"] + 0.1 * (total["V"] + 1))

    counts = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    lengths = coded(counts)
    discard(counts)
    # a partition holds whole blocks, and of a block the answers before the texts: a task reads them as they come. Texts go as
    # bytes, since lists that are null in most rows cost the writer of an Arrow batch a pass over it a row
    no_word, no_gram, no_value = F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("value")
    answers = grams.select("block", "gram").join(lengths, "gram").select((F.col("block") * 2).alias("turn"), "gram", no_word, F.col("logp").alias("value"))
    answers = answers.unionByName(counted.select((F.col("block") * 2).alias("turn"), no_gram, "word", F.col("c").cast("double").alias("value")))
    texts = blocks.where("packed is not null").select("block", "doc_ids", "held", "sizes", "packed").mapInArrow(_bundled, "block long, word binary")
    rows = answers.unionByName(texts.select((F.col("block") * 2 + 1).alias("turn"), no_gram, "word", no_value))
    rows = rows.repartition(F.shiftright("turn", 1)).sortWithinPartitions("turn")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_scored(across, known, floor), schema).withColumnRenamed("doc_id", id_col)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of texts as the bytes of an Arrow stream."""
    for batch in batches:
        for i in range(batch.num_rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(i, 1))
            yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "word"])


class _Answers:
    """What a block's texts look up: code lengths of its contexts, counts of its words."""

    def __init__(self) -> None:
        self.grams: list[np.ndarray] = []
        self.logps: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, gram: pa.Array, word: pa.Array, value: pa.Array) -> None:
        of_gram, of_word = gram.is_valid(), word.is_valid()
        self.grams.append(gram.filter(of_gram).to_numpy())
        self.logps.append(value.filter(of_gram).to_numpy())
        self.words.append(word.filter(of_word))
        self.counts.append(value.filter(of_word).to_numpy())

    def table(self, floor: float) -> tuple[pd.Index, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Contexts, their code lengths; words, whether each is known, their scores."""
        count = np.concatenate(self.counts)
        return pd.Index(np.concatenate(self.grams)), np.concatenate(self.logps), pa.concat_arrays(self.words), count > 0, np.log10((count + 0.1) / floor)


def _scored(across: bool, known: int, floor: float):
    """Scores of documents, from rows sorted by turn: the answers of a block (even), then its texts (odd). Holds the
    answers of one block and one row of texts."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, answers, found = None, _Answers(), None
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)] if len(turns) else [0]
            for i, j in pairwise(cuts):
                part, turn = batch.slice(i, j - i), int(turns[i])
                if turn % 2 == 0:
                    if turn != last:
                        answers, found = _Answers(), None
                    answers.add(*(part.column(c) for c in ("gram", "word", "value")))
                else:
                    if found is None:
                        found, answers = answers.table(floor), _Answers()
                    for bundle in part.column("word"):
                        yield _row_scores(pa.ipc.open_stream(bundle.as_buffer()).read_all(), found, across, known)
                last = turn

    return scored


def _row_scores(row: pa.Table, found: tuple, across: bool, known: int) -> pa.RecordBatch:
    gram, logp, words, seen, base = found
    ids, held, sizes = (row.column(c).combine_chunks().flatten() for c in ("doc_ids", "held", "sizes"))
    sizes = sizes.to_numpy()
    data = pa.decompress(row.column("packed")[0].as_py(), int(sizes.sum()), codec="zstd", asbytes=True)
    codes = grams_of(np.frombuffer(data, np.uint8), across)
    some = codes >= 0
    value = np.zeros(len(codes))
    value[some] = logp[gram.get_indexer(codes[some])]
    scores = np.add.reduceat(value, np.cumsum(sizes) - sizes)
    at, tokens, ends = 0, [], []
    for size in sizes.tolist():
        tokens += data[at : at + size].split()
        tokens.append(END)
        at += size
        ends.append(len(tokens))
    where = pa.compute.index_in(pa.array(tokens, pa.binary()), value_set=words).to_numpy()
    lens = np.diff(ends, prepend=0)
    starts = ends - lens
    hits, bases = np.add.reduceat(seen[where].astype(np.int64), starts), np.add.reduceat(base[where], starts)
    columns = [ids, held, pa.array(lens), pa.array(hits), pa.array(np.full(len(lens), known)), pa.array(bases), pa.array(scores)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
