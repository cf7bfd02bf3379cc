"""Near-duplicate classes of texts by DartMinHash over shingles of five words.

A text is a weighted set: its shingles with their counts. Darts fall on each unit of weight of a shingle as a
Poisson process in time, the same for every text that holds that unit; a dart also draws a coordinate and a
height within its unit. Only darts within the first moments are thrown, so the work follows the number of
coordinates rather than coordinates times elements; the earliest dart of each coordinate is kept. Two texts agree
on a coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates propose pairs.

Pairs are verified with exact similarities of whole texts. Each band bucket first links its members to its
smallest id; where verified links leave a bucket in several parts, its members are compared in blocks across
those parts, with their weighted sets at hand, and a forest of the links leaves each block. So every pair that
shares a band is linked exactly as its similarity says, and a tight group of n copies costs n comparisons.
A pair at a similarity of 0.8 shares no band with a probability of (1 - 0.8**7)**32 = 0.0006.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 7
#: Members of a bucket that are compared in one block; larger buckets are cut into blocks.
BLOCK = 256
_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = x + _C1
    x ^= x >> _U(30)
    x *= _C2
    x ^= x >> _U(27)
    x *= _C3
    x ^= x >> _U(31)
    return x


def _draw(seed: np.ndarray, turn: int) -> np.ndarray:
    """The turn-th draw of well-mixed seeds."""
    x = seed + _U(turn * 0xBF58476D1CE4E5B9 % 2**64)
    x ^= x >> _U(32)
    x *= _C3
    x ^= x >> _U(29)
    return x


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of runs of five words, lower-cased in ASCII; a shorter text is one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U), np.empty(0, np.int64)
    h = mix(np.fromiter(map(zlib.crc32, words), dtype=_U, count=len(words)) ^ (np.fromiter(map(len, words), dtype=_U, count=len(words)) << _U(32)))
    k = min(SHINGLE, len(words))
    total = np.zeros(len(words) - k + 1, dtype=_U)
    for i in range(k):
        total = mix(total + h[i : len(words) - k + 1 + i])
    return np.unique(total, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """The identity of the earliest dart of each of k coordinates, for each of several sets (sets, k).

    Element i, of positive weight, belongs to set owner[i]; no set is empty. Sets are worked together but do not
    touch each other. Where a coordinate got no dart, the set's time is doubled and its darts are thrown again.
    """
    whole = np.ceil(weights).astype(np.int64)
    units, of = np.repeat(elements, whole), np.repeat(owner, whole)
    layer = np.arange(len(units)) - np.repeat(np.cumsum(whole) - whole, whole)
    room = np.repeat(weights, whole) - layer
    unit = mix(units ^ mix(layer.astype(_U)))
    parts = bool((room < 1).any())
    until = k * (np.log(k) + 2.5) / np.maximum(np.bincount(owner, weights=weights, minlength=sets), 1e-9)
    best = np.empty((sets, k), _U)
    open_ = np.arange(sets)
    while len(open_):
        place = np.full(sets, -1)
        place[open_] = np.arange(len(open_))
        at = place[of]
        some = at >= 0
        seed, space, at = unit[some], room[some] if parts else None, at[some]
        limit = until[open_][at]
        clock, turn = np.zeros(len(seed)), 0
        slots, times, names = [], [], []
        while len(seed):
            turn += 1
            draw = _draw(seed, turn)
            clock -= np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = np.flatnonzero(clock <= limit)
            seed, at, limit, clock, draw = seed[near], at[near], limit[near], clock[near], draw[near]
            slot, name, time = at * k + ((draw * _C2 >> _U(32)) * _U(k) >> _U(32)).view(np.int64), draw, clock.copy()
            if parts:  # the dart's height decides on parts of a unit
                space = space[near]
                inside = (mix(draw ^ _C3) >> _U(11)).astype(np.float64) * 2.0**-53 < space
                slot, name, time = slot[inside], name[inside], time[inside]
            slots.append(slot)
            times.append(time)
            names.append(name)
        slot, time, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        first = np.full(len(open_) * k, np.inf)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        found = np.full(len(first), np.iinfo(np.uint64).max, _U)
        np.minimum.at(found, slot[won], name[won])
        full = np.isfinite(first).reshape(-1, k).all(axis=1)
        best[open_[full]] = found.reshape(-1, k)[full]
        until[open_[~full]] *= 2
        open_ = open_[~full]
    return best


def sign(texts: list[str | None]) -> list[tuple[list[int] | None, bytes]]:
    """For each text one hash a band and one byte a coordinate; None and nothing for a text without words."""
    sets = [shingles(t) for t in texts]
    full = [i for i, (e, _) in enumerate(sets) if len(e)]
    out: list[tuple[list[int] | None, bytes]] = [(None, b"")] * len(texts)
    if not full:
        return out
    owner = np.repeat(np.arange(len(full)), [len(sets[i][0]) for i in full])
    best = darts(np.concatenate([sets[i][0] for i in full]), np.concatenate([sets[i][1] for i in full]).astype(np.float64), owner, len(full), BANDS * ROWS)
    coords = (mix(best) & _U(255)).astype(np.uint8)
    # a bucket is its band's number and seven bytes, told apart exactly by the 64 bits; mixing only spreads them
    bands = np.tile(np.arange(BANDS, dtype=_U), (len(full), 1))
    for column in np.moveaxis(coords.reshape(-1, BANDS, ROWS), 2, 0):
        bands = bands << _U(8) | column.astype(_U)
    bands = mix(bands)
    for n, i in enumerate(full):
        out[i] = bands[n].view(np.int64).tolist(), coords[n].tobytes()
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words_sha, bands, coords) of every row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                texts = b.column("text").to_pylist()
                # texts of like length together: the shorter, the more turns of darts a set takes
                order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
                rows: list = [None] * len(texts)
                for k in range(0, len(order), 48):
                    for n, row in zip(order[k : k + 48], sign([texts[n] for n in order[k : k + 48]]), strict=True):
                        rows[n] = row
                sha = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())).digest()[:20] for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sha, pa.binary()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.binary())], ["id", "words_sha", "bands", "coords"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(signed, "id long, words_sha binary, bands array<bigint>, coords binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose whole texts (id, text) are similar enough; texts of one id are taken from any of its rows."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple] = OrderedDict()

        def sets(key: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in held:
                held[key] = shingles(text)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[key]

        for b in batches:
            keep = [similarity(sets(x, s), sets(y, t)) >= least for x, y, s, t in zip(*(b.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(judged, "a long, b long")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links within each block pair: at most one pair a member leaves the task, however many are similar.

    Only members of different parts are compared, and a pair that shares several bands in the first of them alone:
    equal bytes in a band mean a shared bucket. Two parts that are joined within the task are not compared further.
    A similarity is at most the smaller weight over the larger, so pairs of unlike sizes are passed over exactly.
    """
    for t in groups(batches, ["bucket", "low", "high"]):
        ids, part, block = (t.column(n).to_numpy() for n in ("id", "part", "block"))
        band = t.column("band")[0].as_py()
        coords = np.frombuffer(b"".join(t.column("coords").to_pylist()), np.uint8).reshape(len(ids), -1)
        elements = [np.frombuffer(x, _U) for x in t.column("elements").to_pylist()]
        weights = [np.frombuffer(x, np.int64) for x in t.column("weights").to_pylist()]
        total = np.array([w.sum() for w in weights])
        _, label = np.unique(part, return_inverse=True)
        one, two = np.flatnonzero(block == t.column("low")[0].as_py()), np.flatnonzero(block == t.column("high")[0].as_py())
        a, b = [], []
        for i in one:
            fits = (label[two] != label[i]) & (np.minimum(total[two], total[i]) >= SIMILARITY * np.maximum(total[two], total[i]))
            rest = two[fits]
            if not len(rest):
                continue
            equal = (coords[rest] == coords[i]).reshape(len(rest), BANDS, ROWS).all(axis=2)
            rest = rest[equal.argmax(axis=1) == band]
            if not len(rest):
                continue
            sizes = np.array([len(elements[j]) for j in rest])
            others = np.concatenate([elements[j] for j in rest])
            at = np.minimum(np.searchsorted(elements[i], others), len(elements[i]) - 1)
            low = np.where(elements[i][at] == others, np.minimum(weights[i][at], np.concatenate([weights[j] for j in rest])), 0)
            low = np.add.reduceat(low, np.cumsum(sizes) - sizes)
            for j in rest[low >= SIMILARITY * (total[i] + total[rest] - low)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_sets(rows: DataFrame) -> DataFrame:
    """(id, coords, elements, weights) of rows (id, coords, text): the weighted shingles as binaries of 64-bit numbers."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("coords"), pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([w.astype(np.int64).tobytes() for _, w in sets], pa.binary())], ["id", "coords", "elements", "weights"])

    return rows.select("id", "coords", "text").mapInArrow(made, "id long, coords binary, elements binary, weights binary")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and class_id, the smallest id that chains of similar texts reach.

    Texts are linked from a weighted Jaccard similarity of 0.8 of their shingles of five words; texts of the same
    words are one. Texts without words (null, empty) and null ids are classes of their own. Rows that repeat an id
    share its class, and the id stands for all of their texts. An empty table gives an empty result; only the
    two named columns are read. Ids are cast to long: those that are no numbers raise. Texts are compared whole, however
    long; one text's shingles have to fit in a task.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, id_col, text_col), "signatures")
    if signed.groupBy("id").agg(F.min("words_sha").alias("low"), F.max("words_sha").alias("high")).where("low <> high").limit(1).count():
        return _classes_of_ids(docs, id_col, text_col)
    worded = signed.where("bands is not null")
    same = written(worded.groupBy("words_sha").agg(F.min("id").alias("rep")), "representatives")
    reps = worded.join(same, (worded.words_sha == same.words_sha) & (worded.id == same.rep), "left_semi").dropDuplicates(["id"])
    members = written(reps.select("id", F.posexplode("bands").alias("band", "bucket")), "bands")
    shared = members.groupBy("bucket").agg(F.min("id").alias("star"), F.count("*").alias("n")).where("n > 1")
    tried = written(members.join(shared.select("bucket", "star"), "bucket").where("id <> star").select(F.col("star").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    near = written(verified(tried, texts), "links")
    part = components(near)

    parted = members.join(part.withColumnRenamed("component", "c"), "id", "left").select("bucket", "band", "id", F.coalesce("c", "id").alias("part"))
    parted = written(parted.join(shared.select("bucket"), "bucket", "left_semi"), "parts")
    # only pairs of different parts matter: blocks of the bucket's largest part (numbered below 0) meet the blocks
    # of all other members, which also meet each other; a large part that is linked already costs a row a member
    sizes = parted.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    split = split.select("bucket", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil(F.col("rest") / BLOCK).cast("int").alias("rests"))
    inside = F.col("part") == F.col("main")
    dealt = parted.join(split, "bucket").withColumn("block", F.when(inside, -1 - F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rests"))).cast("int"))
    dealt = written(dealt.select("bucket", "band", "id", "part", "block", "mains", "rests", inside.alias("inside")), "dealt")
    # the sets of those members alone whose buckets are in several parts
    needed = reps.select("id", "coords").join(dealt.select("id").distinct(), "id", "left_semi").join(texts, "id").dropDuplicates(["id"])
    sets = written(_with_sets(needed), "sets")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("inside"), 0).otherwise(-F.col("mains")), F.col("rests") - 1)))
    dealt = dealt.select("bucket", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "part").join(sets, "id")
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    late = written(dealt.mapInArrow(_linked, "a long, b long"), "links")
    if late.limit(1).count():
        part = components(near.unionByName(late))

    rep_of = worded.join(same, "words_sha").select("id", "rep")
    found = rep_of.join(part.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    rows = docs.select(F.col(id_col).alias("row_id"))
    return rows.join(found, F.col("row_id").cast("long") == F.col("id"), "left").select(F.col("row_id").alias(id_col), F.coalesce("class_id", F.col("row_id").cast("long")).alias("class_id"))


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, n): all columns of the rows, and a number of each."""
    return written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")), "rows")


def _classes_of_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As near_duplicate_classes, for ids with several texts: rows get classes, and ids of one class are linked."""
    rows = _numbered(docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))).select("n", F.col("row.row_id").alias("row_id"), F.col("row.text").alias("text"))
    known = rows.where("row_id is not null")
    ids = written(near_duplicate_classes(known, "n").join(known.select("n", F.col("row_id").cast("long").alias("id")), "n").select("id", "class_id"), "ids")
    part = components(ids.join(ids.groupBy("class_id").agg(F.min("id").alias("least")), "class_id").select(F.col("id").alias("a"), F.col("least").alias("b")))
    found = rows.select("row_id").join(part, F.col("row_id").cast("long") == F.col("id"), "left")
    return found.select(F.col("row_id").alias(id_col), F.coalesce("component", F.col("row_id").cast("long")).alias("class_id"))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of rows, all columns: that of the smallest id (null is the largest), then text.

    Rows count each, also those that repeat an id. Rows of texts without words all stay. An empty table gives an empty
    result; ids that are no numbers raise; texts are compared whole.
    """
    rows = _numbered(docs)
    texts = rows.select("n", F.col("row").getField(id_col).cast("long").alias("id"), F.col("row").getField(text_col).alias("text"))
    ranked = near_duplicate_classes(texts, "n").join(texts.select("n", "id", F.sha2("text", 256).alias("sha")), "n")
    stay = ranked.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "sha", "n")).alias("first")).select(F.col("first.n").alias("n"))
    return rows.join(stay, "n", "left_semi").select("row.*")
