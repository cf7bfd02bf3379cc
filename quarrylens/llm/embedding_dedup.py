"""Near-duplicate vectors by lattice hashing on E8, with neighbouring cells probed and cosines verified.

Each of ``TABLES`` tables projects a unit vector at random onto eight-dimensional blocks and takes the nearest E8
point of every block; together they name the vector's cell. Besides, each vector visits the few neighbouring
cells that it lies closest to. Two vectors meet in a cell that both visit and that is some vector's own. Every pair
that meets is verified by its cosine in double precision, and counted in one of the cells where it meets only, so
that each link counts once; what leaves a task are counts and a spanning forest, not pairs. Cells with many vectors are
dealt into blocks, and blocks are compared two by two. A vector travels to its cells as single-precision numbers where
these are its own numbers exactly, and with the smaller ones of its cells, which tell where a pair counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .near_dedup import mix

COSINE = 0.95
#: Measured at a cosine of 0.951 in 64 dimensions: a pair meets in one table with probability 0.55, in ten with 0.9997.
TABLES, E8_BLOCKS, SCALE, PROBES = 10, 2, 0.7, 3
#: Vectors of a cell that are compared in one block.
BLOCK = 768
#: Numbers that a worker takes up at a time: coordinates of vectors, and cosines.
AT_ONCE = 1 << 22
_U = np.uint64


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            found.append(v)
    found += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    d, rows = x - f, np.arange(len(x))
    j = np.abs(d).argmax(axis=1)
    f[rows, j] += np.where(f.sum(axis=1) % 2 != 0, np.where(d[rows, j] >= 0, 1.0, -1.0), 0.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The closest point of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _name(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of eight half-integers."""
    h = np.zeros(len(points), _U)
    for column in (2 * points).astype(np.int64).view(_U).T:
        h = mix(h + column)
    return h


@cache
def _projection(dim: int, table: int, block: int) -> np.ndarray:
    return np.random.default_rng((dim, table, block)).normal(size=(dim, 8)) / np.sqrt(8) / SCALE


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n, TABLES) and probed cells (n, TABLES, PROBES) of unit vectors."""
    n, dim = unit.shape
    own, probed = np.empty((n, TABLES), _U), np.empty((n, TABLES, PROBES), _U)
    for t in range(TABLES):
        names, near_names, far = [], [], []
        for b in range(E8_BLOCKS):
            y = unit @ _projection(dim, t, b)
            p = nearest_e8(y)
            further = 2 - 2 * ((y - p) @ minimal_vectors().T)
            order = np.argpartition(further, PROBES, axis=1)[:, :PROBES]
            names.append(_name(p))
            near_names.append(np.stack([_name(p + minimal_vectors()[order[:, q]]) for q in range(PROBES)], axis=1))
            far.append(np.take_along_axis(further, order, axis=1))

        def joined(parts: list[np.ndarray], table: int = t) -> np.ndarray:
            h = np.full(parts[0].shape, table * 4099 + dim * 1_000_003, _U)
            for x in parts:
                h = mix(h + x)
            return h

        own[:, t] = joined(names)
        options = np.concatenate([joined([near_names[b] if c == b else np.repeat(names[c][:, None], PROBES, axis=1) for c in range(E8_BLOCKS)]) for b in range(E8_BLOCKS)], axis=1)
        order = np.argsort(np.concatenate(far, axis=1), axis=1)[:, :PROBES]
        probed[:, t] = np.take_along_axis(options, order, axis=1)
    return own, probed


def _lists(a: np.ndarray) -> pa.Array:
    """The rows of an array of 64-bit numbers as lists."""
    flat = a.reshape(len(a), -1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in single precision if that holds it exactly, else in double precision."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    exact = (single == x).all(axis=1)
    return [s.tobytes() if e else d.tobytes() for s, d, e in zip(single, x, exact, strict=True)]


def _unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    if all(len(p) == 4 * dim for p in packed):
        return np.frombuffer(b"".join(packed), np.float32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(p, np.float32 if len(p) == 4 * dim else np.float64) for p in packed]).astype(np.float64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        values, begin = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            for chunk in np.array_split(at, max(1, len(at) // 2000)):
                x = values[begin[chunk][:, None] + np.arange(dim)]
                own, probed = cells(_unit(x))
                rows = pa.array(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(rows), batch.column("copies").take(rows), pa.array(_packed(x), pa.binary()), pa.array(np.full(len(x), dim), pa.int32()), _lists(own), _lists(probed)],
                    ["rep", "copies", "vector", "dim", "own", "probed"],
                )


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of n places that each reaches over the links between places i and j."""
    label = np.arange(n)
    while True:
        low, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) for each vector linked within a pair of blocks of a cell; holds a batch and a group at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = np.stack([rows.column(c).to_numpy() for c in ("cell", "low", "high")])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            held = rows.slice(starts[-1])
            if len(starts) > 1:
                yield from _links(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1])
    if held is not None:
        yield from _links(held.combine_chunks(), np.zeros(1, np.int64))


def _links(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Groups that begin at ``starts``, those of one number and length of vectors compared together."""
    ids, copies, block, dims = (rows.column(c).to_numpy() for c in ("rep", "copies", "block", "dim"))
    alone = rows.column("low").to_numpy() == rows.column("high").to_numpy()
    less = rows.column("less").combine_chunks()
    less = less.chunk(0) if isinstance(less, pa.ChunkedArray) else less
    counts = less.value_lengths().to_numpy(zero_copy_only=False)
    cells_at, cells_of = np.cumsum(counts) - counts, less.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.append(starts, len(ids)))
    for size, dim in np.unique(np.stack([sizes, dims[starts]]), axis=1).T:
        if size == 1:
            continue
        which = starts[(sizes == size) & (dims[starts] == dim)]
        step = max(1, AT_ONCE // int(size * max(size, dim)))
        for first in range(0, len(which), step):
            at = (which[first : first + step][:, None] + np.arange(size)).ravel()
            x = _unit(_unpacked(rows.column("vector").take(pa.array(at)).to_pylist(), dim)).reshape(-1, size, dim)
            g, i, j = np.nonzero(np.triu(x @ x.transpose(0, 2, 1) >= COSINE, 1))
            i, j = g * size + i, g * size + j
            apart = alone[at[i]] | (block[at[i]] != block[at[j]])
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            # a pair is in the group of every cell that it shares, and counts in the smallest: no smaller one is shared
            width = counts[at].max()
            links, pairs = np.zeros(len(at), np.int64), max(1, AT_ONCE // int(width * width + 1))
            for c in range(0, len(i), pairs):
                a, b = i[c : c + pairs], j[c : c + pairs]
                counted = np.ones(len(a), bool)
                if width:
                    (p, had), (q, has) = (_padded(at[k], counts, cells_at, cells_of, width) for k in (a, b))
                    counted = ~((p[:, :, None] == q[:, None, :]) & had[:, :, None] & has[:, None, :]).any(axis=(1, 2))
                np.add.at(links, a[counted], copies[at[b[counted]]])
                np.add.at(links, b[counted], copies[at[a[counted]]])
            root = _roots(len(at), i, j)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(at))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[some]]), pa.array(links[some]), pa.array(ids[at[root[some]]])], ["rep", "links", "root"])


def _padded(at: np.ndarray, counts: np.ndarray, begin: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some rows as one array, and where it holds numbers of theirs."""
    has = np.arange(width) < counts[at][:, None]
    return values[np.where(has, begin[at][:, None] + np.arange(width), 0)], has


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Links are pairs of a cosine of 0.95 or more. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths with each other. Equal vectors are compared
    once and counted as many. An id that is repeated counts once, with its smallest vector, and its rows share the
    result; a null id has no links and stays. An empty table gives an empty result; other columns are not read. Ids are
    cast to long: those that are no numbers raise. Vectors are compared whole, however long. n different vectors that all
    meet in one cell are dealt as n * n / 768 rows, as the links between them have to be counted.
    """
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    usable = usable.where(finite & F.exists(v, lambda e: e != 0)).select(F.col(id_col).cast("long").alias("vec"), v.alias("embedding"))
    vectors = written(usable.groupBy("vec").agg(F.min("embedding").alias("embedding")), "vectors")
    classes = written(vectors.groupBy("embedding").agg(F.min("vec").alias("rep"), F.count("*").alias("copies")), "classes")
    coded = written(classes.select("rep", "copies", "embedding").mapInArrow(_coded, "rep long, copies long, vector binary, dim int, own array<bigint>, probed array<bigint>"), "codes")

    own = coded.select("rep", F.explode("own").alias("cell"), F.lit(1).alias("home"))
    visits = own.unionByName(coded.select("rep", F.explode("probed").alias("cell"), F.lit(0).alias("home")))
    busy = visits.groupBy("cell").agg(F.sum("home").alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    met = visits.join(busy.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cell")
    # at most TABLES * (PROBES + 1) cells a vector
    met = met.groupBy("rep").agg(F.collect_list(F.struct("cell", "blocks")).alias("live"))
    met = written(coded.join(met, "rep").select("rep", "copies", "vector", "dim", "live"), "met")
    met = met.withColumn("visit", F.explode("live")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("visit.blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("visit.blocks") - 1))).withColumn("cell", F.col("visit.cell"))
    less = F.filter(F.col("live.cell"), lambda c: c < F.col("cell")).alias("less")
    met = met.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "vector", "dim", less)
    met = met.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "rep")
    found = written(met.mapInArrow(_verified, "rep long, links long, root long"), "links")

    part = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(part.withColumnRenamed("id", "rep"), "rep", "left")
    members = vectors.join(classes, "embedding").select("vec", "rep", "copies")
    each = members.join(linked, "rep", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select(F.col(id_col).alias("row_id"))
    out = out.join(each, F.col("row_id").cast("long") == F.col("vec"), "left")
    component = F.coalesce("c", F.col("row_id").cast("long"))
    return out.select(F.col("row_id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("row_id").cast("long").eqNullSafe(component).alias("kept"))
