"""The index: facts of an artifact library as Parquet tables, rebuilt for changed files only."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quarrylens.functions.storage import FILES_A_TASK, file_system, spread, written
from quarrylens.functions.text import masked
from quarrylens.operators import definitions, jobs, lexer, lines, references
from quarrylens.sources.artifacts import CHUNK_THRESHOLD_BYTES, list_artifacts, no_units, read_library

TABLES = ("files", "programs", "copy_refs", "calls", "tokens", "table_refs", "objects", "columns", "items", "steps", "dds", "blind_spots")
#: Confidence of facts read off static statements, and of those recovered from literals of dynamic ones.
CERTAIN, DYNAMIC = 100, 40


class StageTimer:
    """Wall-clock of stages in milliseconds, in the order they ended. ``echo`` is called with each as it ends."""

    def __init__(self, echo: Callable[[str], object] | None = None) -> None:
        self._found: list[dict] = []
        self._echo = echo
        self._began = time.perf_counter()

    @contextmanager
    def stage(self, name: str):
        self.start()
        began = self._began
        try:
            yield
        finally:
            self._began = began
            self.since(name)

    def start(self) -> None:
        """From here on the next ``since`` counts."""
        self._began = time.perf_counter()

    def since(self, name: str) -> float:
        """Note a stage that ran from the last ``start`` until now; returns its milliseconds."""
        ms = (time.perf_counter() - self._began) * 1000
        self._found.append({"stage": name, "ms": ms})
        if self._echo:
            self._echo(f"{name}: {ms:.0f} ms")
        return ms

    def timings(self) -> list[dict]:
        return list(self._found)

    def report(self) -> str:
        """A line a stage and one for all; empty if there was none."""
        if not self._found:
            return ""
        return "\n".join(f"{x['stage']:<20}{x['ms']:>10.0f} ms" for x in [*self._found, {"stage": "total", "ms": sum(x["ms"] for x in self._found)}])


def extract(files: DataFrame, scripts: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of files with text and kind, and of the statements of scripts that were lexed in chunks."""
    readable = files.where("text is not null")
    cobol = readable.where(F.col("kind").isin(*lines.COBOL_KINDS, "UNKNOWN"))
    blobs = lines.cobol_blobs(cobol)
    steps, dds, streams = jobs.steps_and_dds(jobs.jcl_lines(readable), readable)
    whole = readable.where(F.col("kind").isin("SQL", "CONTROL", "SORT", "BIND", "UNKNOWN"))
    # a sort deck holds no SQL; other control statements than utilities' neither
    whole = whole.where(F.col("kind").isin("SQL", "CONTROL")).select("path", F.lit(0).alias("unit"), F.lit(1).cast("long").alias("first"), F.lit(None).cast("array<int>").alias("origin"), "text")
    embedded = lines.embedded_sql(blobs).select("path", "unit", F.col("first").cast("long").alias("first"), "origin", "text")
    dynamic = definitions.dynamic_units(blobs).select("path", "unit", F.col("first").cast("long").alias("first"), "origin", "text")
    assembled = definitions.assembled_units(blobs).withColumn("first", F.col("first").cast("long"))
    units = embedded.unionByName(dynamic).unionByName(assembled).unionByName(whole).unionByName(scripts).unionByName(jobs.stream_units(streams, steps))
    return {
        "tokens": lexer.structured(lexer.tokens(units)),
        "programs": definitions.programs(blobs),
        "copy_refs": definitions.copy_references(blobs),
        "calls": definitions.calls(blobs),
        "items": definitions.data_items(blobs),
        "steps": steps,
        "dds": dds,
    }


def token_facts(tokens: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The fact tables that are read off tokens."""
    refs = references.table_references(tokens).withColumn("confidence", F.when(F.col("unit") < 0, DYNAMIC).otherwise(CERTAIN))
    dynamic = refs.where("unit < 0").select("path", "line", F.lit("DYNAMIC-SQL").alias("kind"), F.concat_ws(" ", "stmt_name", "table_name").alias("detail"))
    big = files.where("chunked").select("path", F.lit(1).alias("line"), F.lit("CHUNKED").alias("kind"), F.concat(F.col("length"), F.lit(" bytes")).alias("detail"))
    unread = files.where("error is not null").select("path", F.lit(1).alias("line"), F.lit("UNREADABLE").alias("kind"), F.col("error").alias("detail"))
    return {"table_refs": refs, "objects": references.objects(tokens), "columns": definitions.defined_columns(tokens), "blind_spots": dynamic.unionByName(big).unionByName(unread)}


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    fs, make = file_system(spark, path)
    log = make(f"{path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n.split(".")[0]) for n in names if re.fullmatch(r"[0-9]+\.json", n))


def _snapshot(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/log/{number:020d}.json").collect()))


class Index:
    """An opened index. ``tables`` are DataFrames by name; ``sql`` runs SQL over them as views.

    Facts lie in buckets of their path's hash, in a folder for each update: ``data/write=<id>/of=<table>/bucket=<n>``. A
    snapshot in ``log`` names the update that holds each bucket; an index is what its last snapshot names, or an earlier one.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        there = _snapshots(spark, path)
        if not there or version is not None and version not in there:
            raise FileNotFoundError(f"no index at {path}" if not there else f"no version {version} at {path}")
        self.version = there[-1] if version is None else version
        told = _snapshot(spark, path, self.version)
        self.buckets: int = told["buckets"]
        self.live: dict[int, str] = {int(b): w for b, w in told["live"].items()}
        self.tables = {name: self._table(name, StructType.fromJson(told["schemas"][name])) for name in TABLES}

    def _table(self, name: str, schema: StructType) -> DataFrame:
        if not self.live:
            return self.spark.createDataFrame([], schema)
        # partitions are pruned by their names, before any file is listed for reading
        pairs = [f"{w}/{b}" for b, w in self.live.items()]
        folders = [f"{self.path}/data/write={w}/of={name}" for w in sorted(set(self.live.values()))]
        place = StructType([*schema.fields, StructField("write", StringType()), StructField("of", StringType()), StructField("bucket", IntegerType())])
        rows = self.spark.read.schema(place).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.where(F.concat_ws("/", "write", "bucket").isin(pairs)).drop("write", "of", "bucket")

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Index:
        """An index of the given tables, which no folder of its own holds."""
        index = cls.__new__(cls)
        index.spark, index.path, index.version, index.buckets, index.live, index.tables = spark, "", 0, 0, {}, dict(tables)
        return index

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        self.tables = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def sql(self, query: str) -> DataFrame:
        for name, rows in self.tables.items():
            rows.createOrReplaceTempView(name)
        return self.spark.sql(query)

    def stats(self) -> dict[str, int]:
        return {"files": self.files.count(), "table_refs": self.table_refs.count()}

    def known(self) -> DataFrame:
        return definitions.known_columns(self.columns, self.files)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    return Index(spark, path, version)


def index_of(files: DataFrame) -> Index:
    """An index of artifacts that a table holds instead of a folder: path, library, member, length, text and kind a row.

    Facts are written to the shared folder, for this session alone. A null text is a file that cannot be read; an empty
    table gives an empty index; of extra columns none is read. Paths have to be distinct.
    """
    spark = files.sparkSession
    error = F.when(F.col("text").isNull(), "content could not be read")
    files = written(spread(files.select("path", "library", "member", "length", "text", "kind"), "path", size="length", per_task=FILES_A_TASK).withColumns({"error": error, "chunked": F.lit(False)}), "files")
    facts = extract(files, no_units(spark))
    tokens = written(lexer.placed(facts.pop("tokens")), "tokens")
    facts = {**facts, **token_facts(tokens, files)}
    return Index.of(spark, {"files": files.drop("text"), "tokens": tokens, **{name: written(rows, name) for name, rows in facts.items()}})


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _opened(spark: SparkSession, path: str) -> Index | None:
    try:
        return Index(spark, path)
    except FileNotFoundError:
        return None


def _commit(spark: SparkSession, path: str, number: int, told: dict) -> None:
    """Name a snapshot by renaming a finished file. If another update took the number, this one fails and leaves no trace in the log."""
    fs, make = file_system(spark, path)
    draft, final = make(f"{path}/log/draft-{uuid.uuid4().hex}"), make(f"{path}/log/{number:020d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another update of {path} was committed as {number}")


def _update(spark: SparkSession, path: str, old: Index | None, roots: str | list[str], wanted: DataFrame, gone: DataFrame | None, timer: StageTimer, buckets: int, threshold: int = CHUNK_THRESHOLD_BYTES) -> Index:
    """Read the ``wanted`` files (path) and replace their facts, drop those of ``gone`` (path). Only the buckets of such paths are written, none if there are none."""
    buckets = old.buckets if old else buckets
    write = uuid.uuid4().hex
    base = f"{path}/data/write={write}"
    with timer.stage("clear"):
        stale = wanted.select("path") if gone is None else wanted.select("path").unionByName(gone.select("path"))
        stale = written(stale.distinct(), "stale")
        touched = sorted(r.b for r in stale.select(bucket_of(F.col("path"), buckets).alias("b")).distinct().collect())
        kept = {} if old is None else {name: rows.where(bucket_of(F.col("path"), buckets).isin(touched)).join(stale, "path", "left_anti") for name, rows in old.tables.items()}
    schemas = {}

    def store(name: str, new: DataFrame) -> None:
        rows = new.unionByName(kept[name]) if kept else new
        schemas[name] = json.loads(new.schema.json())
        rows.withColumn("bucket", bucket_of(F.col("path"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/of={name}")

    with timer.stage("parse"):
        if touched or old is None:
            files, units = read_library(spark, roots, wanted, threshold)
            files = written(files, "scanned")
            facts = extract(files, units)
            tokens = written(lexer.placed(facts.pop("tokens")), "tokens")
            store("tokens", tokens)
            store("files", files.drop("text"))
            for name, rows in {**facts, **token_facts(tokens, files)}.items():
                store(name, rows)
    with timer.stage("finalize"):
        if schemas:
            live = {**(old.live if old else {}), **dict.fromkeys(touched, write)}
            _commit(spark, path, old.version + 1 if old else 1, {"buckets": buckets, "live": live, "schemas": schemas})
        return Index(spark, path)


def build_index(spark: SparkSession, roots: str | list[str], path: str, full: bool = False, buckets: int = 64, threshold: int = CHUNK_THRESHOLD_BYTES) -> dict:
    """Index the files under the roots at ``path``; unchanged files (same path, length and time) keep their facts.

    An update costs what it touches: the buckets of changed, new and deleted files are written anew, others are referred to.
    It counts from the moment its snapshot is named; until then, and if it fails, readers see the one before. If nothing has
    changed nothing is written. ``full`` reads all files again. Returns files, table_refs, scanned, skipped, pruned, timing.
    """
    timer = StageTimer()
    old = _opened(spark, path)
    with timer.stage("walk"):
        listing = written(list_artifacts(spark, roots).select("path", "length", "mtime"), "listing")
    with timer.stage("plan"):
        same = ["path", "length", "mtime"]
        # files that could not be read are tried again
        todo = listing if old is None or full else listing.join(old.files.where("error is null").select(*same), same, "left_anti")
        todo = written(todo, "todo")
        n = todo.count()
        skipped = listing.count() - n
    with timer.stage("prune"):
        gone = None if old is None else written(old.files.select("path").join(listing, "path", "left_anti"), "gone")
        pruned = 0 if gone is None else gone.count()
    done = _update(spark, path, old, roots, todo, gone, timer, buckets, threshold)
    return {"files": done.files.count(), "table_refs": done.table_refs.count(), "scanned": n, "skipped": skipped, "pruned": pruned, "timing": timer.timings()}


def stream_index(spark: SparkSession, root: str, path: str, checkpoint: str | None = None, buckets: int = 64) -> int:
    """Index the files that have come under ``root`` since the last call, by a stream that ends when it has them; returns the version.

    The stream's checkpoint (within the index by default) tells which files it has taken; a batch that is repeated after a
    failure replaces its own facts. A file is taken once, as it is when it is seen: for changed and deleted ones call ``build_index``.
    """

    def taken(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        _update(session, path, _opened(session, path), root, written(batch.select("path"), "arrived"), None, StageTimer(), buckets)

    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    query = rows.select("path").writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint or f"{path}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return Index(spark, path).version


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forget all but the last ``keep`` snapshots and delete the buckets that none of those names; returns how many folders went.

    Updates that are not committed yet are unknown to the log, so do not run it while one is under way.
    """
    if keep < 1:
        raise ValueError("keep at least one snapshot")
    fs, make = file_system(spark, path)
    numbers = _snapshots(spark, path)
    live = {(w, int(b)) for n in numbers[-keep:] for b, w in _snapshot(spark, path, n)["live"].items()}
    used, gone = {w for w, _ in live}, 0
    for n in numbers[:-keep]:
        fs.delete(make(f"{path}/log/{n:020d}.json"), False)
    for update in fs.listStatus(make(f"{path}/data")):
        write = update.getPath().getName().split("=", 1)[-1]
        if write not in used:
            gone += fs.delete(update.getPath(), True)
            continue
        for of in fs.listStatus(update.getPath()):
            for bucket in fs.listStatus(of.getPath()) if of.isDirectory() else []:
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (write, int(name.split("=")[1])) not in live:
                    gone += fs.delete(bucket.getPath(), True)
    return gone


def table_listing(index: Index, like: str = "%") -> DataFrame:
    """(schema, table_name, refs) of tables whose name is like the pattern."""
    return index.table_refs.where(F.col("table_name").like(like)).groupBy("schema", "table_name").agg(F.count("*").alias("refs")).orderBy("schema", "table_name")


def split_spec(spec: str) -> tuple[str, str]:
    """(schema, table) of a dotted name; a location before them is dropped, delimited parts stay exact."""
    parts = [p[1:-1] if p.startswith('"') else p.upper() for p in re.findall(r'"[^"]+"|[^."\s]+', spec)]
    return (parts[-2] if len(parts) > 1 else "", parts[-1])


__all__ = ["CERTAIN", "DYNAMIC", "Index", "StageTimer", "build_index", "index_of", "masked", "open_index", "split_spec", "stream_index", "table_listing", "vacuum"]
