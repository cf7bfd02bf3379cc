"""The query surface: index, query, tables, column queries, summaries and JSON reports."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from quarrylens.functions.logs import PACKAGE_LOGGER

from . import fields, tables
from .index import Index, build_index, open_index, table_listing

log = logging.getLogger(PACKAGE_LOGGER)
log.addHandler(logging.NullHandler())


def default_index_path(spark: SparkSession) -> str:
    """``spark.quarrylens.index`` of the session, else $QUARRYLENS_INDEX, else ``quarrylens-index``."""
    return spark.conf.get("spark.quarrylens.index", None) or os.environ.get("QUARRYLENS_INDEX") or "quarrylens-index"


@contextmanager
def _opened(spark: SparkSession, db: str | Index | None) -> Iterator[Index]:
    if isinstance(db, Index):
        yield db
    else:
        with open_index(spark, db or default_index_path(spark)) as index:
            yield index


Store = Index


def index(spark: SparkSession, roots: str | list[str], db: str | None = None, full: bool = False) -> dict:
    """Build or refresh the index of one root or several; returns counts and timings."""
    found = build_index(spark, roots, db or default_index_path(spark), full)
    log.info("indexed %(files)d files, %(scanned)d scanned, %(skipped)d unchanged", found)
    return found


def query(spark: SparkSession, spec: str, db: str | Index | None = None, include_read: bool = True, data_hops: int = 1) -> tables.Result:
    with _opened(spark, db) as i:
        return tables.table_dependencies(i, spec, include_read, data_hops)


get_table_dependencies = query


class Analyzer:
    """Table queries over one opened index."""

    def __init__(self, store: Index) -> None:
        self.store = store

    def analyze(self, spec: str, include_read: bool = True, data_hops: int = 1) -> tables.Result:
        return tables.table_dependencies(self.store, spec, include_read, data_hops)


def list_tables(spark: SparkSession, db: str | Index | None = None, like: str = "%") -> list:
    with _opened(spark, db) as i:
        return table_listing(i, like).collect()


def table_dependency_summary(spark: SparkSession, spec: str, db: str | Index | None = None) -> dict:
    return tables.table_summary(query(spark, spec, db))


def table_dependencies_json(spark: SparkSession, spec: str, db: str | Index | None = None, **options) -> str:
    r = query(spark, spec, db, **options)
    plain = lambda rows: [x.asDict(recursive=True) for x in rows]
    report = {"spec": r.spec, "targets": [list(t) for t in r.targets], "refs": [vars(x) for x in r.refs], "programs": {n: p.depth for n, p in r.programs.items()}, "jobs": {j: plain(s) for j, s in r.jobs.items()}, "data_links": plain(r.data_links), "blind_spots": [list(b) for b in r.blind_spots], "notes": r.notes, "timings": r.timings}
    return json.dumps(report, indent=2)


def write_report(result: tables.Result | fields.FieldResult, path: str) -> None:
    """The parts of an answer as JSON lines, a folder each, written by the executors: for answers that are too large to collect."""
    for name, rows in result.frames.items():
        rows.write.json(f"{path}/{name}")


def get_field_dependencies(spark: SparkSession, spec: str, db: str | Index | None = None, include_read: bool = True) -> fields.FieldResult:
    with _opened(spark, db) as i:
        return fields.field_dependencies(i, spec, include_read)


def get_program_field_dependencies(spark: SparkSession, program: str, db: str | Index | None = None, include_read: bool = True) -> fields.FieldResult:
    with _opened(spark, db) as i:
        return fields.program_field_dependencies(i, program, include_read)


def db2_boundary(spark: SparkSession, program: str, db: str | Index | None = None) -> dict:
    with _opened(spark, db) as i:
        return fields.db2_boundary(i, program)


def field_dependency_summary(spark: SparkSession, spec: str, db: str | Index | None = None) -> dict:
    return fields.field_summary(get_field_dependencies(spark, spec, db))


def field_dependencies_json(spark: SparkSession, spec: str, db: str | Index | None = None, **options) -> str:
    r = get_field_dependencies(spark, spec, db, **options)
    plain = lambda rows: [x.asDict() for x in rows]
    report = {"table": r.spec, "columns": plain(r.columns), "uses": plain(r.uses), "bindings": plain(r.bindings), "layout_dependents": r.layout_dependents, "blind_spots": [list(b) for b in r.blind_spots], "notes": r.notes}
    return json.dumps(report, indent=2)
