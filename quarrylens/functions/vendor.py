"""Vendor modules: exact names, prefixes, and a site's own list."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Module prefix, label, subsystem.
PREFIXES = [
    ("DFH", "IBM CICS", "cics"),
    ("CEE", "IBM Language Environment", "le"),
    ("DSN", "IBM Db2", "db2"),
    ("IGZ", "IBM COBOL run time", "cobol-runtime"),
    ("ILBO", "IBM COBOL run time", "cobol-runtime"),
    ("DFS", "IBM IMS", "ims"),
    ("CSQ", "IBM MQ", "mq"),
    ("EZA", "IBM TCP/IP", "tcpip"),
    ("IEB", "IBM utility", "utility"),
    ("IEF", "IBM utility", "utility"),
    ("IEH", "IBM utility", "utility"),
]
#: Module, label, subsystem.
EXACT = [
    ("CBLTDLI", "IBM IMS", "ims"), ("AIBTDLI", "IBM IMS", "ims"), ("ASMTDLI", "IBM IMS", "ims"),
    ("MQCONN", "IBM MQ", "mq"), ("MQDISC", "IBM MQ", "mq"), ("MQOPEN", "IBM MQ", "mq"), ("MQCLOSE", "IBM MQ", "mq"), ("MQGET", "IBM MQ", "mq"), ("MQPUT", "IBM MQ", "mq"), ("MQPUT1", "IBM MQ", "mq"), ("MQINQ", "IBM MQ", "mq"), ("MQSET", "IBM MQ", "mq"), ("MQCMIT", "IBM MQ", "mq"), ("MQBACK", "IBM MQ", "mq"),
    ("IDCAMS", "IBM IDCAMS", "idcams"), ("SORT", "sort product", "sort"), ("ICETOOL", "IBM DFSORT", "sort"), ("ICEMAN", "IBM DFSORT", "sort"), ("DFSORT", "IBM DFSORT", "sort"), ("SYNCSORT", "Syncsort", "sort"),
    ("IKJEFT01", "IBM TSO", "utility"), ("IKJEFT1A", "IBM TSO", "utility"), ("IKJEFT1B", "IBM TSO", "utility"),
]


#: A module's name or prefix, whether it is the whole name, label, subsystem.
Module = tuple[str, bool, str, str]


def load_overrides(path: str) -> list[Module]:
    """A site's list: `PFX*  label` or `NAME  label` a line, `#` before comments."""
    with open(path, encoding="utf-8", errors="replace") as lines:
        found = [re.match(r"\s*([^\s#*]+)(\*?)\s+(.*\S)", line) for line in lines]
    return [(m[1].upper(), not m[2], m[3], "site") for m in found if m]


def modules(overrides: list[Module] | None = None) -> list[Module]:
    """In the order in which they are asked: the site's, exact names, prefixes. The first that fits counts."""
    return [*(overrides or []), *[(n, True, label, s) for n, label, s in EXACT], *[(p, False, label, s) for p, label, s in PREFIXES]]


def classify_module(name: str, overrides: list[Module] | None = None) -> tuple[str, str] | None:
    """(label, subsystem) of one name; None for an application program."""
    name = name.upper()
    return next(((label, s) for key, whole, label, s in modules(overrides) if (name == key if whole else name.startswith(key))), None)


def classified(rows: DataFrame, name: str, overrides: list[Module] | None = None) -> DataFrame:
    """``rows`` with vendor, a struct(label, subsystem) of the module in column ``name``; null for application programs and nulls.

    The beginnings of each distinct name, of every length that a key has, are joined with the keys: an equi-join of small
    tables, however long the site's list is.
    """
    spark = rows.sparkSession
    keys = spark.createDataFrame([(k, whole, i, label, s) for i, (k, whole, label, s) in enumerate(modules(overrides))], "x_key string, x_whole boolean, x_nth int, label string, subsystem string")
    sizes = F.array(*[F.lit(n) for n in sorted({len(k) for k, *_ in modules(overrides)})])
    names = rows.select(F.upper(name).alias("x_module")).where("x_module is not null").distinct()
    begun = names.select("x_module", F.explode(F.transform(F.filter(sizes, lambda n: n <= F.char_length("x_module")), lambda n: F.substring(F.col("x_module"), F.lit(1), n))).alias("x_key"))
    hits = begun.join(keys, "x_key").where("not x_whole or x_key = x_module").groupBy("x_module").agg(F.min_by(F.struct("label", "subsystem"), "x_nth").alias("vendor"))
    return rows.join(hits, F.upper(rows[name]) == F.col("x_module"), "left").drop("x_module")
