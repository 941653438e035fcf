"""The stored snapshot: which version of a file, and which model, a description was made for.

It is a log: a run writes only what it made, as an addition partitioned by kind,
and what did not change is neither read nor written. Reading takes the base
without the files that an addition names, and of these the last one's rows; after
``ADDITIONS`` additions they are put together into a new base.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest, small, stale, upsert
from ..sources.files import exists
from .versions import append, members, replace

warn = logging.getLogger(__name__).warning

VERSION = 1
SCHEMA = "kind string, path string, hash string, model string, documentation string, metadata string, name string, cache_version int"
KEY = ["kind", "path"]
NEVER_FRESH = ("custom-metadata",)
#: Additions after which the next one makes a new base.
ADDITIONS = 8


def empty(spark: SparkSession) -> DataFrame:
    """A snapshot of nothing, of which the plan knows it: joins with it are not run."""
    return spark.createDataFrame([], SCHEMA).where(F.lit(False))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot; an absent, unreadable or older one is an empty snapshot and a warning, never an error."""
    try:
        if not (parts := members(spark, path)):
            if exists(spark, path):
                warn("%s has no current version and is left aside", path)
            return empty(spark)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        base, *added = [spark.read.parquet(p).select(*names) for p in parts]
        others = [df.where(F.coalesce("cache_version", F.lit(0)) != VERSION).isEmpty() for df in (base, *added)]
        if all(others):
            return _together(base, added)
        warn("%s has another version and is left aside", path)
    except Exception as e:  # noqa: BLE001
        warn("%s cannot be read and is left aside: %s", path, str(e).splitlines()[0])
    return empty(spark)


def _together(base: DataFrame, added: list[DataFrame]) -> DataFrame:
    """Base and additions; of several rows of a file those of the last addition hold."""
    if not added:
        return base
    rows = None
    for i, df in enumerate(added):
        part = df.withColumn("_at", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    last = latest(rows, KEY, ["_at", "hash"]).drop("_at")
    return base.join(small(last.select(*KEY)), KEY, "left_anti").unionByName(last.select(*base.columns))


def save(snapshot: DataFrame, path: str) -> None:
    """Replace the snapshot: a reader sees the old one or the new one."""
    replace(snapshot.withColumn("cache_version", F.lit(VERSION)), path, by="kind")


def add(made: DataFrame, path: str, model: str) -> None:
    """Add what was made to the stored snapshot; with many additions, or without a snapshot that can be read, the whole is written anew."""
    spark, parts = made.sparkSession, members(made.sparkSession, path)
    if not parts:
        save(update(empty(spark), made, model), path)
    elif len(parts) <= ADDITIONS and not load(spark, path).isEmpty():
        append(_rows(made, model), path, by="kind")
    else:
        save(update(load(spark, path), made, model), path)


def split(files: DataFrame, snapshot: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """``(to make, up to date)``: the latter with their documentation; a file is fresh by kind, path, hash and model."""
    known = snapshot.where((F.col("model") == model) & ~F.col("kind").isin(*NEVER_FRESH)).select("kind", "path", "hash", "documentation")
    return stale(files, known, ["kind", "path", "hash"]), files.join(known, ["kind", "path", "hash"])


def _rows(made: DataFrame, model: str) -> DataFrame:
    return made.select("kind", "path", "hash", F.lit(model).alias("model"), "documentation", "metadata", "name", F.lit(VERSION).alias("cache_version"))


def update(snapshot: DataFrame, made: DataFrame, model: str) -> DataFrame:
    """The snapshot with what was made in place of the files' rows; of several rows of a file the last by hash."""
    return upsert(snapshot, _rows(made, model), KEY, ["hash"])


def vacuum(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """Without the entries of files that are gone."""
    return snapshot.join(files.select(*KEY), KEY, "left_semi")
