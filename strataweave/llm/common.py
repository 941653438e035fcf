"""Shared pieces of the corpus operators: stored intermediates and text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"
#: One or more blanks, and one or more characters that are in no word of letters and digits.
BLANK_RUN = r"[\x20\x09-\x0D]+"
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one made for a local session that has none."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(told)
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataweave-"))
    return str(sc.getCheckpointDir()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and its folder with it  # noqa: BLE001, S110
        pass


#: While a table is written: its shuffle files go when the write ends, since nothing needs them any more; and batches for Python workers have few bytes, however long their rows are.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks, never the
    stages before, and a result used twice is computed once. The shuffle files
    of the write go at once; the table goes by ``release`` or ``release_all``,
    at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataweave-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that nothing reads any more."""
    for t in tables:
        if (path := t.__dict__.get("_stored_at")) in _KEPT:
            _delete(_KEPT.pop(path), path)


def release_all() -> None:
    """Delete every stored table: in a long session, once the results built on them are written."""
    while _KEPT:
        path, spark = _KEPT.popitem()
        _delete(spark, path)


_KEPT: dict[str, SparkSession] = {}
atexit.register(release_all)


#: Largest number of rows that is broadcast (keys of 16 to 100 bytes); larger tables are joined by shuffle.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its rows (counted unless told) are within the bound."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def plain_words(text: Column) -> Column:
    """Runs of digits, ASCII letters (lower-cased) and all non-ASCII characters; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_RUN)
    return F.filter(parts, lambda w: w != "")


def named(column: str) -> Column:
    """The column with exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a range of a sorted sweep, at most about.
RANGE_ROWS = 2_000_000


def ordered_last(events: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``events`` with ``name``: the last non-null ``value`` at or before each row in the order of ``order``.

    A sorted sweep over range partitions. Together the columns of ``order``
    should tell rows apart, so that a frequent key is cut like any other. Events
    are stored first, since cutting ranges reads them twice. Each range, of a
    bounded number of rows, is swept by a window; what a range starts with is the
    last value of the ranges before it (one row a range, joined by broadcast
    within its bound).
    """
    events = stored(events, "events")
    n = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), events.count() // RANGE_ROWS)
    ranged = stored(events.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    release(events)
    here = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ends = ranged.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    swept = ranged.withColumn("_last", F.last(value, ignorenulls=True).over(here))
    return swept.join(small(carried, n), "_part").withColumn(name, F.coalesce("_last", "_carried")).drop("_part", "_last", "_carried")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds little beside what Spark sends."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
