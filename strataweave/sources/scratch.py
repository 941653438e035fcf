"""Tables that a plan needs twice and must find equal both times: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_LOCAL: list[tempfile.TemporaryDirectory] = []
_LOCK = threading.Lock()


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session that has none gets a folder of its own, which goes when the driver ends."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        with _LOCK:
            if not _LOCAL:
                _LOCAL.append(tempfile.TemporaryDirectory(prefix="strataweave-"))
        told = _LOCAL[0].name
    return f"{told.rstrip('/')}/flow-{uuid.uuid4().hex}"


def passing(spark: SparkSession) -> str:
    """A new path as ``folder`` gives it, for a table that goes when the driver ends."""
    path = folder(spark)
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor costs its running tasks, and every reader sees the same rows. It goes when the driver ends."""
    path = passing(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, schema: str, makes: Iterable[Callable[[], DataFrame]], at_once: int) -> DataFrame:
    """The rows of several tables as one, each ``stored`` for itself, some at once."""

    def put(make: Callable[[], DataFrame]) -> str:
        path = passing(spark)
        make().write.parquet(path)
        return path

    with ThreadPoolExecutor(at_once) as pool:
        return spark.read.schema(schema).parquet(*pool.map(put, makes))


@contextlib.contextmanager
def room(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``stored`` whose tables go when the block ends."""
    paths = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(path := folder(spark))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session is gone, and its folder with it
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for spark, path in _MADE:
        _delete(spark, path)


atexit.register(_clear)
