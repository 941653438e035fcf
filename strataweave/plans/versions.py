"""Tables that are replaced as a whole: a folder a version, and a pointer file that names the current one.

A version is written beside the others and never changed. Replacing the pointer
is one atomic rename, so a reader sees the old table or the new one, at no time
none. The version before stays for readers that have begun; older ones go.

A table can also be a log: ``append`` writes only new rows, as a further folder
that the pointer names after the base. Who reads puts base and additions together
(``members`` names them in order); ``replace`` starts a new base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import file_system

POINTER = "CURRENT"


def members(spark: SparkSession, path: str) -> list[str]:
    """The folders of the current version: its base, then its additions from the oldest on; none if there is no table."""
    fs, at = file_system(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        names = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()
    return [f"{path}/{name}" for name in names]


def current(spark: SparkSession, path: str) -> str | None:
    """The base folder of the current version; none if there is no table."""
    return next(iter(members(spark, path)), None)


def replace(df: DataFrame, path: str, by: str | None = None) -> str:
    """Write ``df`` as the next version, partitioned ``by`` a column, make it current and give its folder."""
    return _write(df, path, by, [])


def append(df: DataFrame, path: str, by: str | None = None) -> str:
    """Write ``df`` as an addition to the current version, which must be there, and give its folder."""
    known = members(df.sparkSession, path)
    if not known:
        raise FileNotFoundError(f"{path} has no current version")
    return _write(df, path, by, known)


def _write(df: DataFrame, path: str, by: str | None, onto: list[str]) -> str:
    spark = df.sparkSession
    before, new = members(spark, path), f"{path}/v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(new)
    _point(spark, path, [m.rsplit("/", 1)[1] for m in [*onto, new]])
    fs, folder = file_system(spark, path)
    for status in fs.listStatus(folder):
        old = status.getPath().getName()
        if old.startswith("v-") and f"{path}/{old}" not in (*onto, new, *before):
            fs.delete(status.getPath(), True)
    return new


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, fresh = file_system(spark, f"{path}/.{POINTER}-{names[-1]}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray("\n".join(names).encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files.rename(fs.makeQualified(fresh), fs.makeQualified(file_system(spark, f"{path}/{POINTER}")[1]), options)
