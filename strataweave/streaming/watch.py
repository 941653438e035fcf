"""Extension: a table of fingerprints that follows a tree of files: new, edited and deleted ones.

Spark's file source reports a path once, so an edited file would keep its old
fingerprint. Here a clock stream sets the pace and each of its batches compares
the listing with the table by path and time; only files that differ are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..plans.versions import current, replace

SCHEMA = "path string, modified timestamp, hash string"


def fingerprints(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now; empty before the first refresh."""
    at = current(spark, table)
    return spark.read.schema(SCHEMA).parquet(at) if at else spark.createDataFrame([], SCHEMA)


def refresh(spark: SparkSession, root: str, suffix: str, table: str) -> dict[str, int]:
    """Bring the table up to date; how many files are new, edited and deleted. Without a change nothing is written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + suffix).load(root)
    known = fingerprints(spark, table)
    there = files.select("path", F.col("modificationTime").alias("modified"))
    old = known.select("path", F.col("modified").alias("before"), F.lit(True).alias("had"))
    both = there.withColumn("has", F.lit(True)).join(old, "path", "full")
    new, edited = F.col("had").isNull(), F.col("had") & F.col("has") & (F.col("modified") != F.col("before"))
    counts = both.agg(F.count_if(new).alias("new"), F.count_if(F.coalesce(edited, F.lit(False))).alias("edited"), F.count_if(F.col("has").isNull()).alias("deleted")).first().asDict()
    if any(counts.values()):
        same = known.join(there, ["path", "modified"], "left_semi")
        changed = files.withColumn("modified", F.col("modificationTime")).join(same.select("path", "modified"), ["path", "modified"], "left_anti")
        replace(same.union(changed.select("path", "modified", content_hash(F.col("content").cast("string")).alias("hash"))), table)
    return counts


def watch(spark: SparkSession, root: str, suffix: str, table: str, checkpoint: str, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Refresh the table at each tick, or once. A batch that is run again finds nothing to do, so each change counts once."""
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def apply(batch: DataFrame, number: int) -> None:
        refresh(spark, root, suffix, table)

    writer = clock.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
