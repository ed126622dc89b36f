"""Batches of files and of already extracted texts, and the sinks that results go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extension

#: Bytes that a file and a batch may have.
FILE_BYTES, BATCH_BYTES = 8 << 20, 10 << 20


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, extension, content_key, length, content) of the files under a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), extension(name).alias("extension"), F.sha2("content", 256).alias("content_key"), "length", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def within_limits(batch: DataFrame, size: str, order: str, group: str, file_bytes: int = FILE_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds running (bytes so far in the group, in order) and accepted: whether the file and the running total stay
    within the limits. Null sizes count 0."""
    n = F.coalesce(F.col(size), F.lit(0))
    running = F.sum(n).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return batch.withColumn("running", running).withColumn("accepted", (n <= file_bytes) & (F.col("running") <= batch_bytes))


def distinct_contents(batch: DataFrame, key: str = "content_key", order: str = "path") -> DataFrame:
    """One row per content, the first in order."""
    cols = [c for c in batch.columns if c != key]
    best = batch.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r"))
    return best.select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new: a key of both has new's row. Columns that one side lacks are null there."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results of any version: members that a file lacks are null, unreadable lines are left out."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r._bad IS NULL AND r IS NOT NULL").select("r.*").drop("_bad")


def removed(kept: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """A keyed table without the rows of ``keys``."""
    return kept.join(keys.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; an existing result is kept until the new one is whole."""
    df.write.mode("overwrite").json(path)
