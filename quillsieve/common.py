"""Table access and partitioning shared by all operators."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, unless their PYTHONPATH or working directory has it already."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if home in there or home.endswith(".zip") or app in _SHIPPED:
        return
    base = os.path.join(tempfile.mkdtemp(prefix="quillsieve-"), "quillsieve")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", home, "quillsieve"))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Task slots of the running application."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, waves: int = 3) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks.

    A scan that already has four tasks for three slots is left alone, so a large input is never shuffled for this; a small
    one, read from one or two files, is hash-partitioned by ``keys`` (round robin without keys). Only the number of tasks
    depends on the size, never a result.
    """
    spark = df.sparkSession
    wanted = slots(spark) * waves
    if df.rdd.getNumPartitions() * 1.5 >= slots(spark) * 2:
        return df
    return df.repartition(wanted, *keys) if keys else df.repartition(wanted)


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary one if the
    whole application runs on this machine (tests); on a cluster that raises, since executors can't share such a folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillsieve-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, by: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row per ``keys`` and in ``n`` how many rows will meet it.

    A key of more than ``hot_rows`` rows is spread by a hash of ``by`` over as many salts as it needs, so no task gets an
    unbounded group; its one row of ``counted`` is repeated as often.
    """
    salts = F.greatest(F.ceil(F.col(n) / hot_rows), F.lit(1)).cast("int")
    hot = counted.where(F.col(n) > hot_rows).select(*keys, salts.alias("__salts"))
    each = counted.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    # Fewer than rows / hot_rows keys are hot; that bound grows with the data, so the planner decides how to join.
    salted = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), F.coalesce("__salts", F.lit(1))).cast("int"))
    return salted.join(each, [*keys, "__salt"]).drop("__salt", "__salts")


def newest(df: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """One row per ``key``: of redelivered rows the one ingested last; rows without a key are kept out.

    Redelivered rows carry the same content, so which of the equal ones stays does not matter; ``max_by`` keeps the
    choice inside a partial aggregation instead of a window sort.
    """
    cols = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(at)).alias("__row"))
    return best.select(key, *[F.col("__row").getField(c).alias(c) for c in cols])


def env(name: str, default: str) -> str:
    return os.environ.get(name, default)
