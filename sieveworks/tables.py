"""Tables in the folder that driver and executors share, and places in an order that no task sees as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a temporary folder serves a local master; on a cluster each machine would
    write to a disk of its own, so that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sieveworks/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the table survives lost executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> None:
    """Give back the space of a table that ``written`` made, once all that was derived from it is written itself."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def long_array(values) -> Column:
    """A constant array without a plan node for each entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``rank``, 0 to n-1, to rows that are sorted over their partitions, and return it with n as ``total``.

    The driver gets one count for each partition.
    """
    placed = written(rows.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    begins, n = [0] * (max(counts, default=0) + 1), 0
    for p in sorted(counts):
        begins[p], n = n, n + counts[p]
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("rank", F.element_at(long_array(begins), part.cast("int") + 1) + inside).withColumn("total", F.lit(n).cast("bigint")).drop("_at")
