"""What several corpus operators need: written tables of the core, texts, salted leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import emptied, fresh_path, long_array, numbered, shared_dir, written

__all__ = ["SALTS", "emptied", "fresh_path", "long_array", "numbered", "shared_dir", "table", "text_of", "with_leader", "written"]

#: Salts over which the rows of one hot key are spread before they are counted.
SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def with_leader(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``leader`` (smallest ``order`` among rows of equal ``key``) and ``members`` (their number).

    A key that holds a third of all rows neither sorts nor joins in one task: rows are first summed per
    (key, salt), these sums per key, and the totals go back over (key, salt), of which each has few rows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(order)), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(key, "_salt").agg(F.min(order).alias("_low"), F.count(F.lit(1)).alias("_n"))
    total = part.groupBy(key).agg(F.min("_low").alias("leader"), F.sum("_n").alias("members"))
    back = part.select(key, "_salt").join(total, key)
    return salted.join(back, [key, "_salt"]).drop("_salt")
