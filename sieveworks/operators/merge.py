"""Merging of weighted result sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F


def url_key(url: Column, normalize: bool = False) -> Column:
    """The URL; normalized without trailing slashes and http(s), its host in lower case."""
    if not normalize:
        return url
    bare = F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"\A(https://|http://)", "")
    slash = F.instr(bare, "/")
    host = F.lower(F.substring(bare, F.lit(1), slash - 1))
    return F.when(slash > 0, F.concat(host, F.substring(bare, slash, F.length(bare)))).otherwise(F.lower(bare))


def weighted(sets: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """All sets, scores times weight, with the set's number and the row's place in it. Columns may differ between sets."""
    def one(k: int, df: DataFrame, weight: float) -> DataFrame:
        df = df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())
        score = F.coalesce(F.col("score"), F.lit(0.0)) if "score" in df.columns else F.lit(0.0)
        return df.withColumn("score", score * float(weight)).withColumn("set_id", F.lit(k))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(k, df, w) for k, (df, w) in enumerate(sets)])


def dedup_key(by: str, case_sensitive: bool, normalize_urls: bool) -> Column:
    """Titles for "title", URLs for any other name."""
    if by == "title":
        return F.col("title") if case_sensitive else F.lower("title")
    return url_key(F.col("url"), normalize_urls)


def keep_first(df: DataFrame, key: Column) -> DataFrame:
    """The best row of each key. Rows are reduced within their partitions before they are shuffled, so no key is too large."""
    order = F.struct((-F.col("score")).alias("s"), F.col("set_id"), F.col("pos"))
    first = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return first.select("_row.*")


def excluded(df: DataFrame, urls: Sequence[str] | DataFrame, normalize_urls: bool) -> DataFrame:
    """Rows whose URL key is none of ``urls``; a table of them has the column ``url``."""
    if not isinstance(urls, DataFrame):
        keys = [url_key(F.lit(u), normalize_urls) for u in urls]
        return df.filter(~F.coalesce(url_key(F.col("url"), normalize_urls).isin(keys), F.lit(False))) if keys else df
    key = url_key(F.col("url"), normalize_urls)
    return df.withColumn("_out", key).join(out_keys(urls, normalize_urls), "_out", "left_anti").drop("_out")


def merge_results(
    sets: Sequence[tuple[DataFrame, float]], deduplicate_by: str | None = None, case_sensitive: bool = False,
    exclude_urls: Sequence[str] | DataFrame = (), normalize_urls: bool = False, ordered: bool = True,
) -> DataFrame:
    """Union, then the best row of each key, then exclusion (an excluded row still stands for its duplicates), best first."""
    df = weighted(sets)
    if deduplicate_by is not None:
        df = keep_first(df, dedup_key(deduplicate_by, case_sensitive, normalize_urls))
    df = excluded(df, exclude_urls, normalize_urls)
    return df.orderBy(F.desc("score"), "set_id", "pos") if ordered else df


def out_keys(urls: DataFrame, normalize_urls: bool) -> DataFrame:
    return urls.select(url_key(F.col("url"), normalize_urls).alias("_out")).distinct()


def counts(n: int) -> list[Column]:
    return [*[F.count(F.when(F.col("set_id") == k, 1)).alias(f"_{k}") for k in range(n)], F.count(F.lit(1)).alias("_all")]


def merge_stats(
    sets: Sequence[tuple[DataFrame, float]], deduplicate_by: str | None = None, case_sensitive: bool = False,
    exclude_urls: Sequence[str] | DataFrame = (), normalize_urls: bool = False,
) -> DataFrame:
    """One row: weight and input_count of each set, total_before_dedup, total_after_dedup, excluded_count. Each set is read once:
    rows are counted within the aggregation that finds the best of each key."""
    df, n = weighted(sets), len(sets)
    ones = [F.col("url"), *[(F.col("set_id") == k).cast("bigint").alias(f"_{k}") for k in range(n)], F.lit(1).cast("bigint").alias("_all")]
    if deduplicate_by is None:
        best = df.select(*ones)
    else:
        order = F.struct((-F.col("score")).alias("s"), F.col("set_id"), F.col("pos"))
        key = dedup_key(deduplicate_by, case_sensitive, normalize_urls)
        best = df.groupBy(key.alias("_key")).agg(F.min_by("url", order).alias("url"), *counts(n)).drop("_key")
    key = url_key(F.col("url"), normalize_urls)
    if isinstance(exclude_urls, DataFrame):
        best = best.withColumn("_out", key).join(out_keys(exclude_urls, normalize_urls).withColumn("_hit", F.lit(1)), "_out", "left")
    else:
        out = [url_key(F.lit(u), normalize_urls) for u in exclude_urls]
        best = best.withColumn("_hit", F.when(key.isin(out) if out else F.lit(False), F.lit(1)))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    one = best.agg(*[total(f"_{k}").alias(f"_{k}") for k in range(n)], total("_all").alias("total_before_dedup"), F.count(F.lit(1)).alias("total_after_dedup"), F.count("_hit").alias("excluded_count"))
    shown = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"_{k}").alias("input_count")) for k, (_, w) in enumerate(sets)])
    return one.select(shown.alias("sets"), "total_before_dedup", "total_after_dedup", "excluded_count")


def merge_observed(
    sets: Sequence[tuple[DataFrame, float]], deduplicate_by: str | None = None, case_sensitive: bool = False,
    exclude_urls: Sequence[str] | DataFrame = (), normalize_urls: bool = False,
) -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """The merged rows, unsorted, and the figures of ``merge_stats``, which are observed while the rows are computed: call for
    them after one action on the rows. (A sort would compute rows twice, to find its ranges, and count them twice.)"""
    before, after, left = Observation(), Observation(), Observation()
    df = weighted(sets).observe(before, *counts(len(sets)))
    if deduplicate_by is not None:
        df = keep_first(df, dedup_key(deduplicate_by, case_sensitive, normalize_urls))
    df = excluded(df.observe(after, F.count(F.lit(1)).alias("n")), exclude_urls, normalize_urls).observe(left, F.count(F.lit(1)).alias("n"))

    def figures() -> dict[str, Any]:
        all_of, kept = before.get, after.get["n"]
        return {
            "sets": [{"weight": float(w), "input_count": all_of[f"_{k}"]} for k, (_, w) in enumerate(sets)],
            "total_before_dedup": all_of["_all"], "total_after_dedup": kept, "excluded_count": kept - left.get["n"],
        }

    return df, figures
