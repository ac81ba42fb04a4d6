"""Many patterns in many texts: which text holds which pattern, by rare pieces instead of a test for each pair.

Every pattern is filed under one of its pieces of ``PIECE`` characters, the one that the fewest texts have; a shorter pattern is
its own piece. Texts meet the patterns through their own pieces, and what meets is verified. No pair is looked at that does not
share the pattern's rarest piece, and neither side is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIECE = 4


def pieces(text: Column, width: int | Column) -> Column:
    """The different pieces of ``width`` characters; none of a shorter text."""
    n = F.length(text) - width + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(text, k, F.lit(width) if isinstance(width, int) else width))))


def all_pieces(text: Column, widths: list[int]) -> Column:
    """Of each of the widths. They do not mix, as each piece has its own."""
    return F.concat(F.array().cast("array<string>"), *[F.coalesce(pieces(text, w), F.array().cast("array<string>")) for w in widths])


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(text, pattern) of all different texts and patterns of which the text holds the pattern. Nulls meet nothing; the empty
    pattern, which every text holds, is left to the caller. The driver learns which widths of pieces there are, ``PIECE`` at most."""
    t = texts.select(F.col(text).alias("_text")).filter("_text is not null").distinct()
    p = patterns.select(F.col(pattern).alias("_pattern")).filter("_pattern <> ''").distinct()
    width = F.least(F.length("_pattern"), F.lit(PIECE))
    filed = p.select("_pattern", F.explode(pieces(F.col("_pattern"), width)).alias("_piece"))
    widths = [r["_w"] for r in p.select(width.alias("_w")).distinct().collect()]
    # Only pieces that a pattern has are of interest; how many texts have each is counted before it is shuffled.
    wanted = filed.select("_piece").distinct()
    met = t.select("_text", F.explode(all_pieces(F.col("_text"), widths)).alias("_piece")).join(wanted, "_piece", "left_semi")
    uses = met.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = filed.join(uses, "_piece").groupBy("_pattern").agg(F.min(F.struct("_n", "_piece")).alias("_r"), F.count(F.lit(1)).alias("_found"))
    # A pattern one of whose pieces no text has is in no text.
    whole = F.size(pieces(F.col("_pattern"), width))
    rarest = rarest.filter(F.col("_found") == whole).select("_pattern", F.col("_r._piece").alias("_piece"))
    return met.join(rarest, "_piece").filter(F.contains("_text", F.col("_pattern"))).select(F.col("_text").alias(text), F.col("_pattern").alias(pattern))


def page_boosts(results: DataFrame, pages: DataFrame) -> DataFrame:
    """url, boost, excerpt: for each URL with a page whose pattern it holds, the sum of their boosts, and of those with an excerpt
    the one that comes first by ``page``. The empty pattern is part of every URL."""
    urls = results.select("url").filter("url is not null").distinct()
    filed = pages.withColumn("_pattern", F.col("url_pattern"))
    met = contained(urls, "url", filed, "_pattern").join(filed, "_pattern").drop("_pattern")
    every = filed.filter("_pattern = ''").agg(F.sum("boost").alias("_boost"), F.min_by("custom_excerpt", F.when(F.col("custom_excerpt").isNotNull(), F.col("page"))).alias("_excerpt"), F.min(F.when(F.col("custom_excerpt").isNotNull(), F.col("page"))).alias("_page")).first()
    first = F.struct(F.col("page"), F.col("custom_excerpt"))
    found = met.groupBy("url").agg(F.sum("boost").alias("boost"), F.min(F.when(F.col("custom_excerpt").isNotNull(), first)).alias("_first"))
    if every["_boost"] is None:
        return found.select("url", "boost", F.col("_first.custom_excerpt").alias("excerpt"))
    own = F.when(F.col("_first.page") <= F.lit(every["_page"]), F.col("_first.custom_excerpt")).otherwise(F.lit(every["_excerpt"])) if every["_page"] is not None else F.col("_first.custom_excerpt")
    out = urls.join(found, "url", "left")
    return out.select("url", (F.coalesce("boost", F.lit(0.0)) + F.lit(every["_boost"])).alias("boost"), own.alias("excerpt"))
