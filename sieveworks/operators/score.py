"""Ranking: one query or many over candidate rows.

Candidates have url, title and excerpt; date, score, content_type, site_name, source_weight and locations are optional,
and any other column is kept. ``pos`` is a row's place in the input; rows of equal score keep that order.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import PriorityPage, ScoringConfig
from ..functions import relevance
from ..functions.dates import as_date, days_since
from ..functions.text import extract_query, query_terms
from . import configs as settings, patterns

OPTIONAL = {"date": "string", "score": "double", "content_type": "string", "site_name": "string", "source_weight": "double", "locations": "array<bigint>"}

#: Helper columns.
AGE, TERMS, NAME, CONFIG, PAGES, META = "_days_since", "_terms", "_config_name", "_config", "_pages", "_meta_text"


def completed(df: DataFrame) -> DataFrame:
    """``df`` with the optional columns it lacks, and ``pos`` if it has no order yet."""
    for name, kind in OPTIONAL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())


def scored(
    df: DataFrame, query: str, config: ScoringConfig = ScoringConfig(), primary_query: str | None = None, as_of: str | datetime.date | Column | None = None  # noqa: B008
) -> DataFrame:
    """Set ``score`` (and ``excerpt``, where a priority page has its own) for one query; no sort, no shuffle."""
    df = completed(df)
    terms = query_terms(query, config.language, config.custom_stop_words)
    primary = None if primary_query is None else query_terms(primary_query, config.language)
    pages = relevance.matched_pages(query, config.priority_pages)
    if pages:
        df = df.withColumn("excerpt", relevance.priority_excerpt(pages, F.col("url"), F.col("excerpt")))
    score = relevance.composite(terms, config, relevance.priority_boost(pages, F.col("url")), F.col(AGE), primary)
    return df.withColumn(AGE, days_since(F.col("date"), as_date(as_of))).withColumn("score", score).drop(AGE)


def scored_by_pages(
    df: DataFrame, query: str, pages: DataFrame, config: ScoringConfig = ScoringConfig(), primary_query: str | None = None, as_of: str | datetime.date | Column | None = None  # noqa: B008
) -> DataFrame:
    """``scored``, with the priority pages of ``pages`` (url_pattern, keywords, boost, custom_excerpt; ``page`` orders them) instead
    of the config's, in any number."""
    own = match_priority_pages(pages, query)
    boosts = patterns.page_boosts(df, own).select(F.col("url").alias("_url"), F.col("boost").alias("_boost"), F.col("excerpt").alias("_excerpt"))
    rows = completed(df).join(boosts, F.col("url") == F.col("_url"), "left")
    rows = rows.withColumn("excerpt", F.coalesce("_excerpt", "excerpt")).withColumn(AGE, days_since(F.col("date"), as_date(as_of)))
    terms = query_terms(query, config.language, config.custom_stop_words)
    primary = None if primary_query is None else query_terms(primary_query, config.language)
    score = relevance.composite(terms, config, F.coalesce("_boost", F.lit(0.0)), F.col(AGE), primary)
    return rows.withColumn("score", score).drop(AGE, "_url", "_boost", "_excerpt")


def score_results(
    df: DataFrame, query: str, config: ScoringConfig = ScoringConfig(), primary_query: str | None = None, sort_field: str | None = None, direction: str = "asc",  # noqa: B008
    as_of: str | datetime.date | Column | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Score and sort, best first; ``sort_field`` sorts by a further column instead. Limit and offset are for paging."""
    out = scored(df, query, config, primary_query, as_of)
    out = sort_override(out, sort_field, direction) if sort_field else out.orderBy(F.desc("score"), "pos")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


#: What the core fields are; sorting by one of them finds no row, as only further fields are looked at.
CORE = ("url", "title", "excerpt", *OPTIONAL)


def tail_value(tail: Column, field: str) -> tuple[Column, Column]:
    """Whether an object in a VARIANT has a key, and its value as text: texts and numbers as they are, anything else (null,
    true, lists, objects) as the empty text."""
    value = F.element_at(F.try_variant_get(tail, "$", "map<string,variant>"), field)
    kind = F.schema_of_variant(value)
    told = F.when((kind == "STRING") | kind.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "string")).otherwise(F.lit(""))
    return value.isNotNull(), told


def sort_override(df: DataFrame, field: str, direction: str = "asc", tail: str | None = None) -> DataFrame:
    """Rows that have ``field``, sorted by it: numbers and texts that read as numbers by value, before other texts; then by
    score, best first. "desc" turns the field's order; any other direction is ascending. With ``tail``, a VARIANT column of
    objects, the field is a key of theirs, and a key whose value is null is there."""
    if field in CORE or (tail is None and field not in df.columns):
        return df.filter(F.lit(False))
    there, text = (F.col(field).isNotNull(), F.col(field).cast("string")) if tail is None else tail_value(F.col(tail), field)
    mixed = tail is not None or dict(df.dtypes)[field] == "string"
    rows = df.filter(there).withColumn(META, text)
    number = F.when(F.col(META).rlike(r"(?i)\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z|\A[+-]?(inf|infinity|nan)\z"), F.col(META).try_cast("double"))
    turn = (lambda c: c.desc_nulls_first()) if direction == "desc" else (lambda c: c.asc_nulls_last())
    return rows.orderBy(turn(number), turn(F.col(META)) if mixed else turn(number), F.desc("score"), "pos").drop(META)


def score_each(df: DataFrame, query: str, config: ScoringConfig = ScoringConfig(), as_of: str | datetime.date | Column | None = None) -> DataFrame:  # noqa: B008
    """``scored`` without the phrase multiplier and with excerpts as they are: the score of a row taken alone."""
    df = completed(df)
    terms = query_terms(query, config.language, config.custom_stop_words)
    boost = relevance.priority_boost(relevance.matched_pages(query, config.priority_pages), F.col("url"))
    return score_with_terms(df, terms, config, boost, as_of)


def score_with_terms(df: DataFrame, terms: list[str], config: ScoringConfig, priority: Column, as_of: str | datetime.date | Column | None = None) -> DataFrame:
    """As ``score_each``, for terms and a priority boost that are known."""
    df = completed(df).withColumn(AGE, days_since(F.col("date"), as_date(as_of)))
    return df.withColumn("score", relevance.composite(terms, config, priority, F.col(AGE), phrase=False)).drop(AGE)


def batch_scored(
    queries: DataFrame, results: DataFrame, config: ScoringConfig = ScoringConfig(), configs: Mapping[str, ScoringConfig] | DataFrame | None = None,  # noqa: B008
    as_of: str | datetime.date | Column | None = None,
) -> DataFrame:
    """Score the candidates of many queries.

    ``queries`` has query_id and query, and may have ``config_name``, which names one of ``configs``; a named config replaces
    the default one as a whole. ``configs`` may be a table (see ``operators.configs``): settings then are columns of the
    query's row, and one expression scores by them, however many there are. Terms are taken once for each query, before the one
    join with ``results`` on query_id.
    """
    named = configs is not None and "config_name" in queries.columns and (isinstance(configs, DataFrame) or len(configs) > 0)
    if not named:
        asked = queries.select("query_id", "query", extract_query(F.col("query"), config.language, config.custom_stop_words)["terms"].alias(TERMS))
        rows = completed(results).join(asked, "query_id")
        if config.priority_pages:
            rows = rows.withColumn("excerpt", relevance.priority_excerpt(config.priority_pages, F.col("url"), F.col("excerpt"), F.col("query")))
        boost = relevance.priority_boost(config.priority_pages, F.col("url"), F.col("query"))
        rows = rows.withColumn(AGE, days_since(F.col("date"), as_date(as_of)))
        return rows.withColumn("score", relevance.composite(F.col(TERMS), config, boost, F.col(AGE))).drop(TERMS, AGE)
    known = configs if isinstance(configs, DataFrame) else settings.configs_frame(queries.sparkSession, configs)
    known = known.select(F.col("config_name").alias(NAME), settings.completed(known).alias(CONFIG))
    asked = queries.select("query_id", "query", F.col("config_name").alias(NAME)).join(known, NAME, "left")
    asked = asked.withColumn(CONFIG, F.coalesce(CONFIG, settings.literal(config))).drop(NAME)
    own = settings.Settings(CONFIG)
    asked = asked.withColumn(TERMS, extract_query(F.col("query"), own.language, own.custom_stop_words)["terms"])
    rows = completed(results).join(asked, "query_id").withColumn(AGE, days_since(F.col("date"), as_date(as_of)))
    rows = rows.withColumn(PAGES, relevance.pages_of_row(own.priority_pages, F.col("url"), F.col("query")))
    shown = F.get(F.filter(PAGES, lambda p: p["custom_excerpt"].isNotNull()), F.lit(0))["custom_excerpt"]
    rows = rows.withColumn("excerpt", F.coalesce(shown, F.col("excerpt")))
    boost = F.aggregate(PAGES, F.lit(0.0), lambda acc, p: acc + p["boost"])
    return rows.withColumn("score", relevance.composite(F.col(TERMS), own, boost, F.col(AGE))).drop(TERMS, CONFIG, PAGES, AGE)


def batch_score_results(
    queries: DataFrame, results: DataFrame, config: ScoringConfig = ScoringConfig(), configs: Mapping[str, ScoringConfig] | DataFrame | None = None, as_of=None, top: int | None = None  # noqa: B008
) -> DataFrame:
    """``batch_scored``, sorted by query and score. With ``top``, that many rows for each query and their ``rank``; rows beyond
    are dropped before the shuffle."""
    out = batch_scored(queries, results, config, configs, as_of)
    if top is None:
        return out.orderBy("query_id", F.desc("score"), "pos")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))
    return ranked.filter(F.col("rank") <= top)


def pages_frame(spark: SparkSession, pages: Iterable[PriorityPage]) -> DataFrame:
    rows = [(p.url_pattern, list(p.keywords), float(p.boost), p.custom_excerpt, p.page_id) for p in pages]
    return spark.createDataFrame(rows, "url_pattern string, keywords array<string>, boost double, custom_excerpt string, page_id string")


def match_priority_pages(pages: DataFrame, query: str | Column) -> DataFrame:
    """Pages of which any keyword is part of the query, in any case; an empty keyword always is."""
    low = F.lower(F.lit(query) if isinstance(query, str) else query)
    return pages.filter(F.exists("keywords", lambda k: F.contains(low, F.lower(k))))
