"""Context passages and redaction over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import ContextConfig, SanitizeConfig
from ..functions.context import extract_context
from ..functions.redact import sanitize


def batch_extract_context(items: DataFrame, query: str, config: ContextConfig = ContextConfig()) -> DataFrame:  # noqa: B008
    """url, title and context of every item (content, url, title; what is missing counts as empty)."""
    of = lambda name: F.coalesce(F.col(name), F.lit("")) if name in items.columns else F.lit("")
    return items.select(of("url").alias("url"), of("title").alias("title"), extract_context(of("content"), query, config).alias("context"))


def sanitized(df: DataFrame, column: str, config: SanitizeConfig = SanitizeConfig()) -> DataFrame:  # noqa: B008
    return df.withColumn(column, sanitize(F.col(column), config))
