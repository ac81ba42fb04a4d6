"""What the request interface offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import __version__

INTERFACE_VERSION = 1

#: name, description, since, stability, input, output.
FUNCTIONS = (
    ("score_results", "Score candidates of a query and sort them", "0.1.0", "stable", "json", "json"),
    ("merge_results", "Merge weighted result sets, without duplicates and excluded URLs", "0.1.0", "stable", "json", "json"),
    ("match_priority_pages", "Priority pages whose keywords are part of a query", "0.1.0", "stable", "json", "json"),
    ("parse_expansion", "Search terms out of a language model's answer", "0.1.0", "stable", "string", "json"),
    ("batch_score_results", "Score the candidates of many queries", "0.1.0", "stable", "json", "json"),
    ("resolve_prompt", "Fill a prompt template", "0.1.0", "stable", "json", "string"),
    ("get_prompt", "A prompt template as it is", "0.1.0", "stable", "string", "string"),
    ("extract_context", "Passages of a document around a query's words", "0.1.0", "stable", "json", "string"),
    ("batch_extract_context", "Passages of many documents", "0.1.0", "stable", "json", "json"),
    ("sanitize_query", "Redact personal data in a text", "0.1.0", "stable", "json", "string"),
    ("truncate_conversation", "Trim a conversation to a number of bytes", "0.1.0", "stable", "json", "json"),
    ("version", "Version of this library", "0.1.0", "stable", "none", "string"),
    ("describe", "This list", "0.1.0", "stable", "none", "json"),
)
FIELDS = ("name", "description", "since", "stability", "input_type", "output_type")


def version() -> str:
    return __version__


def describe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FUNCTIONS), ", ".join(f"{f} string" for f in FIELDS))
