"""Operators as SQL functions of the session; Catalyst inlines their bodies, so plain SQL runs the same native expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import SanitizeConfig, ScoringConfig
from . import context, redact
from .text import stop_words


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bodies(language: str = "en", config: ScoringConfig = ScoringConfig()) -> dict[str, tuple[str, str, str]]:  # noqa: B008
    """Name: parameters, result type, body."""
    stops = ", ".join(map(quoted, sorted(set(stop_words(language))))) or "''"
    valid = r"t RLIKE '\\A[+]?[0-9]+-[+]?[0-9]+-[+]?[0-9]+\\z'"
    part = lambda k: f"try_cast(get(split(t, '-'), {k}) AS INT)"
    in_range = f"{valid} AND {part(0)} BETWEEN 1 AND 9999 AND {part(1)} BETWEEN 1 AND 12 AND {part(2)} BETWEEN 1 AND 31"
    day = f"CASE WHEN {in_range} THEN date_add(make_date({part(0)}, {part(1)}, 1), {part(2)} - 1) END"
    cleaned = "t"
    for pattern, token in redact.steps(SanitizeConfig()):
        cleaned = f"regexp_replace({cleaned}, {quoted(pattern)}, {quoted(token)})"
    c, age = config, "CAST(datediff(as_of, sw_parse_date(t)) AS DOUBLE)"
    limit, half = float(c.recency_penalty_after_days), float(c.recency_half_life_days)
    recency = (
        f"CASE WHEN sw_parse_date(t) IS NULL THEN 0D WHEN {age} < 0 THEN {c.recency_boost_max}D WHEN {age} < {limit}D "
        f"THEN {c.recency_boost_max}D * exp(-{age} / {half}D * ln(2D)) ELSE -least(({age} - {limit}D) / 365D * 0.05D, {c.recency_max_penalty}D) END"
    )
    bare = r"regexp_replace(regexp_replace(t, '/+\\z', ''), '\\A(https://|http://)', '')"
    return {
        "sw_is_stop_word": ("t STRING", "BOOLEAN", f"lower(t) IN ({stops})"),
        "sw_is_valid_term": ("t STRING", "BOOLEAN", rf"octet_length(t) >= 2 AND NOT t RLIKE '\\A[0-9]+\\z' AND NOT lower(t) IN ({stops})"),
        "sw_terms": ("t STRING", "ARRAY<STRING>", rf"filter(split(lower(coalesce(t, '')), '(?U)\\s+'), x -> octet_length(x) > 1 AND NOT x IN ({stops}))"),
        "sw_parse_date": ("t STRING", "DATE", day),
        "sw_recency": ("t STRING, as_of DATE", "DOUBLE", recency),
        "sw_url_key": ("t STRING", "STRING", f"CASE WHEN instr({bare}, '/') > 0 THEN concat(lower(substring_index({bare}, '/', 1)), substring({bare}, instr({bare}, '/'))) ELSE lower({bare}) END"),
        "sw_sanitize": ("t STRING", "STRING", cleaned),
        "sw_first_sentences": (
            "t STRING, n INT", "STRING",
            f"CASE WHEN length(t) <= n THEN t ELSE concat(substring(t, 1, greatest(n - {context.LOOK_BACK}, 0)), regexp_extract("
            f"substring(t, greatest(n - {context.LOOK_BACK}, 0) + 1, least(n, {context.LOOK_BACK})), {quoted(context.SENTENCE)}, 1)) END",
        ),
    }


def register(spark: SparkSession, language: str = "en", config: ScoringConfig = ScoringConfig()) -> list[str]:  # noqa: B008
    """Create or replace the functions in this session; returns their names."""
    made = bodies(language, config)
    for name, (parameters, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(made)
