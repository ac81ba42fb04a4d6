"""Settings as data: scoring configs in a table, a row each, read and checked by Columns.

A table of configs has ``config_name`` and any of the settings as columns; a setting that is missing or null takes its default.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import RANGES, STRATEGIES, ConfigWarning, ScoringConfig

KINDS = {
    "recency_half_life_days": "bigint", "recency_penalty_after_days": "bigint", "phrase_near_window": "bigint", "phrase_window": "bigint", "excerpt_length": "bigint",
    "results_per_page": "bigint", "max_pagefind_results": "bigint", "recency_strategy": "string", "language": "string", "custom_stop_words": "array<string>",
    "recency_curve": "array<struct<day:double,boost:double>>",
    "priority_pages": "array<struct<url_pattern:string,keywords:array<string>,boost:double,custom_excerpt:string,page_id:string>>",
}
#: Every setting in order, with its type.
SETTINGS = {f.name: KINDS.get(f.name, "double") for f in fields(ScoringConfig)}
SCHEMA = ", ".join(f"{n} {k}" for n, k in SETTINGS.items())
WARNINGS = "array<struct<field:string,message:string>>"


class Settings:
    """The settings of a struct column, by name, where a ``ScoringConfig`` has values."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        if name not in SETTINGS:
            raise AttributeError(name)
        return F.col(f"{self._prefix}.{name}")


def values_of(config: ScoringConfig) -> tuple:
    """A config as the values of a row."""
    pages = [(p.url_pattern, list(p.keywords), float(p.boost), p.custom_excerpt, p.page_id) for p in config.priority_pages]
    own = {"priority_pages": pages, "custom_stop_words": list(config.custom_stop_words), "recency_curve": [tuple(map(float, p)) for p in config.recency_curve]}
    return tuple(own[n] if n in own else float(getattr(config, n)) if k == "double" else getattr(config, n) for n, k in SETTINGS.items())


def configs_frame(spark: SparkSession, named: Mapping[str, ScoringConfig]) -> DataFrame:
    return spark.createDataFrame([(name, *values_of(c)) for name, c in named.items()], f"config_name string, {SCHEMA}")


def literal(config: ScoringConfig) -> Column:
    """A config as a constant struct."""

    def of(value, kind: str) -> Column:
        if kind == "array<string>":
            return F.array(*map(F.lit, value)).cast(kind)
        if kind == KINDS["recency_curve"]:
            return F.array(*[F.struct(F.lit(x), F.lit(y)) for x, y in value]).cast(kind)
        if kind == KINDS["priority_pages"]:
            return F.array(*[F.struct(F.lit(u), F.array(*map(F.lit, ks)).cast("array<string>"), F.lit(b), F.lit(e), F.lit(i)) for u, ks, b, e, i in value]).cast(kind)
        return F.lit(value).cast(kind)

    return F.struct(*[of(v, k).alias(n) for (n, k), v in zip(SETTINGS.items(), values_of(config), strict=True)])


def completed(configs: DataFrame) -> Column:
    """The settings of a table's row as a struct, with defaults for what is missing, null or negative where counts are wanted."""
    usual = dict(zip(SETTINGS, values_of(ScoringConfig()), strict=True))
    default = literal(ScoringConfig())

    def of(name: str, kind: str) -> Column:
        own = F.col(name).cast(kind) if name in configs.columns else F.lit(None).cast(kind)
        if kind == "bigint":
            own = F.when(own >= 0, own)
        return F.coalesce(own, default[name] if isinstance(usual[name], list) else F.lit(usual[name]).cast(kind)).alias(name)

    return F.struct(*[of(n, k) for n, k in SETTINGS.items()])


def shown(value: Column, kind: str) -> Column:
    """A number as Python writes it."""
    if kind != "double":
        return value.cast("string")
    size, text = F.abs(value), value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"0+\z", ""), r"\.\z", ".0")
    digits = F.regexp_replace(F.regexp_extract(text, r"\A(.*)E", 1), r"\.0\z", "")
    power = F.regexp_extract(text, r"E-?(.*)\z", 1)
    written = F.concat(digits, F.when(F.contains(text, F.lit("E-")), F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
    return F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(written)


def warning(when: Column, field: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), message.alias("message")))


def validated(configs: DataFrame) -> DataFrame:
    """The table with every setting completed and moved into its range, and ``warnings``: those of ``ScoringConfig.clamped``, in
    its order. Other columns stay."""
    others = [c for c in configs.columns if c not in SETTINGS and c != "warnings"]
    rows = configs.select(*others, completed(configs).alias("_c"))
    known = Settings("_c")
    found, moved = [], {}
    for name, (low, high) in RANGES.items():
        value, kind = getattr(known, name), SETTINGS[name]
        moved[name] = F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast(kind)
        used = F.when(value < low, F.lit(f"{low:g}")).otherwise(F.lit(f"{high:g}"))
        text = F.concat(shown(value, kind), F.lit(f" is not within {low} to {high}; "), used, F.lit(" is used"))
        found.append(warning(~value.between(low, high), name, text))
    strategy, curve = known.recency_strategy, known.recency_curve
    found.append(warning(~strategy.isin(*STRATEGIES), "recency_strategy", F.concat(F.lit("'"), strategy, F.lit(f"' is none of {', '.join(STRATEGIES)}"))))
    sample = {w.message: w for w in ScoringConfig(recency_strategy="custom").warnings()}
    found += [warning((strategy == "custom") & (F.size(curve) == 0), w.field, F.lit(text)) for text, w in sample.items()]
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(curve) - 1, F.lit(1))), lambda k: F.get(curve, k)["day"] <= F.get(curve, k - 1)["day"])
    found += [warning(F.coalesce(falls, F.lit(False)), w.field, F.lit(w.message)) for w in ScoringConfig(recency_curve=((1.0, 0.0), (0.0, 0.0))).warnings()]
    told = F.filter(F.array(*found), lambda w: w.isNotNull()).cast(WARNINGS)
    return rows.select(*others, *[moved.get(n, getattr(known, n)).alias(n) for n in SETTINGS], told.alias("warnings"))


def warnings_of(row) -> list[ConfigWarning]:
    return [ConfigWarning(w["field"], w["message"]) for w in row["warnings"]]
