"""Redaction of personal data, pattern by pattern in a fixed order."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

from ..config import SanitizeConfig

# The patterns, and what stands in for a match.
CARD = r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
ADDRESS = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def steps(config: SanitizeConfig) -> list[tuple[str, str]]:
    """Card before phone, as 16 digits hold 10."""
    wanted = (
        (config.redact_credit_card, CARD, "[CC]"), (config.redact_ssn, SSN, "[SSN]"), (config.redact_email, EMAIL, "[EMAIL]"),
        (config.redact_phone, PHONE, "[PHONE]"), (config.redact_ip, ADDRESS, "[IP]"),
    )
    own = [(p, java_replacement(r)) for p, r in config.custom_patterns if compiles(p)]
    return [(f"(?U){pattern}", token) for pattern, token in [*((p, t) for on, p, t in wanted if on), *own]]


def compiles(pattern: str) -> bool:
    """Whether Spark takes the pattern; one that is no regular expression is left out. Any other error is raised, as a
    pattern that is skipped for a wrong reason would let personal data through."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:  # over a constant row the optimizer computes it, so no job runs
        spark.sql("VALUES ('x')").select(F.regexp_replace("col1", F.lit(f"(?U){pattern}"), F.lit(""))).collect()
    except PySparkException as e:
        if e.getCondition() == "INVALID_PARAMETER_VALUE.PATTERN":
            return False
        raise
    return True


def java_replacement(text: str) -> str:
    """``$1``, ``$name``, ``${name}`` and ``$$`` in the JVM's notation. A name is as long as it can be, so ``$1a`` is the group
    named 1a; groups that cannot exist are empty."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name.isdigit():
            return f"${name}"
        return f"${{{name}}}" if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", name) else ""

    out, at = [], 0
    for m in re.finditer(r"\$\$|\$\{([^}]*)\}|\$([0-9A-Za-z_]+)", text):
        out += [re.sub(r"([\\$])", r"\\\1", text[at : m.start()]), one(m)]
        at = m.end()
    return "".join([*out, re.sub(r"([\\$])", r"\\\1", text[at:])])


def sanitize(text: Column, config: SanitizeConfig = SanitizeConfig()) -> Column:  # noqa: B008
    for pattern, token in steps(config):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(token))
    return text
