"""Settings of the operators. Dictionaries are read leniently: what is missing or of a wrong type takes its default."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any


def _number(v: Any) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _count(v: Any) -> int | None:
    """A non-negative integer, kept to 32 bits."""
    return v % 2**32 if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else None


def _flag(v: Any) -> bool | None:
    return v if isinstance(v, bool) else None


def _string(v: Any) -> str | None:
    return v if isinstance(v, str) else None


def _strings(v: Any) -> tuple[str, ...] | None:
    return tuple(v) if isinstance(v, list) and all(isinstance(x, str) for x in v) else None


def _curve(v: Any) -> tuple[tuple[float, float], ...] | None:
    if not isinstance(v, list) or not all(isinstance(p, list) and len(p) == 2 and all(_number(x) is not None for x in p) for p in v):
        return None
    return tuple((float(x), float(y)) for x, y in v)


def _lenient(cls: type, values: Any) -> dict[str, Any]:
    """Those of ``values`` that the field's reader accepts."""
    found = {}
    for f in fields(cls):
        if isinstance(values, dict) and "read" in f.metadata and f.name in values and (v := f.metadata["read"](values[f.name])) is not None:
            found[f.name] = v
    return found


def _setting(default: Any, read: Callable[[Any], Any]) -> Any:
    return field(default=default, metadata={"read": read})


@dataclass(frozen=True)
class PriorityPage:
    url_pattern: str
    keywords: tuple[str, ...]
    boost: float
    custom_excerpt: str | None = None
    page_id: str | None = None

    @classmethod
    def from_dict(cls, v: Any) -> PriorityPage:
        """Strict: a page that lacks a field or has one of a wrong type is an error."""
        if not isinstance(v, dict):
            raise ValueError("expected an object")
        pattern, words, boost = _string(v.get("url_pattern")), _strings(v.get("keywords")), _number(v.get("boost"))
        for name, value in (("url_pattern", pattern), ("keywords", words), ("boost", boost)):
            if value is None:
                raise ValueError(f"missing or invalid field `{name}`")
        for name in ("custom_excerpt", "page_id"):
            if v.get(name) is not None and not isinstance(v[name], str):
                raise ValueError(f"invalid field `{name}`")
        return cls(pattern, words, boost, v.get("custom_excerpt"), v.get("page_id"))


def _pages(v: Any) -> tuple[PriorityPage, ...] | None:
    try:
        return tuple(map(PriorityPage.from_dict, v)) if isinstance(v, list) else None
    except ValueError:
        return None


@dataclass(frozen=True)
class ConfigWarning:
    field: str
    message: str


STRATEGIES = ("exponential", "linear", "step", "none", "custom")
#: Ranges outside of which a value is warned about, or clamped.
RANGES = {"recency_boost_max": (0.0, 2.0), "recency_half_life_days": (1, 3650), "recency_max_penalty": (0.0, 1.0), "results_per_page": (1, 100), "max_pagefind_results": (1, 500)}


@dataclass(frozen=True)
class ScoringConfig:
    recency_boost_max: float = _setting(0.5, _number)
    recency_half_life_days: int = _setting(365, _count)
    recency_penalty_after_days: int = _setting(1825, _count)
    recency_max_penalty: float = _setting(0.3, _number)
    recency_strategy: str = _setting("exponential", _string)
    recency_curve: tuple[tuple[float, float], ...] = _setting((), _curve)
    title_match_boost: float = _setting(1.0, _number)
    title_all_terms_multiplier: float = _setting(1.5, _number)
    content_match_boost: float = _setting(0.4, _number)
    content_all_terms_multiplier: float = _setting(1.2, _number)
    phrase_adjacent_multiplier: float = _setting(2.5, _number)
    phrase_near_multiplier: float = _setting(1.5, _number)
    phrase_near_window: int = _setting(5, _count)
    phrase_window: int = _setting(15, _count)
    excerpt_length: int = _setting(300, _count)
    results_per_page: int = _setting(10, _count)
    max_pagefind_results: int = _setting(50, _count)
    language: str = _setting("en", _string)
    custom_stop_words: tuple[str, ...] = _setting((), _strings)
    priority_pages: tuple[PriorityPage, ...] = _setting((), _pages)

    @classmethod
    def from_dict(cls, values: Any) -> ScoringConfig:
        return cls(**_lenient(cls, values))

    @classmethod
    def from_dict_validated(cls, values: Any) -> tuple[ScoringConfig, list[ConfigWarning]]:
        return cls.from_dict(values).clamped()

    def warnings(self) -> list[ConfigWarning]:
        """What is out of range or will not work, in a fixed order."""
        found = [
            ConfigWarning(name, f"{_shown(getattr(self, name))} is unusual; {_shown(low)} to {_shown(high)} are expected")
            for name, (low, high) in RANGES.items()
            if not low <= getattr(self, name) <= high
        ]
        if self.recency_strategy not in STRATEGIES:
            found.append(ConfigWarning("recency_strategy", f"'{self.recency_strategy}' is none of {', '.join(STRATEGIES)}"))
        if self.recency_strategy == "custom" and not self.recency_curve:
            found.append(ConfigWarning("recency_curve", "a custom strategy without points boosts nothing"))
        days = [x for x, _ in self.recency_curve]
        if any(b <= a for a, b in zip(days, days[1:], strict=False)):
            found.append(ConfigWarning("recency_curve", "the days of the points do not rise"))
        return found

    def clamped(self) -> tuple[ScoringConfig, list[ConfigWarning]]:
        """Values moved into their ranges, with a warning for each, then the warnings that remain."""
        inside = {n: min(max(getattr(self, n), low), high) for n, (low, high) in RANGES.items() if not low <= getattr(self, n) <= high}
        found = [
            ConfigWarning(n, f"{_shown(getattr(self, n))} is not within {_shown(RANGES[n][0])} to {_shown(RANGES[n][1])}; {_shown(v, True)} is used")
            for n, v in inside.items()
        ]
        moved = replace(self, **inside)
        return moved, found + moved.warnings()


def _shown(v: float, value: bool = False) -> str:
    """Whole floats as bounds keep their point, as values they do not."""
    return f"{v:g}" if value and isinstance(v, float) else str(v)


@dataclass(frozen=True)
class ExpansionConfig:
    language: str = _setting("en", _string)
    generic_terms: tuple[str, ...] = _setting((), _strings)
    filter_single_word_generic: bool = _setting(True, _flag)  # accepted, without effect
    keep_acronyms: bool = _setting(True, _flag)
    keep_proper_nouns: bool = _setting(True, _flag)
    min_term_length: int = _setting(2, _count)
    existing_terms: tuple[str, ...] = _setting((), _strings)

    @classmethod
    def from_dict(cls, values: Any) -> ExpansionConfig:
        return cls(**_lenient(cls, values))


@dataclass(frozen=True)
class ContextConfig:
    max_length: int = _setting(6000, _count)
    intro_length: int = _setting(2000, _count)
    snippet_radius: int = _setting(500, _count)
    separator: str = _setting("\n\n[...]\n\n", _string)

    @classmethod
    def from_dict(cls, values: Any) -> ContextConfig:
        return cls(**_lenient(cls, values))


@dataclass(frozen=True)
class ConversationConfig:
    max_length: int = _setting(12000, _count)
    preserve_first_n: int = _setting(2, _count)
    removal_unit: int = _setting(2, _count)

    @classmethod
    def from_dict(cls, values: Any) -> ConversationConfig:
        return cls(**_lenient(cls, values))


def _patterns(v: Any) -> tuple[tuple[str, str], ...] | None:
    if not isinstance(v, list):
        return None
    return tuple((p["regex"], p["replacement"]) for p in v if isinstance(p, dict) and isinstance(p.get("regex"), str) and isinstance(p.get("replacement"), str))


@dataclass(frozen=True)
class SanitizeConfig:
    redact_email: bool = _setting(True, _flag)
    redact_phone: bool = _setting(True, _flag)
    redact_ssn: bool = _setting(True, _flag)
    redact_credit_card: bool = _setting(True, _flag)
    redact_ip: bool = _setting(True, _flag)
    custom_patterns: tuple[tuple[str, str], ...] = _setting((), _patterns)

    @classmethod
    def from_dict(cls, values: Any) -> SanitizeConfig:
        return cls(**_lenient(cls, values))


#: Unicode white space, as Spark's (?U)\\s has it.
WHITE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
