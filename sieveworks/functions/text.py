"""Terms, stop words and phrase intent as Columns. A query known on the driver gives a list of terms instead."""

from __future__ import annotations

import json
import re
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, functions as F

from ..config import WHITE

#: Unicode white space.
SPACES = r"(?U)\s+"


@cache
def stop_word_lists() -> dict[str, tuple[str, ...]]:
    """Stop words by ISO 639-1 code; Chinese, Japanese, Korean and unknown codes have none."""
    found, lang = {}, ""
    for line in files(__package__).joinpath("stop_words.txt").read_text("utf-8").splitlines():
        if line.startswith("["):
            lang = line[1:-1]
        elif line and not line.startswith("#"):
            found[lang] = tuple(line.split(", "))
    return found


def stop_words(language: str) -> tuple[str, ...]:
    return stop_word_lists().get(language, ())


def stop_words_of(language: Column) -> Column:
    """The list of a language that differs by row."""
    table = F.from_json(F.lit(json.dumps(stop_word_lists(), ensure_ascii=False)), "map<string,array<string>>")
    return F.coalesce(F.try_element_at(table, language), F.array().cast("array<string>"))


Custom = tuple[str, ...] | Column


def is_stop_word(term: Column, language: str | Column = "en", custom: Custom = ()) -> Column:
    """``custom`` words are known, or an array column."""
    low = F.lower(term)
    if isinstance(custom, Column):
        return is_stop_word(term, language) | F.exists(custom, lambda c: F.lower(c) == low)
    own = [c.lower() for c in custom]
    if isinstance(language, str):
        words = sorted({*stop_words(language), *own})
        return low.isin(words) if words else F.lit(False)
    listed = F.array_contains(stop_words_of(language), low)
    return listed | low.isin(own) if own else listed


def is_valid_term(term: Column, language: str | Column = "en", custom: Custom = ()) -> Column:
    """At least two bytes, not only digits, not a stop word; a phrase is compared whole."""
    return (F.octet_length(term) >= 2) & ~term.rlike(r"\A[0-9]+\z") & ~is_stop_word(term, language, custom)


def extract_terms(query: Column, language: str | Column = "en", custom: Custom = ()) -> Column:
    """Lower-case words without stop words and single bytes, in order, with repeats and punctuation; null gives none."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), SPACES)
    return F.filter(words, lambda t: (F.octet_length(t) > 1) & ~is_stop_word(t, language, custom))


def extract_query(query: Column, language: str | Column = "en", custom: Custom = ()) -> Column:
    """STRUCT<terms, is_phrase, forced_phrase>; quotes around the whole query force a phrase and are taken off."""
    trimmed = trim(query)
    forced = F.startswith(trimmed, F.lit('"')) & F.endswith(trimmed, F.lit('"')) & (F.octet_length(trimmed) > 2)
    inner = F.when(forced, F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)
    terms = extract_terms(inner, language, custom)
    return F.struct(terms.alias("terms"), (F.size(terms) >= 2).alias("is_phrase"), F.coalesce(forced, F.lit(False)).alias("forced_phrase"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words_of(query: str, language: str = "en", custom: tuple[str, ...] = ()) -> list[str]:
    """Terms of a text known on the driver, as ``extract_terms`` gives them."""
    stops = {*stop_words(language), *(c.lower() for c in custom)}
    return [t for t in WHITE.split(query.lower()) if len(t.encode()) > 1 and t not in stops]


def query_terms(query: str, language: str = "en", custom: tuple[str, ...] = ()) -> list[str]:
    """Terms of a query known on the driver, as ``extract_query`` gives them."""
    inner = re.sub(f"^{WHITE.pattern}|{WHITE.pattern}$", "", query)
    if inner.startswith('"') and inner.endswith('"') and len(inner.encode()) > 2:
        inner = inner[1:-1]
    return words_of(inner, language, custom)
