"""Terms out of what a language model answered: a JSON array, fenced or bare, or else separated text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import ExpansionConfig
from .text import SPACES, is_stop_word, is_valid_term, trim


def unfenced(text: Column) -> Column:
    """Inside the first json fence, else inside the first fence, else all of it."""
    body = trim(text)
    fenced = lambda tag: F.when(body.rlike(f"(?s)```{tag}.*?```"), trim(F.regexp_extract(body, f"(?s)```{tag}(.*?)```", 1)))
    return F.coalesce(fenced("json"), fenced(""), text)


def json_array(text: Column) -> Column:
    """ARRAY<VARIANT> if the text is exactly one JSON array, else null. Brackets around it reject what follows a value."""
    wrapped = F.expr("null").cast("array<variant>")
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = F.try_variant_get(parsed, "$", "array<variant>")
    first = F.get(whole, F.lit(0))
    return F.when((F.size(whole) == 1) & F.schema_of_variant(first).startswith("ARRAY"), F.try_variant_get(first, "$", "array<variant>")).otherwise(wrapped)


def listed_strings(array: Column) -> Column:
    strings = F.filter(array, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(strings, lambda x: trim(F.try_variant_get(x, "$", "string")))


def separated(text: Column) -> Column:
    """Split at lines and commas, without white space and quotes around the parts."""
    bare = lambda t: trim(F.regexp_replace(F.regexp_replace(trim(t), r'\A"+|"+\z', ""), r"\A'+|'+\z", ""))
    return F.transform(F.split(text, "[\n,]"), bare)


def is_specific(term: Column, config: ExpansionConfig) -> Column:
    """Neither generic itself nor made of nothing but generic and stop words. Short terms and terms with capitals pass."""
    generic = [g.lower() for g in config.generic_terms]
    words = F.filter(F.split(term, SPACES), lambda w: w != "")
    plain = lambda w: ~is_stop_word(w, config.language or "en") & ~F.lower(w).isin(generic)
    keep = F.when(F.size(words) == 1, ~F.lower(term).isin(generic)).otherwise(F.exists(words, plain))
    if config.keep_proper_nouns:
        keep = term.rlike(r"\p{IsUppercase}") | keep
    if config.keep_acronyms:
        keep = (F.length(term) <= 3) | keep
    return keep


def union_of(first: Column, more: tuple[str, ...]) -> Column:
    """Both lists one after the other, each term once whatever its case, as it came first."""
    every = F.concat(first, F.array(*map(F.lit, more)).cast("array<string>"))
    low = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def parse_expansion(text: Column, config: ExpansionConfig = ExpansionConfig(), accept_terms_object: bool = False) -> Column:  # noqa: B008
    """Terms of an answer. ``accept_terms_object`` also takes the array of an object's ``terms``."""
    language, body = config.language or "en", unfenced(text)
    array = json_array(body)
    if accept_terms_object:
        array = F.coalesce(array, F.try_variant_get(F.try_parse_json(body), "$.terms", "array<variant>"))
    terms = F.when(array.isNotNull(), listed_strings(array)).otherwise(separated(body))
    terms = F.filter(terms, lambda t: is_valid_term(t, language) & (F.length(t) >= config.min_term_length))
    if config.generic_terms:
        terms = F.filter(terms, lambda t: is_specific(t, config))
    return union_of(terms, config.existing_terms) if config.existing_terms else terms
