"""Passages around the words of a query.

Offsets count bytes of UTF-8. Snippets begin after a space and end at one, so they are cut from the bytes of the text as
slices of whole words. All of it takes time in proportion to the text and its hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..config import ContextConfig
from .text import words_of

#: Up to the last end of a sentence that a space or the end of the window follows.
SENTENCE = r"(?s)\A(.*[.!?])(?= |\z)"
LOOK_BACK = 200
#: Entries of an array that are carried along at a time.
BLOCK = 128


def truncate_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters: to the last sentence end within 200 of them, else to the last space, else all."""
    skipped = max(most - LOOK_BACK, 0)
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(F.substring(text, skipped + 1, most - skipped), SENTENCE, 1)
    spaced = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)\A(.*) ", 1)).otherwise(head)
    cut = F.when(sentence != "", F.concat(F.substring(text, 1, skipped), sentence)).otherwise(spaced)
    return F.when(F.length(text) <= most, text).otherwise(cut)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], kind: str) -> Column:
    """``add`` of all values up to each; it must be associative. An array that grows by one entry is copied each time, so values
    are carried along in blocks, and blocks among each other: time in proportion to the array."""

    def carried(part: Column) -> Column:
        begin = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            return bound(F.coalesce(add(acc["last"], x), x), lambda v: F.struct(v.alias("last"), F.concat(acc["all"], F.array(v)).alias("all")))

        return F.aggregate(part, begin, step)["all"]

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda k: carried(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))

    def joined(own: Column) -> Column:
        totals = carried(F.transform(own, lambda b: F.element_at(b, -1)))
        return bound(totals, lambda t: F.flatten(F.transform(own, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: add(F.get(t, k - 1), x))))))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(blocks(v), joined)).otherwise(F.array().cast(f"array<{kind}>")))


def hits(low: Column, term: str) -> Column:
    """Ends, in bytes, of all occurrences of a term, left to right without overlap."""
    parts = F.split(low, re.sub(r"([^\w\s])", r"\\\1", term), -1)
    sizes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.octet_length(p) + len(term.encode()))
    return running(sizes, lambda a, b: a + b, "int")


def letters(view: Column) -> Column:
    """Bytes as text of one character each."""
    return F.decode(view, "ISO-8859-1")


def widened_begins(view: Column, at: Column) -> Column:
    """For sorted offsets, those behind the last space before each, else 0. Each byte between two offsets is read once."""

    def own(x: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1))
        found = F.instr(F.reverse(letters(F.substring(view, before + 1, x - before))), " ")
        return F.when(found > 0, x - found + 1).otherwise(F.lit(0))

    return running(F.transform(at, own), F.greatest, "int")


def widened_ends(view: Column, size: Column, at: Column) -> Column:
    """For sorted offsets, those of the first space at or after each, else the end."""

    def own(x: Column, k: Column) -> Column:
        after = F.coalesce(F.get(at, k + 1), size)
        found = F.instr(letters(F.substring(view, x + 1, after - x)), " ")
        return F.when(found > 0, x + found - 1).otherwise(size)

    return F.reverse(running(F.reverse(F.transform(at, own)), F.least, "int"))


def islands(begins: Column, ends: Column) -> Column:
    """What intervals cover, by their begins and their ends, each sorted: a gap is where as many have ended as have begun."""
    n = F.size(ends)
    gaps = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: (k == n - 1) | (F.get(begins, k + 1) > F.get(ends, k)))
    cut = bound(gaps, lambda g: F.transform(g, lambda k, i: F.struct(F.get(begins, F.when(i == 0, F.lit(0)).otherwise(F.get(g, i - 1) + 1)).alias("s"), F.get(ends, k).alias("e"))))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def extract_context(content: Column, query: str, config: ContextConfig = ContextConfig()) -> Column:  # noqa: B008
    """The text itself if it is short enough; else its beginning and the passages around the query's words."""
    most, radius, sep = config.max_length, config.snippet_radius, config.separator
    terms = words_of(query)
    if not terms:
        return truncate_at_sentence(content, most)
    intro = F.substring(content, 1, config.intro_length)
    rest = F.substring(content, config.intro_length + 1, 2**31 - 1)

    def passages(b: Column) -> Column:
        view, size = b["view"], b["size"]
        found = [(hits(b["low"], t), len(t.encode()) + radius) for t in terms]
        begins = F.flatten(F.array(*[F.transform(h, lambda to: F.least(F.greatest(to - back, F.lit(0)), size)) for h, back in found]))  # noqa: B023
        ends = F.flatten(F.array(*[F.transform(h, lambda to: F.least(to + radius, size)) for h, _ in found]))
        wide = F.struct(bound(F.array_sort(begins), lambda at: widened_begins(view, at)).alias("s"), bound(F.array_sort(ends), lambda at: widened_ends(view, size, at)).alias("e"))
        spans = bound(wide, lambda w: islands(w["s"], w["e"]))
        return F.transform(spans, lambda p: F.concat(F.lit(sep), F.decode(F.substring(view, p["s"] + 1, p["e"] - p["s"]), "UTF-8")))

    def joined(pieces: Column) -> Column:
        whole = F.when(F.size(pieces) == 0, F.concat(intro, F.lit(sep), rest)).otherwise(F.concat(intro, F.array_join(pieces, "")))
        return bound(whole, lambda w: truncate_at_sentence(w, most))

    views = F.struct(F.encode(rest, "UTF-8").alias("view"), F.octet_length(rest).alias("size"), F.lower(rest).alias("low"))
    return F.when(F.length(content) <= most, content).otherwise(bound(bound(views, passages), joined))
