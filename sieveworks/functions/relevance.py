"""Match, phrase and priority scores as Columns.

Terms are a list when the query is known on the driver (the tests unroll and stay in generated code), else an array
column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import PriorityPage, ScoringConfig
from .dates import recency_of_days

Terms = list[str] | Column


def count_of(terms: Terms) -> Column:
    return F.lit(len(terms)) if isinstance(terms, list) else F.size(terms)


def matching(terms: Terms, text: Column) -> Column:
    """How many of the terms occur in the text, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if isinstance(terms, list):
        return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def match_score(terms: Terms, text: Column, boost: float, all_terms: float) -> Column:
    """The boost, more if all of several terms match, times the share that does."""
    n, m = count_of(terms), matching(terms, text)
    return F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(F.when((m == n) & (n > 1), F.lit(boost * all_terms)).otherwise(F.lit(boost)) * (m / F.greatest(n, F.lit(1))))


def title_match(terms: Terms, title: Column, config: ScoringConfig) -> Column:
    return match_score(terms, title, config.title_match_boost, config.title_all_terms_multiplier)


def content_match(terms: Terms, content: Column, config: ScoringConfig) -> Column:
    return match_score(terms, content, config.content_match_boost, config.content_all_terms_multiplier)


def phrase_multiplier(terms: Terms, locations: Column, config: ScoringConfig) -> Column:
    """By the tightest window with as many positions as there are terms; 1 for single terms or too few positions."""
    n, at = count_of(terms), F.array_sort(locations)
    starts = F.sequence(F.lit(0), F.greatest(F.size(at) - n, F.lit(0)))
    span = F.array_min(F.transform(starts, lambda i: F.get(at, i + n - 1) - F.get(at, i)))
    enough = (n >= 2) & (F.size(locations) >= n)
    return (
        F.when(~F.coalesce(enough, F.lit(False)), F.lit(1.0)).when(span < n, F.lit(config.phrase_adjacent_multiplier))
        .when(span <= config.phrase_near_window, F.lit(config.phrase_near_multiplier)).otherwise(F.lit(1.0))
    )


def matched_pages(query: str, pages: tuple[PriorityPage, ...]) -> list[PriorityPage]:
    """Pages of which any keyword is part of the query, in any case."""
    low = query.lower()
    return [p for p in pages if any(k.lower() in low for k in p.keywords)]


def page_applies(page: PriorityPage, url: Column, query: Column | None = None) -> Column:
    """The pattern is part of the URL, case kept; with a query column its keywords are tested too."""
    here = F.contains(url, F.lit(page.url_pattern))
    if query is None:
        return here
    low = F.lower(query)
    any_of = F.lit(False)
    for k in page.keywords:
        any_of = any_of | F.contains(low, F.lit(k.lower()))
    return here & any_of


def priority_boost(pages, url: Column, query: Column | None = None) -> Column:
    """Sum of the boosts of all pages that apply."""
    return sum((F.when(page_applies(p, url, query), F.lit(float(p.boost))).otherwise(F.lit(0.0)) for p in pages), F.lit(0.0))


def priority_excerpt(pages, url: Column, excerpt: Column, query: Column | None = None) -> Column:
    """The excerpt of the first page that applies and has one, else the row's own."""
    chosen = [F.when(page_applies(p, url, query), F.lit(p.custom_excerpt)) for p in pages if p.custom_excerpt is not None]
    return F.coalesce(*chosen, excerpt)


def pages_of_row(pages: Column, url: Column, query: Column) -> Column:
    """Of an array of pages, those whose pattern is part of the URL and of which a keyword is part of the query."""
    low = F.lower(query)
    return F.filter(pages, lambda p: F.contains(url, p["url_pattern"]) & F.exists(p["keywords"], lambda k: F.contains(low, F.lower(k))))


def composite(
    terms: Terms, config: ScoringConfig, priority: Column, days: Column, primary: Terms | None = None, phrase: bool = True,
    title: str = "title", excerpt: str = "excerpt", score: str = "score", weight: str = "source_weight", locations: str = "locations",
) -> Column:
    """Weighted base score plus title, content, recency and priority boosts. A missing or non-positive base counts as 1.

    ``days`` is the row's age as a column of its own: the expression has it several times, and Spark computes it once so.
    """
    base = F.when(F.col(score) > 0, F.col(score)).otherwise(F.lit(1.0)) * F.coalesce(F.col(weight), F.lit(1.0))
    titled = title_match(terms, F.col(title), config)
    if primary is not None:
        titled = F.greatest(titled, title_match(primary, F.col(title), config))
    content = content_match(terms, F.col(excerpt), config)
    if phrase and not (isinstance(terms, list) and len(terms) < 2):
        content = content * F.when(F.col(locations).isNull(), F.lit(1.0)).otherwise(phrase_multiplier(terms, F.col(locations), config))
    return base + titled + content + recency_of_days(days, config) + priority
