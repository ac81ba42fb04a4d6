"""Secret scans: fixed patterns, and sliding-window entropy for what they miss.

The base patterns find assignments to secret-like names, access keys and long hex strings. Candidate strings (long
runs of key characters) are then read with a sliding window for each character class: the window's character counts
change by one in and one out, so its Shannon entropy is kept up to date in constant time. The window shrinks to the
run of a class where that is shorter. A run with a window above the threshold is a span of kind ``entropy`` as a whole,
unless an allow-list pattern matches the candidate or a base span already covers the run.

Lower-case and upper-case alphanumerics and mixed letters are classes of their own: their threshold, as that of shrunk
windows, is three standard deviations below the mean entropy of random strings of the class's alphabet and the window's
length. As words with a number in them reach it too, such runs must change between cases, digits and other signs a few
times; runs of letters alone, which names put together from words resemble, at a share ``LETTER_CHANGES`` of their
places. Letters of one case alone are taken for words, whatever their entropy: long words reach that of random letters.

Defined results: null counts as empty; offsets are code points, ends exclusive; a text without spans has an empty
``spans`` and the digest of the empty string; repeated rows and repeated ids each get their row; any other column is
left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, text_of

KINDS = ("assign", "access", "hex", "entropy")
# Fixed values of the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs; shorter ones fail
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character class: its runs, letters in its alphabet, window, least entropy in bits (None: that of random strings), and
#: least changes of kind where the entropy is that of random strings.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 16, 20, 3.0, 0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 64, 24, 4.0, 0),
    ("lower", re.compile(r"(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])"), 36, 24, None, 3), ("upper", re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{20,}(?![A-Za-z0-9])"), 36, 24, None, 3),
)
#: Candidates that are not secrets: words, plain numbers, UUIDs, paths and dashed or underscored words.
ALLOWED = (
    re.compile(r"[a-z]+"), re.compile(r"[A-Z]+"), re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]*([/_=+-]+([A-Za-z]+|[0-9]{1,8}))+[/_=+-]*"),
)
LETTERS, LETTER_CHANGES = re.compile(r"[A-Za-z]{20,}"), 0.36
#: Least share of changes of kind within the parts of a base64 run, between signs.
SIGNS, PART_CHANGES = re.compile(r"[+/_=-]+"), 0.30


@lru_cache(maxsize=None)
def random_least(letters: int, width: int) -> float:
    """Three standard deviations below the mean entropy of ``width`` characters drawn evenly from ``letters``."""
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]

    def share(c: int, n: int, k: int) -> float:
        """How likely one of ``k`` letters comes up ``c`` times in ``n``."""
        return math.comb(n, c) * (1 / k) ** c * (1 - 1 / k) ** (n - c)

    one = [share(c, width, letters) for c in range(width + 1)]
    mean = letters * sum(p * w for p, w in zip(one, weigh))
    squares = letters * sum(p * w * w for p, w in zip(one, weigh))
    pairs = letters * (letters - 1) * sum(one[c] * weigh[c] * sum(share(d, width - c, letters - 1) * weigh[d] for d in range(width - c + 1)) for c in range(width + 1))
    return math.log2(width) - (mean + 3 * math.sqrt(squares + pairs - mean * mean)) / width


def changes(text: str) -> int:
    """How often the kind of character (lower, upper, digit, other) changes."""
    kinds = [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 for c in text]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def is_names(run: str) -> bool:
    """Whether the parts of a run between signs are words, names and numbers rather than random."""
    parts = [p for p in SIGNS.split(run) if p]
    return sum(map(changes, parts)) < PART_CHANGES * sum(map(len, parts))


def window_entropies(text: str, width: int) -> Iterator[float]:
    """Entropy in bits of each window of ``width`` characters, kept up to date by one in and one out."""
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]  # one comes in before one goes out
    counts: dict[str, int] = {}
    total, most = 0.0, math.log2(width)
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        total += weigh[n + 1] - weigh[n]
        counts[char] = n + 1
        if i >= width:
            old = text[i - width]
            n = counts[old]
            total += weigh[n - 1] - weigh[n]
            counts[old] = n - 1
        if i >= width - 1:
            yield most - total / width


def is_hot(text: str, letters: int, window: int, fixed: float | None, least_changes: float) -> bool:
    """Whether any window of the run reaches the threshold of its class."""
    width = min(window, len(text))
    own = fixed is None or width < window
    if own and changes(text) < least_changes:
        return False
    least = random_least(letters, width) if own else fixed
    return any(bits >= least - 1e-9 for bits in window_entropies(text, width))


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for candidate in CANDIDATE.finditer(text):
        whole = candidate.group()
        if any(a.fullmatch(whole) for a in ALLOWED):
            continue
        begin = candidate.start()
        if LETTERS.fullmatch(whole):
            if is_hot(whole, 52, 24, None, LETTER_CHANGES * len(whole)):
                found.append((begin, begin + len(whole)))
            continue
        for name, runs, letters, window, fixed, least_changes in CLASSES:
            for run in runs.finditer(whole):
                part = run.group()
                mixed = any(c.isdigit() for c in part) and any(c.isalpha() for c in part)
                if mixed and not (name == "base64" and is_names(part)) and is_hot(part, letters, window, fixed, least_changes):
                    found.append((begin + run.start(), begin + run.end()))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base, extra, at, covered = base_spans(text), [], 0, 0
    for a, b in entropy_spans(text):  # both by start, so one pass tells which are within a base span
        while at < len(base) and base[at][0] <= a:
            covered = max(covered, base[at][2])
            at += 1
        if b > covered:
            extra.append((a, 3, b))
    return base, sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str) -> tuple[str, int]:
    """The text with each stretch of overlapping spans replaced by [SECRET], and the number of stretches."""
    out, at, n = [], 0, 0
    for start, _, end in spans_of(text)[1]:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
            n += 1
        at = max(at, end)
    return "".join([*out, text[at:]]), n


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every row, as counts, digest and string."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["text"]:
                base, every = spans_of(content)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]).assign(doc_id=batch["doc_id"].array)

    return df.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInPandas(
        rows, f"doc_id {dict(df.dtypes)[key]}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets in ``text`` replaced; rows and columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t)[0])

    return df.withColumn(text, clean(F.col(text)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return scan(table(spark, sf_dir, "documents"))
