"""Repeated passages by suffix order, over bytes.

A string of ``length`` bytes is repeated if it also starts elsewhere, in the same document or another. Sorting all
suffixes of a corpus in one place is out of the question, so they are dealt by content first: each window of ``length``
bytes has an anchor, the least hash among its ``GRAM``-byte substrings. Equal windows have equal anchors at equal
places, so the suffixes that can agree on ``length`` bytes meet in one group. Neighbouring windows of a document mostly
share an anchor and travel as one slice.

* Copies of a slice are known by counting their hashes, no bytes move: at each window of a later copy the longest
  previous factor reaches ``length``, as the earlier copy holds it.
* The different slices of an anchor are laid end to end in corpus order and their suffixes sorted by prefix doubling up
  to ``length``. Previous and next smaller positions in suffix order give the longest previous factor of each window,
  up to ``length``, and where that earlier match is. A window whose factor reaches ``length`` is a later copy; it and
  its earlier match are repeated.
* An anchor with more than ``CROWD`` different slices, as at the edges of a passage that very many documents share, is
  taken apart by the bytes that its windows share around the anchor, in ``STEPS``; most of the parts are then alone or
  equal, and what is left is sorted as above.

Joins by anchor have no aggregation in their stage, so that adaptive execution can split the partition of a hot one.

``removed`` takes out every copy (``keep_first=False``) or all but the first in ascending (doc_id, hash, offset).

Defined results: null counts as empty. Texts shorter than ``length`` stay whole. Rows that repeat doc_id and text are
occurrences of their own: with ``length`` bytes or more nothing of them stays, or, if the first is kept, all of them
keep what the first keeps. A null doc_id sorts first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import emptied, table, text_of, written
from .shingles import mixed

LENGTH, GRAM, CROWD = 400, 128, 512
#: Windows in a part of a crowded anchor's slices, level by level.
STEPS = (64, 16, 1)
#: Bytes of slices that a task ranks at once, but for one group; and of a text hashed at once.
BATCH_BYTES, CHUNK = 1 << 20, 1 << 22
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in np.random.default_rng(12).integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)]
_LOW = np.uint64(2**24 - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes, a power of two."""
    h, width, level = _BYTE[data], 1, 0
    while width < gram:
        h = h[:-width] * _STEP[level] + h[width:]
        width, level = 2 * width, level + 1
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(key, first, last): runs of window starts that share an anchor."""
    for begin in range(0, max(len(data) - length + 1, 0), CHUNK):
        h = gram_hashes(data[begin : begin + CHUNK + length - 1], gram)
        place = np.arange(len(h), dtype=np.uint64)
        at = sliding_min((h & ~_LOW) | place, length - gram + 1) & _LOW
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        keys = h[at[cut]].view(np.int64)
        yield from zip(keys.tolist(), (cut + begin).tolist(), (np.append(cut[1:], len(at)) - 1 + begin).tolist(), strict=True)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Window starts in suffix order (equal windows by position), the ranks of all substrings by width, and the eight
    bytes at each place as a number."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)]).astype(np.uint64)
    eight = np.zeros(n + length, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + n + length]
    width, rank = 8, ranks(eight)
    levels = [(width, rank)]
    while 2 * width <= length:
        rank = ranks((rank[:-width].astype(np.uint64) << np.uint64(32)) | rank[width:])
        width *= 2
        levels.append((width, rank))
    own = (rank[starts].astype(np.uint64) << np.uint64(32)) | rank[starts + length - width]
    return np.argsort(own, kind="stable"), levels, eight


def ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    number = np.empty(len(keys), np.uint32)
    number[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return number


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place of a permutation the nearest place before it with a smaller value, -1 if there is none."""
    found = np.arange(-1, len(x) - 1)
    todo = np.flatnonzero(x[found] > x)
    todo = todo[todo > 0]
    while len(todo):  # what lies between a place and its candidate is larger, so the candidate's own may be taken over
        found[todo] = found[found[todo]]
        todo = todo[found[todo] >= 0]
        todo = todo[x[found[todo]] > x[todo]]
    return found


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], eight: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``length``."""
    size = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        size += width * (rank[a + size] == rank[b + size])
    rest = eight[a + size] ^ eight[b + size]
    size += sum((rest >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
    return np.minimum(size, length)


def longest_previous(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the longest previous factor among the windows before it, up to ``length``, and the number of the
    window where that match is (-1 without one)."""
    order, levels, eight = suffix_order(data, starts, length)
    factor, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    before, after = previous_smaller(order), len(order) - 1 - previous_smaller(order[::-1])[::-1]
    for near in (before, after):
        known = np.flatnonzero((near >= 0) & (near < len(order)))
        here, there = order[known], order[near[known]]
        size = common_prefix(starts[here], starts[there], levels, eight, length)
        better = size > factor[here]
        factor[here[better]], source[here[better]] = size[better], there[better]
    return factor, source


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype("i1"), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def rank_slices(slices: list[bytes], length: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each slice the runs of windows that are repeated, and of those with an earlier match (slices in order)."""
    sizes = np.array([len(s) for s in slices])
    data = np.frombuffer(b"".join(slices), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(slices)), windows)
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    factor, source = longest_previous(data, starts, length)
    later = factor >= length
    repeated = later.copy()
    repeated[source[later]] = True
    ends = np.cumsum(windows)
    return [(runs(repeated[e - w : e]), runs(later[e - w : e])) for e, w in zip(ends, windows, strict=True)]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for doc_id, h, text in batch.iloc[at : at + 256].itertuples(index=False):
                    raw = text.encode()
                    for key, first, last in anchors(np.frombuffer(raw, np.uint8), length):
                        out.append((doc_id, h, key, xxhash.xxh3_64_intdigest(raw[first : last + length]) - 2**63, first, last))
                yield pd.DataFrame(out, columns=["doc_id", "h", "key", "slice", "first", "last"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "h", "text").mapInPandas(rows, "doc_id bigint, h bigint, key bigint, slice bigint, first int, last int")


def ranked_groups(length: int):
    """Task over rows sorted by key: ranks the slices of several anchors at once."""

    def done(rows: list[tuple]) -> pd.DataFrame:
        found = rank_slices([bytes(r[2]) for r in rows], length)
        flat = lambda spans: [x for s in spans for x in s]
        return pd.DataFrame({"key": [r[0] for r in rows], "slice": [r[1] for r in rows], "any": [flat(a) for a, _ in found], "later": [flat(b) for _, b in found]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_bytes = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held_bytes > BATCH_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row[2])
        if held:
            yield done(held)

    return rows


def parts_of(data: bytes, length: int, gram: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(key, first, last): the windows of a slice in runs that have the anchor at like places, ``step`` of them at most.

    All windows of a run have the bytes around the anchor in common that the run's first and last window share; the key
    is their hash. Equal windows have the anchor at the same place, so they get equal keys.
    """
    grams = gram_hashes(np.frombuffer(data, np.uint8), gram) & ~_LOW
    anchor, windows = int(np.argmin(grams)), len(data) - length + 1
    for run in range((anchor - windows + 1) // step, anchor // step + 1):
        near = anchor - run * step
        far = near - step + 1
        first, last = max(far, 0), min(near, windows - 1)
        if first <= last:
            yield xxhash.xxh3_64_intdigest(data[near : far + length], run % 2**32) - 2**63, first, last


def refined(slices: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """The slices of crowded anchors in parts: (over, of, key, slice, doc_id, h, first, last, begin)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for over, of, data, doc_id, h, begin in batch[["key", "slice", "data", "doc_id", "h", "first"]].itertuples(index=False):
                raw = bytes(data)
                for key, first, last in parts_of(raw, length, gram, step):
                    name = xxhash.xxh3_64_intdigest(raw[first : last + length]) - 2**63
                    out.append((over, of, key, name, doc_id, h, begin + first, begin + last, begin))
            yield pd.DataFrame(out, columns=PARTS.replace(" bigint", "").replace(" int", "").split(", ")).astype({"doc_id": "Int64"})

    return slices.mapInPandas(rows, PARTS)


PARTS = "over bigint, of bigint, key bigint, slice bigint, doc_id bigint, h bigint, first int, last int, begin int"


def settled(seen: DataFrame, texts: DataFrame, length: int, gram: int = GRAM, level: int = 0) -> DataFrame:
    """(key, slice, uses, own, any, later) of the slices of ``seen``: how often each occurs (the sum of ``copies``), where first, and
    which of its windows are repeated, or have an earlier match, in other slices of the key.

    A key with too many different slices to be sorted in one task is taken apart by what its windows share around the
    anchor, step by step; with a step of one, windows with equal keys are equal, so this ends.
    """
    place = F.struct("doc_id", "h", "first", "last")
    kinds = written(seen.groupBy("key", "slice").agg(F.sum("copies").alias("uses"), F.min(place).alias("own")), "slices")
    several = written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "several")
    cut = kinds.join(several, "key").select("key", "slice", "kinds", "own.*")
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + length)
    # A row that repeats doc_id and text would give each slice twice.
    once = texts.dropDuplicates(["doc_id", "h"])
    slices = cut.alias("s").join(once.alias("d"), same("d", "s"))
    slices = written(slices.select("key", "slice", bytes_of.alias("data"), "kinds", "s.doc_id", "s.h", "first"), "slice-bytes")
    few, crowd = slices.filter(F.col("kinds") <= CROWD), slices.filter(F.col("kinds") > CROWD)
    few = few.repartition("key").sortWithinPartitions("key", "doc_id", "h", "first")
    ranked = few.select("key", "slice", "data").mapInPandas(ranked_groups(length), "key bigint, slice bigint, any array<int>, later array<int>")
    if level < len(STEPS) and not crowd.isEmpty():
        parts = written(refined(crowd, length, gram, STEPS[level]), "parts")
        inner = settled(parts.select("key", "slice", "doc_id", "h", "first", "last", F.lit(1).alias("copies")), texts, length, gram, level + 1)
        back = lambda c: F.transform(F.col(c), lambda x: x - F.col("begin")).alias(c)
        found = with_spans(parts, inner).select(F.col("over").alias("key"), F.col("of").alias("slice"), back("any"), back("later"))
        ranked = ranked.unionByName(found.groupBy("key", "slice").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("any", "later")]))
    return written(kinds.join(ranked, ["key", "slice"], "left"), "ranked")


def with_spans(seen: DataFrame, named: DataFrame) -> DataFrame:
    """``seen`` with ``any`` and ``later``: first and last window start in the document of the stretches that are repeated,
    and of those with an earlier match."""
    whole, first_one = F.array(F.col("first"), F.col("last")), F.struct("doc_id", "h", "first", "last") == F.col("own")
    moved = lambda c: F.coalesce(F.transform(F.col(c), lambda x: x + F.col("first")), F.array().cast("array<int>"))
    every = F.when(F.col("uses") > 1, whole).otherwise(moved("any"))
    late = F.when(~first_one, whole).otherwise(moved("later"))
    return seen.join(named, ["key", "slice"]).withColumns({"any": every, "later": late}).drop("uses", "own")


def spans(docs: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """The texts with repeated anchors, and (doc_id, h, taken): first and last window start of stretches to take out."""
    seen = written(anchor_rows(docs, length), "anchors")
    met = written(seen.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").select("key"), "keys")
    every, seen = seen, written(seen.join(met, "key"), "shared")
    # Rows that repeat doc_id and text have the same slices at the same places: one of each stands for all, with their number.
    seen = written(seen.groupBy("key", "slice", "doc_id", "h", "first", "last").agg(F.count(F.lit(1)).alias("copies")), "met")
    emptied(every)
    texts = written(docs.alias("d").join(seen.select("doc_id", "h").distinct().alias("s"), same("d", "s"), "left_semi"), "texts")
    named = settled(seen, texts, length)
    each = with_spans(seen, named).select("doc_id", "h", F.col("later" if keep_first else "any").alias("taken")).filter("size(taken) > 0")
    return texts, each.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("taken")).alias("taken"))


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def without(raw: bytes, taken, length: int) -> tuple[bytes, int]:
    """What is left, and the number of runs removed."""
    left, at, stop, n = [], 0, -1, 0
    for first, last in sorted(zip(taken[::2], taken[1::2], strict=True)):
        if first > stop:
            left.append(raw[at:first])
            n += 1
        stop = max(stop, last + length)
        at = stop
    return b"".join([*left, raw[at:]]), n


def removed(df: DataFrame, length: int = LENGTH, keep_first: bool = True, with_bytes: bool = False) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans and kept_sha256; ``with_bytes`` adds what is kept."""
    docs = df.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    texts, taken = spans(docs, length, keep_first)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes
    taken = written(taken, "taken")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans_ in batch.itertuples(index=False):
                raw = text.encode()
                kept, n = without(raw, spans_, length)
                out.append((doc_id, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    changed = texts.alias("d").join(taken.alias("s"), same("d", "s")).select("d.doc_id", "text", "taken").mapInPandas(rows, schema)
    raw = F.col("text").cast("binary")
    none = lambda name: F.lit(0).cast("bigint").alias(name)
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    rest = docs.select("doc_id", "h", size, none("n_removed"), none("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *[raw.alias("kept")] * with_bytes)
    rest = rest.alias("d").join(taken.select("doc_id", "h").alias("s"), same("d", "s"), "left_anti").drop("h")
    return changed.unionByName(rest)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: what is left of it without the windows of LENGTH bytes that start anywhere else too, and whether it had any."""
    return removed(table(spark, sf_dir, "documents"), keep_first=False).withColumn("has_repeats", F.col("n_removed") > 0)
