"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items fall into partitions by the size of their shingle set, within a factor of two, and so do documents. For
documents of up to u shingles and items of s or more a signature has a fixed number of bins in proportion to u, each with
the smallest hash that falls into it; the fewer, the larger s is. However long a document is, a short item that it
contains shares bins with it, and the bins are chosen so that an item at the threshold is met with the wanted recall:
a few long items do not need the many bins that one short item does. Items met are verified by exact containment of
their shingles in the document's.

Signatures and shingles of the items are sent to all executors in blocks of at most ``BLOCK_SHINGLES``, so what is
broadcast has a fixed bound; a larger set of items is searched in several blocks. Documents are not shuffled.

Items of one to four words are one shingle of their own width, and a document that has these words in a row contains them.
``decontaminated`` leaves them out: so few words do not make a document a copy.

Defined results: null and empty texts contain nothing, and items without a word are in nothing. Equal items all match; repeated documents each get their rows. Null ids
are returned as they are. Other columns are ignored, or kept by ``decontaminated``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, text_of
from .shingles import WIDTH, Shingler

THRESHOLD, RECALL = 0.8, 0.9999
#: Shingles of items in one block.
BLOCK_SHINGLES = 1_000_000
MOST_BITS = 40


def bin_bits(size_bits: int, least_common: int, recall: float = RECALL) -> int:
    """Bits of the bin number for sets of up to 2**size_bits, so that of ``least_common`` shared shingles at least one is
    the smallest of its bin with probability ``recall``."""
    miss = (1 - recall) ** (1 / least_common)
    for extra in range(-6, MOST_BITS - size_bits):
        load = 2.0**-extra
        if (1 - np.exp(-load)) / load >= 1 - miss:
            return max(0, size_bits + extra)
    return MOST_BITS


def signature(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The smallest hash of each bin that has one; a bin is the top ``bits`` of a hash, and ``shingles`` are sorted."""
    bins = shingles >> np.uint64(64 - bits) if bits else np.zeros(len(shingles), np.uint64)
    return shingles[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(shingles) else shingles


@dataclass
class Items:
    """A block of test items: shingles of each, and where each hash occurs."""

    ids: list
    sizes: np.ndarray
    hashes: np.ndarray  # sorted, with repeats
    owners: np.ndarray
    least_common: int

    @classmethod
    def of(cls, rows: list[tuple], threshold: float) -> Items:
        sizes = np.array([len(s) for _, s in rows])
        hashes, owners = np.concatenate([s for _, s in rows]), np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(hashes, kind="stable")
        return cls([i for i, _ in rows], sizes, hashes[order], owners[order], int(np.ceil(threshold * sizes.min() - 1e-9)))

    def signed(self, bits: int) -> np.ndarray:
        """Hashes in the signature of any item, sorted."""
        order = np.lexsort((self.hashes, self.owners))
        hashes, owners = self.hashes[order], self.owners[order]
        bins = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
        first = np.concatenate([[True], (bins[1:] != bins[:-1]) | (owners[1:] != owners[:-1])])
        return np.unique(hashes[first])


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


class Searcher:
    """Finds the items of one partition in documents."""

    def __init__(self, items: Items, threshold: float, recall: float):
        self.items, self.threshold, self.recall, self.partitions = items, threshold, recall, {}
        self.every = np.unique(items.hashes)

    def partition(self, size_bits: int) -> tuple[int, np.ndarray]:
        if size_bits not in self.partitions:
            bits = bin_bits(size_bits, self.items.least_common, self.recall)
            self.partitions[size_bits] = bits, self.items.signed(bits)
        return self.partitions[size_bits]

    def find(self, shingles: np.ndarray) -> list[tuple[int, float]]:
        """(item, containment) of the items in a document's shingles."""
        bits, signed = self.partition(int(len(shingles) - 1).bit_length())
        met = signature(shingles, bits)
        met = met[is_in(met, signed)]
        if not len(met):
            return []
        items = self.items
        owners_of = lambda h: np.concatenate([items.owners[a:b] for a, b in zip(np.searchsorted(items.hashes, h), np.searchsorted(items.hashes, h, "right"), strict=True)])
        candidates = set(owners_of(met).tolist())
        common = Counter(owners_of(shingles[is_in(shingles, self.every)]).tolist())
        least = self.threshold * items.sizes - 1e-9
        return [(items.ids[k], common[k] / items.sizes[k]) for k in sorted(candidates) if common[k] >= least[k]]


class Search:
    """Finds the items of a block in documents, partition by partition."""

    def __init__(self, block: list[Items], threshold: float, recall: float):
        self.parts = [Searcher(items, threshold, recall) for items in block]

    def find(self, shingles: np.ndarray) -> list[tuple]:
        return [found for part in self.parts for found in part.find(shingles)] if len(shingles) else []


def by_size(rows: list[tuple], threshold: float) -> list[Items]:
    """A block's items in partitions whose sizes differ by less than a factor of two."""
    sizes: dict[int, list[tuple]] = {}
    for row in rows:
        sizes.setdefault(len(row[1]).bit_length(), []).append(row)
    return [Items.of(sizes[k], threshold) for k in sorted(sizes)]


@dataclass
class Block:
    """Items that a broadcast can hold: those of full width in partitions, and the ids of shorter ones by width and hash."""

    parts: list[Items]
    short: dict[int, dict[int, list]]


def item_blocks(items: DataFrame, threshold: float, key: str) -> Iterator[Block]:
    """Test items in blocks. They stream through the driver; it keeps one block at a time."""
    shingler, block, short, held = Shingler(), [], {}, 0
    for item_id, text in items.select(key, text_of()).toLocalIterator():
        shingles, width = shingler.read(text), len(shingler.words(text))
        if not width:
            continue
        if held and held + len(shingles) > BLOCK_SHINGLES:
            yield Block(by_size(block, threshold), short)
            block, short, held = [], {}, 0
        if width < WIDTH:
            short.setdefault(width, {}).setdefault(int(shingles[0]), []).append(item_id)
        else:
            block.append((item_id, shingles))
        held += len(shingles)
    if held:
        yield Block(by_size(block, threshold), short)


class ShortSearch:
    """Finds items of fewer words than a shingle."""

    def __init__(self, short: dict[int, dict[int, list]]):
        self.widths = [(Shingler(width), np.sort(np.array(list(ids), np.uint64)), ids) for width, ids in sorted(short.items())]

    def find(self, text: str) -> list[tuple]:
        found = []
        for shingler, hashes, ids in self.widths:
            mine = shingler.read(text)
            found += [(item, 1.0) for h in (mine[is_in(mine, hashes)].tolist() if len(mine) else []) for item in ids[h]]
        return found


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, containment): every item of which a document has at least ``threshold`` of the shingles."""
    spark, source = docs.sparkSession, docs.select("doc_id", text_of().alias("text"))
    schema = f"doc_id bigint, {key} bigint, containment double"

    def searched(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingler, searcher, short = Shingler(), Search(sent.value.parts, threshold, recall), ShortSearch(sent.value.short)
            for batch in batches:
                each = zip(batch["doc_id"], batch["text"], strict=True)
                out = [(doc_id, item, share) for doc_id, text in each for item, share in searcher.find(shingler.read(text)) + short.find(text)]
                yield pd.DataFrame(out, columns=["doc_id", key, "containment"])

        return source.mapInPandas(rows, schema)

    found = [searched(block) for block in item_blocks(items, threshold, key)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with their columns; rows without doc_id are judged as well."""
    kept = docs
    for block in item_blocks(items, threshold, "item_id"):
        kept = kept.filter(clean_of(docs.sparkSession.sparkContext.broadcast(block.parts), threshold, recall)(text_of()))
    return kept


def clean_of(sent, threshold: float, recall: float):
    """Whether a text contains no item of the block that was sent."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler, searcher = Shingler(), Search(sent.value, threshold, recall)
        for texts in batches:
            yield texts.map(lambda t: not searcher.find(shingler.read(t))).astype(bool)

    return clean


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document contains."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
