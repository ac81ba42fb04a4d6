"""N-gram Jaccard join by MinHash banding.

Texts with equal shingle sets are one node. Each node's MinHash signature is cut into bands; nodes with an equal band
are candidates, and candidates are verified on their full shingle sets. Bands and rows are chosen for the wanted
recall at the threshold.

Buckets of up to ``SMALL`` nodes give their pairs. Larger ones are families of near copies, whose pairs grow with the
square of the family: they give no pairs. Their nodes are laid out family by family, and in it by the largest bucket
and by size, and cut into blocks of at most ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles. A task takes two blocks
that a crowded bucket has in common and whose sizes can reach the threshold, and gets all their intersections from one
matrix product; it returns a number of links for each node and the edges of a spanning forest. So no link is lost,
families that boilerplate chains together are not compared all against all, and rows stay in proportion to documents
times blocks that meet.

Defined results: null and empty texts, and texts without a word, have no shingles: each is a class of its own with no
links. A text of one to four words is one shingle. For ``classes`` a row without doc_id has neither class nor links;
for ``deduplicated`` it is a document like any other, that comes after those with an id. Rows that repeat a doc_id
count as several documents, whether their texts are equal or not. Other columns are ignored, or kept by
``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SALTS, emptied, long_array, table, text_of, with_leader, written
from .graph import components
from .shingles import Shingler, mixed

THRESHOLD, RECALL, ROWS = 0.8, 0.9999, 5
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 20


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values with which a pair at the threshold is met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Signer:
    """Band hashes of a shingle set."""

    def __init__(self, bands: int, rows: int = ROWS):
        rng = np.random.default_rng(7)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, bands * rows, np.uint64)

    def read(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.uint64(2**64 - 1))
        for at in range(0, len(shingles), 1024):
            np.minimum(low, (shingles[at : at + 1024, None] * self.factor + self.shift).min(0), out=low)
        table = (low >> np.uint64(16)).reshape(self.bands, self.rows)
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            total = mixed(total + table[:, k])
        return total.view(np.int64)


def node_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.tobytes())


def numbered_rows(docs: DataFrame) -> DataFrame:
    """The rows in a table of their own: uid, a number for each, and row, its columns."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "rows")


def signatures(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(uid, doc_id, node, n, buckets) of every row; node and buckets are null without words."""
    bands = bands_for(threshold, recall)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, signer, last, found = Shingler(), Signer(bands), None, None
        for batch in batches:
            out = []
            for uid, doc_id, text in batch.itertuples(index=False):
                shingles = shingler.read(text)
                if not len(shingles):
                    out.append((uid, doc_id, None, 0, None))
                    continue
                key = node_key(shingles)
                if key != last:
                    last, found = key, signer.read(shingles)
                out.append((uid, doc_id, key, len(shingles), found))
            yield pd.DataFrame(out, columns=["uid", "doc_id", "node", "n", "buckets"]).astype({"doc_id": "Int64"})

    source = rows.select("uid", "row.doc_id", text_of("row.text").alias("text"))
    return source.mapInPandas(signed, "uid bigint, doc_id bigint, node binary, n int, buckets array<bigint>")


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for ``wanted`` (node, uid): one row is read for each node."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingler.read(t).view(np.int64) for t in batch["text"]]})

    texts = rows.select("uid", text_of("row.text").alias("text")).join(wanted, "uid").select("node", "text")
    return texts.mapInPandas(read, "node binary, shingles array<bigint>")


def cut_into_blocks(nodes: DataFrame) -> DataFrame:
    """(node, n, block) of (node, n, family, home): neighbours in this order share a block. Blocks are cut by running
    weight over the whole order, wherever its partitions end; a node weighs 1, or more if its shingles are many."""
    each = BLOCK_SHINGLES // BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            through = total + batch["weight"].cumsum()
            total = int(through.iloc[-1]) if len(through) else total
            yield batch.assign(through=through)

    parts = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("family", "home", "n", "node")
    laid = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = laid.select("node", "n", F.ceil(F.col("n") / max(each, 1)).alias("weight"), F.spark_partition_id().alias("part"))
    laid = written(laid.mapInPandas(run, "node binary, n int, weight bigint, part int, through bigint"), "laid")
    sums = dict(laid.groupBy("part").agg(F.max("through")).collect())
    begins, total = [0] * (max(sums, default=0) + 1), 0
    for p in sorted(sums):
        begins[p], total = total, total + sums[p]
    start = F.element_at(long_array(begins), F.col("part") + 1) + F.col("through") - F.col("weight")
    return laid.select("node", "n", F.floor(start / BLOCK).cast("bigint").alias("block"))


def block_links(threshold: float):
    """For two blocks of nodes: the links of each node, and the edges of a spanning forest."""

    def task(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = keys
        sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
        sizes = np.array([len(s) for s in sets], "f4")
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
        shared = times[at] > 1
        owner, column = owner[shared], np.unique(at[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), "f4")
        width = 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (low, low + width))
            part = np.zeros((len(sets), width), "f4")
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
        np.fill_diagonal(near, False)
        block = rows["block"].to_numpy()
        if left != right:  # pairs within a block belong to the task of that block
            near &= block[:, None] != block[None, :]
        links = near @ rows["members"].to_numpy("i8")
        label = np.arange(len(sets))
        while True:
            least = np.where(near, label[None, :], len(sets)).min(1, initial=len(sets))
            after = np.minimum(label, least)
            after = after[after]
            if (after == label).all():
                break
            label = after
        nodes = rows["node"].to_numpy()
        keep = links > 0
        return pd.DataFrame({"u": nodes[keep], "v": nodes[label[keep]], "links": links[keep]})

    return task


def meeting_blocks(crowd: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(left, right), left <= right: blocks that have a crowded bucket in common and sizes within the threshold."""
    within = crowd.join(blocks.select("node", "block"), "node").select("bucket", "block").distinct()
    a, b = within.withColumnRenamed("block", "left"), within.withColumnRenamed("block", "right")
    pairs = a.join(b, "bucket").filter(F.col("left") <= F.col("right")).select("left", "right").distinct()
    span = blocks.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    for end in ("left", "right"):
        pairs = pairs.join(span.select(F.col("block").alias(end), F.col("low").alias(f"{end}_low"), F.col("high").alias(f"{end}_high")), end)
    near = (F.col("left_high") >= threshold * F.col("right_low")) & (F.col("right_high") >= threshold * F.col("left_low"))
    return pairs.filter(near).select("left", "right")


def node_links(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, doc_id, node), (node, links) and edges (u, v) that connect all linked nodes, for ``numbered_rows``."""
    signed = written(signatures(rows, threshold, recall), "signed")
    members = signed.filter("node is not null").groupBy("node").agg(
        F.min("uid").alias("uid"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("buckets").alias("buckets")
    )
    nodes = written(members, "nodes")
    inside = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    crowded = written(inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low")).filter("size > 1"), "buckets")
    met = written(inside.join(crowded, "bucket"), "met")
    size = nodes.select("node", "members")

    crowd, few = met.filter(F.col("size") > SMALL), met.filter(F.col("size") <= SMALL)
    families = components(crowd.select(F.col("node").alias("u"), F.col("low").alias("v")), "families").withColumnRenamed("root", "family")
    home = crowd.groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("home"), F.first("n").alias("n"))
    blocks = written(cut_into_blocks(families.join(home, "node")), "blocks")
    meeting = written(meeting_blocks(crowd, blocks, threshold), "meeting")

    a, b = (few.select("bucket", F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "uv")
    sized = (F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")) & (F.col("u") < F.col("v"))
    pairs = a.join(b, "bucket").filter(sized).select("u", "v").distinct()
    # Pairs in blocks that are compared anyway are counted there.
    for c in "uv":
        pairs = pairs.join(blocks.select(F.col("node").alias(c), F.col("block").alias(f"b{c}")), c, "left")
    pairs = pairs.withColumn("left", F.least("bu", "bv")).withColumn("right", F.greatest("bu", "bv"))
    apart = pairs.filter("bu is null or bv is null").unionByName(pairs.filter("bu is not null and bv is not null").join(meeting, ["left", "right"], "left_anti"))
    pairs = written(apart.select("u", "v"), "pairs")

    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(blocks.select("node")).distinct()
    sets = written(shingle_sets(rows, wanted.join(nodes.select("node", "uid"), "node")), "sets")

    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    near = pairs.join(left, "u").join(right, "v").filter(common >= threshold * (F.size("su") + F.size("sv") - common) - 1e-4).select("u", "v")
    near = written(near, "near")

    partners = meeting.select(F.col("left").alias("block"), "left", "right").unionByName(meeting.filter("left != right").select(F.col("right").alias("block"), "left", "right"))
    placed = blocks.join(size, "node").join(sets, "node").select("block", "node", "members", "shingles")
    dealt = partners.join(placed, "block").select("left", "right", "block", "node", "members", "shingles")
    inner = dealt.groupBy("left", "right").applyInPandas(block_links(threshold), "u binary, v binary, links bigint")
    inner = written(inner, "inner")
    emptied(sets)

    ends = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    outer = ends.join(size.withColumnRenamed("node", "v"), "v").select("u", F.col("members").alias("links"))
    links = outer.unionByName(inner.select("u", "links")).groupBy("u").agg(F.sum("links").alias("links"))
    return signed.select("uid", "doc_id", "node"), links.withColumnRenamed("u", "node"), near.unionByName(inner.select("u", "v"))


def row_classes(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """uid, doc_id, n_links, and first_text and first_class: (no_id, doc_id, uid) of the first row with an equal shingle
    set, and of the first in the class. Rows without words are missing."""
    of, links, edges = node_links(rows, threshold, recall)
    roots = components(edges, "classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    worded = of.filter("node is not null").withColumn("place", place)
    named = written(with_leader(worded, "node", "place").select("uid", "doc_id", "node", F.col("leader").alias("first_text"), "members"), "named")
    per_node = named.groupBy("node").agg(F.first("first_text").alias("first_text"), F.first("members").alias("members"))
    per_node = per_node.join(roots, "node", "left").join(links, "node", "left")
    total = F.coalesce("links", F.lit(0)) + F.col("members") - 1
    per_node = per_node.select("node", F.coalesce("root", "node").alias("root"), "first_text", total.alias("n_links"))
    per_node = written(with_leader(per_node, "root", "first_text").select("node", F.col("leader").alias("first_class"), "n_links"), "per-node")
    # The nodes of a very large text go back over salts, as in with_leader.
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    keys = salted.select("node", "_salt").distinct().join(per_node, "node")
    return salted.join(keys, ["node", "_salt"]).select("uid", "doc_id", "first_class", "first_text", "n_links")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: class_id (smallest doc_id of the texts that links connect), text_id (smallest doc_id with
    an equal shingle set) and n_links (other documents at or above the threshold)."""
    rows = numbered_rows(docs.select("doc_id", "text"))
    found = row_classes(rows.filter("row.doc_id is not null"), threshold, recall)
    every = rows.select("uid", "row.doc_id").join(found.drop("doc_id"), "uid", "left")
    own = lambda c: F.coalesce(F.col(f"{c}.doc_id"), F.col("doc_id"))
    return every.select("doc_id", own("first_class").alias("class_id"), own("first_text").alias("text_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that with the smallest doc_id, or one without if none has any. Of
    rows that repeat this doc_id one stays."""
    rows = numbered_rows(docs)
    out = written(row_classes(rows, threshold).filter("uid != first_class.uid").select("uid"), "copies")
    return rows.join(out, "uid", "left_anti").select("row.*")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and its number of links."""
    return classes(table(spark, sf_dir, "documents"))
