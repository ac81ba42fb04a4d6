"""Phrase collocations from count tries.

A task (shard) counts phrases of 2 to 4 words in tries of that depth: a node is its parent and one more word, and nodes
stand in the order of their words' hashes. A trie is written as sorted runs, one for each range of prefixes (a range is a
hash of the first two words, so a phrase that is frequent does not draw other phrases to its range). The runs of a range
meet in one task, which merges them a few at a time, keeps nodes with enough occurrences, and reads the left parts of a
phrase off the walk to its node. Right parts come by suffix links: the node without the first word is joined by its words.

Only what can be frequent is counted further: words are counted first, then phrases of two frequent words, then longer
phrases all of whose pairs are frequent. What passes on is a bitmap of fixed size, hashed: a wrong bit costs work, not
results. Words stand by 64-bit hashes of (lang, word); should two words with a frequent one among them share a hash, which is
checked against the words themselves, all is hashed anew with another seed.

Defined results: texts that are null or empty have no words; null lang counts as ``und``; repeated rows count each time.
Words, cuts and scores are as the query's contract says; scores are computed in decimals of 38 digits. Only lang and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, text_of, written

LEAST, DEPTH, TOP = 30, 4, 2000
#: 100 times a longer phrase's occurrences that hide a phrase, for 100 of its own; what a score is multiplied with.
HIDES, SCALE = 80, 2_000_000
#: Bits of the bitmaps that are sent to executors, as powers of two.
WORD_BITS, PAIR_BITS = 26, 27
#: Occurrences of words for each range of prefixes, and least number of ranges.
RANGE_WORDS, LEAST_RANGES = 4_000_000, 64
#: Words of a shard, and different ones, at which its trie is written and a new one begun.
SHARD_WORDS, SHARD_VOCABULARY = 2_000_000, 300_000
#: Entries that a merging task holds before it sums them, and bytes of texts taken apart at a time.
MERGED, STEP_BYTES = 500_000, 4 << 20
SEEDS = 8

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_KIND = np.zeros(256, np.uint8)  # 1: between words; 2: between pieces
_KIND[[0x20, 0x09]], _KIND[list(b".,;:!?\n\v\f\r")] = 1, 2
_BLANK = bytes(0x20 if k else b for b, k in enumerate(_KIND))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of two."""
    x = first * _A + second
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of texts as numbers, and what is known of each number."""

    def __init__(self, seed: int):
        self.seed, self.number = seed, count()
        self.known: dict[str, defaultdict[bytes, int]] = {}

    def __len__(self) -> int:
        return sum(map(len, self.known.values()))

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the words of (lang, text) rows, and whether each stands in one piece with the one before it."""
        langs = batch.column(0).to_pylist()
        rows: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(langs, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            rows[lang].append(text)
        for lang, texts in rows.items():
            yield self._taken(lang, texts)

    def _taken(self, lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\n".join(texts)
        kind = _KIND[np.frombuffer(raw, np.uint8)]
        starts = np.flatnonzero((kind == 0) & np.concatenate([[True], kind[:-1] > 0])) if raw else np.empty(0, np.int64)
        breaks = np.searchsorted(np.flatnonzero(kind == 2), starts)
        known = self.known.setdefault(lang, defaultdict(self.number.__next__))
        ids = np.fromiter(map(known.__getitem__, raw.translate(_BLANK).translate(_LOWER).split()), np.int32, len(starts))
        return ids, np.concatenate([[False], breaks[1:] == breaks[:-1]])[: len(ids)]

    def words(self) -> tuple[list[str], list[bytes], np.ndarray]:
        """Language, word and hash by number."""
        n = len(self)
        langs, words, hashes = [""] * n, [b""] * n, np.empty(n, np.uint64)
        for lang, known in self.known.items():
            own = xxhash.xxh64_intdigest(lang.encode(), self.seed)
            for word, k in known.items():
                langs[k], words[k], hashes[k] = lang, word, xxhash.xxh64_intdigest(word, own)
        return langs, words, hashes


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most STEP_BYTES of text, or one longer row: a batch may hold more words than a shard."""
    begin = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if k > begin and held + n > STEP_BYTES:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def marked(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = bits_of(hashes, bits)
    return bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Of a column ``h``; the driver gets the bitmap in pieces of 4,096 bytes, of which there are 2^(bits-15)."""
    at = F.shiftrightunsigned("h", 64 - bits) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(1 << max(bits - 3, 12), np.uint8)
    for r in parts:
        out[(r["k"] - 1) * 4096 :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def of_texts(df: DataFrame, lang: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_of(text).alias("text")).filter("text <> ''")


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n of every word: tries of depth one, merged."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            langs, words, hashes = own.words()
            columns = [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts[: len(words)])]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])

        own, counts = Words(seed), np.zeros(0, np.int64)
        for part in (p for batch in batches for p in slices(batch)):
            for ids, _ in own.read(part):
                if len(counts) < len(own):
                    counts = np.concatenate([counts, np.zeros(len(own), np.int64)])
                counts += np.bincount(ids, minlength=len(counts))
            if len(own) > SHARD_VOCABULARY:
                yield out()
                own, counts = Words(seed), np.zeros(0, np.int64)
        if len(own):
            yield out()

    found = texts.mapInArrow(rows, "lang string, word string, h bigint, n bigint")
    return written(found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n")), "words")


def frequent_words(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """All words, the frequent ones, and the seed under which no other word has a frequent one's hash."""
    for seed in range(SEEDS):
        words = word_counts(texts, seed)
        shared = words.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).filter((F.col("c") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            return words, words.filter(F.col("n") >= least), seed
    raise RuntimeError(f"words share hashes under each of {SEEDS} seeds")


class Shard:
    """A trie over the words of a task."""

    def __init__(self, seed: int, word_bits: np.ndarray):
        self.words, self.bits = Words(seed), word_bits
        self.ids: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray, joined: np.ndarray) -> None:
        self.ids.append(ids)
        self.joined.append(joined)
        self.held += len(ids)

    @property
    def full(self) -> bool:
        """Whether the trie is large enough to be written."""
        return self.held >= SHARD_WORDS or len(self.words) > SHARD_VOCABULARY

    def levels(self, pair_bits: np.ndarray | None, depth: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """Level, hashes of the words (in order) and count of the nodes: of level 2 without ``pair_bits``, else of the deeper."""
        ids, joined = np.concatenate(self.ids), np.concatenate(self.joined)
        self.ids, self.joined = [], []
        hashes = self.words.words()[2]
        order = np.argsort(hashes)
        hashes, rank = hashes[order], np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        at = rank[ids]
        keep = marked(self.bits, hashes, WORD_BITS)[at]
        n = np.int64(len(hashes))
        # Places of pairs' second words; a node is (its parent's place in sorted order, the last word).
        ends = np.flatnonzero(joined[1:] & keep[1:] & keep[:-1]) + 1
        code = at[ends - 1] * n + at[ends]
        if pair_bits is None:
            node, many = np.unique(code, return_counts=True)
            yield 2, [hashes[node // n], hashes[node % n]], many
            return
        node, where = np.unique(code, return_inverse=True)
        path = [hashes[node // n], hashes[node % n]]
        good = marked(pair_bits, mixed(*path), PAIR_BITS)[where]
        pair_end = np.zeros(len(ids) + 1, bool)
        pair_end[ends[good]] = True
        place = np.zeros(len(ids), np.int32)
        place[ends] = where
        ends = ends[good]
        for level in range(3, depth + 1):
            ends = ends[pair_end[ends + 1]] + 1
            node, where, many = np.unique(place[ends - 1] * n + at[ends], return_inverse=True, return_counts=True)
            path = [*(x[node // n] for x in path), hashes[node % n]]
            yield level, path, many
            place[ends] = where


def range_of(first: np.ndarray, second: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed(first, second) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


RUN = "range int, level int, run binary"
RUN_NAMES = ["range", "level", "run"]


def packed(level: int, path: list[np.ndarray], many: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A sorted run for each range: the words' hashes one column after another, then the counts."""
    own = range_of(path[0], path[1], ranges)
    order = np.argsort(own, kind="stable")
    own = own[order]
    path, many = [x[order] for x in path], many[order].astype("<i8")
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    runs = [b"".join([*(x[a:b].tobytes() for x in path), many[a:b].tobytes()]) for a, b in zip(cut, [*cut[1:], len(own)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(own[cut]), pa.array(np.full(len(cut), level, np.int32)), pa.array(runs, pa.binary())], names=RUN_NAMES)


def runs(texts: DataFrame, seed: int, word_bits, pair_bits, ranges: int, depth: int) -> DataFrame:
    """The shards' tries as sorted runs; ``word_bits`` and ``pair_bits`` are broadcast."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pair_bits.value if pair_bits else None
        own = Shard(seed, word_bits.value)
        for part in (p for batch in batches for p in slices(batch)):
            for ids, joined in own.words.read(part):
                own.add(ids, joined)
            if own.full:
                yield from (packed(*level, ranges) for level in own.levels(known, depth))
                own = Shard(seed, word_bits.value)
        if own.held:
            yield from (packed(*level, ranges) for level in own.levels(known, depth))

    return texts.mapInArrow(rows, RUN)


def summed(path: list[np.ndarray], many: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal paths made one, in the order of their words."""
    order = np.lexsort(path[::-1])
    path, many = [x[order] for x in path], many[order]
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in path], axis=0)])
    heads = np.flatnonzero(new)
    return [x[heads] for x in path], np.add.reduceat(many, heads)


class Merge:
    """Merges the runs of one range and level, at most ``MERGED`` entries beyond the different ones at a time."""

    def __init__(self, level: int):
        self.level, self.parts, self.held, self.kept = level, [], 0, 0

    def add(self, run: bytes) -> None:
        columns = np.frombuffer(run, "<u8").reshape(self.level + 1, -1)
        self.parts.append((list(columns[:-1]), columns[-1].view(np.int64)))
        self.held += columns.shape[1]
        if self.held > self.kept + MERGED:
            self.done()

    def done(self) -> tuple[list[np.ndarray], np.ndarray]:
        path, many = summed([np.concatenate(x) for x in zip(*(p for p, _ in self.parts), strict=True)], np.concatenate([n for _, n in self.parts]))
        self.parts, self.held, self.kept = [(path, many)], len(many), len(many)
        return path, many


def merged(found: DataFrame, least: int, ranges: int) -> DataFrame:
    """The frequent nodes of each range and level, as runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            path, many = own.done()
            keep = many >= least
            run = b"".join([*(x[keep].tobytes() for x in path), many[keep].tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([run], pa.binary())], names=RUN_NAMES)

        own, key = None, None
        for batch in batches:
            for k, level, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (k, level):
                    if own:
                        yield out()
                    own, key = Merge(level), (k, level)
                own.add(run)
        if own:
            yield out()

    return found.repartition(ranges, "range").sortWithinPartitions("range", "level").mapInArrow(rows, RUN)


NODE = "level int, w1 bigint, w2 bigint, w3 bigint, w4 bigint, a bigint, left2 bigint, left3 bigint"


def nodes(found: DataFrame, ranges: int) -> DataFrame:
    """The nodes as rows, with the counts met on the walk to them: of the first two and first three words."""

    def walked(path: list[np.ndarray], up: tuple[list[np.ndarray], np.ndarray]) -> np.ndarray:
        """Counts of the parents: both stand in the order of their words, and every frequent node's parent is there."""
        parents, many = up
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in path[:-1]], axis=0)])
        uses = np.repeat([0, 1], [len(many), int(new.sum())])
        met = summed([np.concatenate([x, y[new]]) for x, y in zip(parents, path, strict=False)], uses)[1] > 0
        return many[met][np.cumsum(new) - 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}
        own = None
        for batch in batches:
            for k, level, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != own:
                    last, own = {}, k
                columns = np.frombuffer(run, "<u8").reshape(level + 1, -1)
                path, many = list(columns[:-1]), columns[-1].view(np.int64)
                if not len(many):
                    continue
                none = np.zeros(len(many), np.int64)
                left2 = left3 = none
                if level == 3:
                    left2 = walked(path, last[2][:2])
                elif level == 4:
                    left3, left2 = walked(path, last[3][:2]), walked(path, (last[3][0], last[3][2]))
                last[level] = (path, many, left2)
                words = [x.view(np.int64) for x in path] + [none] * (4 - level)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), level, np.int32)), *map(pa.array, (*words, many, left2, left3))], names=[c.split()[0] for c in NODE.split(", ")])

    return found.repartition(ranges, "range").sortWithinPartitions("range", "level").mapInArrow(rows, NODE)


def phrases(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases as nodes, and all words with their counts."""
    spark, texts = df.sparkSession, of_texts(df, lang, text)
    words, frequent, seed = frequent_words(texts, least)
    n = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, -(-n // RANGE_WORDS))
    send = spark.sparkContext.broadcast
    word_bits = send(bitmap(frequent.select("h"), WORD_BITS))
    pairs = written(merged(runs(texts, seed, word_bits, None, ranges, depth), least, ranges), "pairs")
    second = written(nodes(pairs, ranges), "pair-nodes")
    if depth == 2:
        return second, words
    # The hash of a pair as ``mixed`` has it, in the tasks that read the runs.

    def pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, other = (c.to_numpy().view(np.uint64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(first, other).view(np.int64))], names=["h"])

    pair_bits = send(bitmap(second.select("w1", "w2").mapInArrow(pair_hashes, "h bigint"), PAIR_BITS))
    deeper = merged(runs(texts, seed, word_bits, pair_bits, ranges, depth), least, ranges)
    return written(nodes(pairs.unionByName(written(deeper, "phrases")), ranges), "nodes"), words


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases (all, unranked, with ``top`` None)."""
    found, words = phrases(df, lang, text, least)
    # Suffix links: the node of a phrase without its first word has the count of the right part.
    tails = found.select((F.col("level") + 1).alias("level"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("right1"))
    linked = found.join(tails, ["level", "w2", "w3", "w4"], "left")
    tails = linked.filter("level = 3").select(F.lit(4).alias("level"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("right1").alias("right2"))
    linked = linked.join(tails, ["level", "w2", "w3", "w4"], "left")
    # A phrase hides in longer ones that occur nearly as often.
    part = lambda *ws: F.struct(F.lit(len(ws)).alias("level"), *[F.col(w).alias(f"w{k}") for k, w in enumerate(ws, 1)], *[F.lit(0).cast("bigint").alias(f"w{k}") for k in range(len(ws) + 1, 5)])
    three, four = [part("w1", "w2"), part("w2", "w3")], [part("w1", "w2"), part("w2", "w3"), part("w3", "w4"), part("w1", "w2", "w3"), part("w2", "w3", "w4")]
    inside = found.filter("level > 2").select(F.explode(F.when(F.col("level") == 3, F.array(*three)).otherwise(F.array(*four))).alias("p"), F.col("a").alias("longer"))
    inside = inside.groupBy("p").agg(F.max("longer").alias("longer")).select("p.*", "longer")
    seen = linked.join(inside, ["level", "w1", "w2", "w3", "w4"], "left").filter(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * HIDES))
    known = words.filter(F.col("n") >= least).select("h", "lang", "word", F.col("n").alias("f"))
    for k in range(1, DEPTH + 1):
        own = known.select(F.col("h").alias("_h"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
        there = F.col("level") >= k  # the first word stands in for one that is not there, so that no key is common to all short phrases
        seen = seen.withColumn("_h", F.when(there, F.col(f"w{k}")).otherwise(F.col("w1"))).join(own, "_h").drop("_h").withColumn(f"word{k}", F.when(there, F.col(f"word{k}")))
    c = F.col

    def cut(k: int, left: Column, right: Column) -> Column:
        over, under = wide(c("a")) * SCALE, wide(left) + wide(right)
        return F.struct(((over - over % under) / under).cast("bigint").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    cuts = (
        F.when(c("level") == 2, F.array(cut(1, c("f1"), c("f2"))))
        .when(c("level") == 3, F.array(cut(1, c("f1"), c("right1")), cut(2, c("left2"), c("f3"))))
        .otherwise(F.array(cut(1, c("f1"), c("right1")), cut(2, c("left2"), c("right2")), cut(3, c("left3"), c("f4"))))
    )
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = seen.select("lang", F.concat_ws(" ", *[f"word{k}" for k in range(1, DEPTH + 1)]).alias("phrase"), "a", F.array_min(cuts).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").join(total, "lang")
    if top is None:
        return scored.select("lang", "phrase", "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2,000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


_SQL_CUT = "CAST(2000000::HUGEINT * a // ({l} + {r}) AS BIGINT)"
OP12_SQL = f"""WITH piece AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, p, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM (SELECT lang, p, list_filter(string_split_regex(piece, '[ \\t]+'), lambda t: t <> '') AS words FROM piece)),
g AS (SELECT lang, word AS w1, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS a FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f4 AS (SELECT lang, w1, w2, w3, w4, count(*) AS a FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
cut AS (SELECT f2.lang, [f2.w1, f2.w2] AS words, f2.a, 1 AS k, x.a AS l, y.a AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL SELECT f3.lang, [f3.w1, f3.w2, f3.w3], f3.a, 1, x.a, y.a FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, [f3.w1, f3.w2, f3.w3], f3.a, 2, x.a, y.a FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
  UNION ALL SELECT f4.lang, [f4.w1, f4.w2, f4.w3, f4.w4], f4.a, 1, x.a, y.a FROM f4 JOIN f1 x ON x.lang = f4.lang AND x.w1 = f4.w1 JOIN f3 y ON y.lang = f4.lang AND y.w1 = f4.w2 AND y.w2 = f4.w3 AND y.w3 = f4.w4
  UNION ALL SELECT f4.lang, [f4.w1, f4.w2, f4.w3, f4.w4], f4.a, 2, x.a, y.a FROM f4 JOIN f2 x ON x.lang = f4.lang AND x.w1 = f4.w1 AND x.w2 = f4.w2 JOIN f2 y ON y.lang = f4.lang AND y.w1 = f4.w3 AND y.w2 = f4.w4
  UNION ALL SELECT f4.lang, [f4.w1, f4.w2, f4.w3, f4.w4], f4.a, 3, x.a, y.a FROM f4 JOIN f3 x ON x.lang = f4.lang AND x.w1 = f4.w1 AND x.w2 = f4.w2 AND x.w3 = f4.w3 JOIN f1 y ON y.lang = f4.lang AND y.w1 = f4.w4),
best AS (SELECT lang, words, a, l, r, {_SQL_CUT.format(l="l", r="r")} AS score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY {_SQL_CUT.format(l="l", r="r")}, k) = 1),
inner_of AS (SELECT lang, unnest([[w1, w2], [w2, w3]]) AS words, a FROM f3
  UNION ALL SELECT lang, unnest([[w1, w2], [w2, w3], [w3, w4], [w1, w2, w3], [w2, w3, w4]]), a FROM f4),
hidden AS (SELECT DISTINCT b.lang, b.words FROM best b JOIN inner_of o ON o.lang = b.lang AND o.words = b.words WHERE 100::HUGEINT * o.a >= 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
    array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM best b JOIN total USING (lang) WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.lang = b.lang AND h.words = b.words)) WHERE rank <= 2000"""
