"""Toxicity by weak supervision.

Many weak voters look at a text: single words and word beginnings that stand out in toxic training rows, lexicons of
them by strength, density patterns, and voters that speak against. A generative label model finds, by expectation
maximisation, how often each voter gives each vote for either class, and which voters depend on one another: a tree of
most mutual information given the class, so a vote that repeats another adds nothing. The annotator's label is one more
voter while the model is fitted, with estimated rates; it tells the classes apart. The posterior that the linear
classifier learns comes from the other votes alone, so a label that no voter supports does not become a target. The
classifier sees the counts of words and beginnings, and scores every whole text.

The classifier is fitted on a sample of labelled rows of about ``FIT_ROWS``, picked by a hash of doc_id; all rows are
scored. The label column is never an input of a score.

Defined results: null and empty texts get the score of a text without any word. Labels that are null, or for unknown
ids, are ignored; of several labels for an id the largest counts, of several texts the least. Without labelled rows of both classes every score is
the share of toxic labels, 0 if there are none. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, text_of, written

#: Labelled rows on which voters, label model and classifier are fitted, about.
FIT_ROWS = 20_000
#: Words and beginnings that the classifier sees, and those of them that vote on their own.
MARKERS, VOTERS = 512, 48
#: Imagined right labels of either class from which the annotator's rates start, imagined votes for each vote of a parent,
#: and what a dependency must tell about a vote.
ANNOTATOR, SMOOTHING, LEAST_BITS = 5.0, 4.0, 0.002
PREFIXES = range(4, 9)
KEPT_WORDS = 300_000
#: Rows whose products are summed at once while fitting: numpy widens its operands as a whole.
FIT_SLICE = 2048
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def traits(word: str) -> list[str]:
    """The word, and its beginnings that go on."""
    return [f"={word}", *(f"{word[:k]}+" for k in PREFIXES if len(word) > k)]


def fit_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the different texts of about FIT_ROWS labelled rows; only ids and labels of the sample are broadcast."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, FIT_ROWS / max(n, 1))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("doc_id")
    # A text with many copies is one example.
    return sample.withColumn("_h", F.xxhash64("text")).dropDuplicates(["_h", "toxic"]).drop("_h")


def count_traits(sample: DataFrame) -> DataFrame:
    """(trait, toxic, clean): texts of either class that have the trait."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(WORD.findall(text.lower()))
                counts[1 if toxic else 0].update({t for w in words for t in traits(w)})
            names = list(counts[0] | counts[1])
            yield pd.DataFrame({"trait": names, "toxic": [counts[1][t] for t in names], "clean": [counts[0][t] for t in names]})

    parts = sample.mapInPandas(rows, "trait string, toxic bigint, clean bigint")
    return parts.groupBy("trait").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def strongest(counts: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int]]:
    """Traits by how surely they are more frequent in toxic rows: the log-likelihood ratio of their counts."""
    both, share = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share)))
    best = counts.filter((F.col("toxic") >= 2) & (F.col("toxic") > both * share)).withColumn("g", ratio).filter("g > 6.6").orderBy(F.desc("g"), "trait").limit(MARKERS)
    return [(r["trait"], r["toxic"], r["clean"]) for r in best.collect()]


class TraitReader:
    """Counts of the known traits in a text."""

    def __init__(self, names: list[str]):
        self.at, self.kept = {t: k for k, t in enumerate(names)}, {}

    def read(self, text: str) -> tuple[Counter, int]:
        kept, at, found, words = self.kept, self.at, Counter(), WORD.findall(text.lower())
        for word in words:
            hits = kept.get(word)
            if hits is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                hits = kept[word] = tuple(at[t] for t in traits(word) if t in at)
            if hits:
                found.update(hits)
        return found, len(words)


def votes(counts: np.ndarray, sizes: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """A column for each voter: 1 toxic, 0 clean, -1 no opinion."""
    has = counts > 0
    columns = [np.where(has[:, k], 1, -1) for k in range(min(VOTERS, counts.shape[1]))]
    for low, high in ((0, 16), (16, 64), (64, 256), (0, 64), (0, MARKERS)):  # lexicons by strength
        n = has[:, low:high].sum(1)
        columns += [np.where(n >= 1, 1, -1), np.where(n >= 2, 1, -1), np.where(n == 0, 0, -1)]
    pure = has[:, strength > 3].sum(1)
    total = counts.sum(1)
    columns += [np.where(pure > 0, 1, 0), np.where(total >= 0.02 * sizes + 1, 1, -1), np.where(total < 0.002 * sizes, 0, -1)]
    return np.stack(columns, 1).astype("i1")


def summed(rows: int, part: Callable[[slice], np.ndarray]) -> np.ndarray:
    return sum(part(slice(k, k + FIT_SLICE)) for k in range(0, rows, FIT_SLICE))


def one_hot(ballots: np.ndarray) -> np.ndarray:
    """Row, voter * 3 + vote + 1."""
    return np.stack([ballots == v for v in (-1, 0, 1)], 2).reshape(len(ballots), -1).astype("f4")


def dependencies(joint: np.ndarray) -> list[int]:
    """For each voter the one it depends on, -1 for none, from ``joint`` (class, voter, vote, voter, vote): the spanning
    tree of most mutual information given the class. Pairs that tell less than ``LEAST_BITS`` stay independent."""
    voters = joint.shape[1]
    share = joint / joint[:, 0, :, 0, :].sum()
    by_class = share[:, 0, :, 0, :].sum((1, 2))
    own = np.einsum("cjvjv->cjv", share)
    apart = own[:, :, :, None, None] * own[:, None, None, :, :] / by_class[:, None, None, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        told = np.where(share > 1e-12, share * np.log2(share / apart), 0.0).sum((0, 2, 4))
    np.fill_diagonal(told, -1.0)
    parent, best, link = [-1] * voters, told[0].copy(), np.zeros(voters, int)
    left = set(range(1, voters))
    while left:
        near = max(left, key=lambda j: best[j])
        left.remove(near)
        if best[near] >= LEAST_BITS:
            parent[near] = int(link[near])
        closer = told[near] > best
        best[closer], link[closer] = told[near][closer], near
    return parent


@dataclass
class LabelModel:
    """A class, and votes that depend on it and on at most one other vote each. ``gain`` is, for each voter, the log odds
    that its vote adds given its parent's vote; ``right`` how often the annotator gives the class, for either class."""

    prior: float
    parent: list[int]
    gain: np.ndarray  # voter, parent's vote + 1, vote + 1
    rates: np.ndarray  # voter, class, vote + 1
    right: tuple[float, float]

    @classmethod
    def fit(cls, ballots: np.ndarray, gold: np.ndarray, rounds: int = 30) -> LabelModel:
        """Expectation maximisation from the annotator's labels. The annotator is a voter of its own: how often it is
        right is estimated like the rest, from ``ANNOTATOR`` imagined labels that are."""
        shown, m = one_hot(ballots), ballots.shape[1]
        belief = np.where(gold > 0, 0.9, 0.1)
        for _ in range(rounds):
            joint = np.stack([summed(len(shown), lambda s, w=w: (shown[s] * w[s, None]).T @ shown[s]) for w in (1 - belief, belief)]).astype("f8").reshape(2, m, 3, m, 3)
            prior = float(np.clip(belief.mean(), 1e-6, 1 - 1e-6))
            parent = dependencies(joint)
            own = np.einsum("cjvjv->jcv", joint) + 0.5
            rates = own / own.sum(2, keepdims=True)
            gain = np.zeros((m, 3, 3))
            for j, k in enumerate(parent):
                if k < 0:
                    gain[j] = np.log(rates[j, 1] / rates[j, 0])
                else:  # where a parent's vote is rare, the voter's own rates stand in
                    table = joint[:, k, :, j, :] + SMOOTHING * rates[j][:, None, :]
                    table /= table.sum(2, keepdims=True)
                    gain[j] = np.log(table[1] / table[0])
            on, off = float(belief[gold > 0].sum()), float((1 - belief)[gold <= 0].sum())
            right = ((off + ANNOTATOR) / ((1 - belief).sum() + ANNOTATOR + 1), (on + ANNOTATOR) / (belief.sum() + ANNOTATOR + 1))
            model = cls(prior, parent, gain, rates, right)
            after = model.belief(ballots, gold)
            if np.abs(after - belief).max() < 1e-4:
                break
            belief = after
        return model

    def belief(self, ballots: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """The probability of toxic given the votes, and the annotator's label if it is given."""
        odds = np.full(len(ballots), np.log(self.prior / (1 - self.prior)))
        for j, k in enumerate(self.parent):
            odds += self.gain[j, ballots[:, k] + 1 if k >= 0 else 1, ballots[:, j] + 1]
        if gold is not None:
            off, on = self.right
            odds += np.where(gold > 0, np.log(on / (1 - off)), np.log((1 - on) / off))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray
    bias: float

    @staticmethod
    def inputs(counts: np.ndarray) -> np.ndarray:
        return np.log1p(counts)

    @classmethod
    def fit(cls, names: list[str], counts: np.ndarray, target: np.ndarray, steps: int = 400, decay: float = 1e-4) -> Classifier:
        x = cls.inputs(counts)
        w, b, rate = np.zeros(x.shape[1], "f4"), float(np.log(target.mean() / (1 - target.mean()))), 0.05
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            gap = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target
            slope = np.append(summed(len(x), lambda s, gap=gap: x[s].T @ gap[s]) / len(gap) + decay * w, gap.mean())
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, b = (w - move[:-1]).astype("f4"), b - float(move[-1])
        return cls(names, w, b)

    def scores(self, texts: pd.Series, reader: TraitReader) -> np.ndarray:
        odds = np.full(len(texts), self.bias)
        for row, text in enumerate(texts):
            for k, n in reader.read(text)[0].items():
                odds[row] += self.weights[k] * np.log1p(n)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    sample = written(fit_sample(docs, labels), "sample")
    sizes = dict(sample.groupBy((F.col("toxic") > 0).alias("t")).count().collect())
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        share = float(toxic > 0)
        return Classifier([], np.zeros(0, "f4"), 30.0 if share else -30.0)
    found = strongest(count_traits(sample), toxic, clean)
    names = [t for t, _, _ in found]
    if not names:
        return Classifier([], np.zeros(0, "f4"), float(np.log(toxic / clean)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TraitReader(names)
        for batch in batches:
            rows = [reader.read(t) for t in batch["text"]]
            yield pd.DataFrame({"at": [list(f) for f, _ in rows], "n": [list(f.values()) for f, _ in rows], "words": [n for _, n in rows], "toxic": batch["toxic"].array})

    # About FIT_ROWS rows of at most MARKERS small counts.
    rows = sample.mapInPandas(read, "at array<int>, n array<int>, words int, toxic int").toArrow()
    at, n = (rows[c].combine_chunks() for c in ("at", "n"))
    counts = np.zeros((len(rows), len(names)), "f4")
    counts[np.repeat(np.arange(len(rows)), at.value_lengths()), at.flatten()] = n.flatten()
    words, gold = rows["words"].to_numpy().astype("f4"), (rows["toxic"].to_numpy() > 0).astype("i1")
    strength = np.array([np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) for _, t, c in found])
    ballots = votes(counts, words, strength)
    target = LabelModel.fit(ballots, gold).belief(ballots)
    return Classifier.fit(names, counts, np.clip(target, 1e-4, 1 - 1e-4))


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TraitReader(sent.value.names)
        for batch in batches:
            score = sent.value.scores(batch["text"], reader)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "held_out": batch["held_out"].array, "score": score, "predicted": (score >= 0.5).astype("i4")})

    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return source.mapInPandas(rows, "doc_id bigint, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = TraitReader(sent.value.names)
        for texts in batches:
            yield pd.Series(sent.value.scores(texts, reader))

    return docs.filter(score(text_of()) < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
