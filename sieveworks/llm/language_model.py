"""Gated recurrent language model: log-likelihoods of whole documents.

Token counts come from all training documents. The most frequent words are units of the model; every other word
belongs to a tail unit by its beginning and ending, within which its probability follows from its count. A gated
recurrent unit reads units, and a class-factored softmax gives the next one: first its class, then the unit within the
class. Training is truncated backpropagation in numpy, state carried from window to window: one task warms the weights
up on about ``WARM_TOKENS`` tokens, then every partition goes on from there over all of its training documents and the
results are averaged, weighted by tokens (parameters meet by index, not on the driver). Scoring carries the state
across the windows of a document too, so a score is that of the complete text.

Counts of the ``HEAD`` most frequent tokens are broadcast, those of long ones within ``LONG_BYTES``; the rest are joined.
The bounds move work, not results: counts are exact either way. The weights do depend on how the rows lie in partitions,
as each goes over its own rows before the average; the same table in the same partitions gives the same scores.

Defined results: null counts as empty, which is one end token. A null doc_id is a training row. Repeated rows each
count and each get their row. Without any training token all counts are zero and the weights stay as they begin. Other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, text_of, written

END = b""
CLASSES, PER_CLASS, HIDDEN = 16, 32, 16
TAILS = 64
WORDS = CLASSES * PER_CLASS - TAILS
#: Counts that are broadcast, of tokens of up to HEAD_BYTES; bytes of frequent longer tokens; and the bound of the warm-up.
HEAD, HEAD_BYTES, LONG_BYTES, WARM_TOKENS = 1 << 17, 64, 1 << 22, 1_000_000
WINDOW, WARM_LANES, LANES, TILE = 32, 32, 256, 512
#: Tokens scored side by side; many documents at once keep the lanes full while the longest end.
SCORE_TOKENS = 1 << 21
RATE, CLIP = 0.01, 5.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words in ASCII lower case, split at ASCII white space, then the end."""
    return [*text.encode().lower().split(), END]


def tail_of(token: bytes) -> int:
    last = token[-1:]
    ending = 0 if last == b"." else 1 if last == b"," else 2 if last < b"\x80" and not last.isalnum() else 3
    return ending * 16 + zlib.crc32(token[:2]) % 16


def counted(docs: DataFrame) -> DataFrame:
    """(token, tail, c) over all of ``docs``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        out = lambda: pd.DataFrame({"token": list(counts), "tail": [tail_of(t) for t in counts], "c": list(counts.values())})
        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens(text))
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    parts = docs.select(text_of().alias("text")).mapInPandas(rows, "token binary, tail int, c bigint")
    return parts.groupBy("token").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def head_of(counts: DataFrame) -> DataFrame:
    """At most HEAD of the most frequent tokens: those from a count on; and longer ones, as a rule of dashes, up to
    LONG_BYTES. Both are read off the numbers of tokens by size of count, of which there are a few hundred, so no task
    sorts all tokens and the driver gets no more than the head. The end is among them in any case."""
    step, short = F.floor(F.log2("c") * 16), F.octet_length("token") <= HEAD_BYTES
    weight = F.when(short, F.lit(1)).otherwise(F.octet_length("token"))
    sizes = counts.groupBy(short.alias("short"), step.alias("s")).agg(F.sum(weight).alias("w")).collect()
    head = F.col("token") == F.lit(END)
    for kind, most in ((True, HEAD), (False, LONG_BYTES)):
        held, least = 0, None
        for _, size, weight in sorted((r for r in sizes if r["short"] == kind), key=lambda r: -r["s"]):
            if held + weight > most:
                break
            held, least = held + weight, size
        if least is not None:
            head = head | ((short == kind) & (step >= least))
    return counts.filter(head)


@dataclass
class Lexicon:
    """Units and counts of the most frequent tokens, and the mass of each tail."""

    head: dict[bytes, int]
    unit: np.ndarray
    count: np.ndarray
    tail_mass: np.ndarray  # tokens + types + 1 of each tail
    total: int
    types: int
    unit_count: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Lexicon:
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        mass, sums = np.ones(TAILS), np.zeros(TAILS)
        for tail, c, types in counts.groupBy("tail").agg(F.sum("c"), F.count(F.lit(1))).collect():
            mass[tail] += c + types
            sums[tail] += c
        top = head_of(counts).orderBy(F.octet_length("token") > 0, F.desc("c"), "token").toArrow()  # the end first
        names, count = top.column("token").to_pylist(), top.column("c").to_numpy()
        if names[:1] != [END]:  # without any training row
            names, count = [END, *names], np.append(0, count)
        unit = np.append([tail_of(END)] * (len(names) - top.num_rows), top.column("tail").to_numpy()).astype(np.int32)
        chosen = min(WORDS, len(names))
        np.subtract.at(mass, unit[:chosen], np.where(count[:chosen] > 0, count[:chosen] + 1, 0))
        np.subtract.at(sums, unit[:chosen], count[:chosen])
        unit[:chosen] = TAILS + np.arange(chosen)
        unit_count = np.zeros(CLASSES * PER_CLASS)
        unit_count[:TAILS], unit_count[TAILS : TAILS + chosen] = sums, count[:chosen]
        return cls({t: k for k, t in enumerate(names)}, unit, count.astype(np.int64), mass, int(n), int(v), unit_count)

    def places(self, text: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The tokens, their places in the head (-1 beyond it) and units, which of them are beyond, and the tails of those."""
        found = tokens(text)
        at = np.fromiter(map(self.head.get, found, repeat(-1)), np.int32, len(found))
        units, missed = self.unit[at], np.flatnonzero(at < 0)
        tails = [tail_of(found[k]) for k in missed.tolist()]
        units[missed] = tails
        return found, at, units, missed, tails

    def units(self, text: str) -> np.ndarray:
        return self.places(text)[2]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Units and counts (-1 where not in the head) of the tokens, and the (token, tail) beyond the head."""
        found, at, units, missed, tails = self.places(text)
        counts = self.count[at]
        counts[missed] = -1
        return units, counts, Counter(zip([found[k] for k in missed.tolist()], tails, strict=True))


class Network:
    """Gated recurrent unit with a class-factored output; unit u is number u % PER_CLASS of class u // PER_CLASS."""

    SHAPES = (("X", (CLASSES * PER_CLASS, 3 * HIDDEN)), ("U", (HIDDEN, 3 * HIDDEN)), ("C", (HIDDEN, CLASSES)), ("c", (CLASSES,)), ("W", (CLASSES, HIDDEN, PER_CLASS)), ("w", (CLASSES, PER_CLASS)))

    def __init__(self, flat: np.ndarray):
        self.flat, self.p, at = flat.astype("f4"), {}, 0
        for name, shape in self.SHAPES:
            size = math.prod(shape)
            self.p[name] = self.flat[at : at + size].reshape(shape)
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(math.prod(s) for _, s in cls.SHAPES)

    @classmethod
    def begin(cls, unit_count: np.ndarray) -> Network:
        """Small random weights; biases at the frequencies of classes and units."""
        net = cls(np.random.default_rng(3).normal(0, 0.1, cls.size()))
        by_class = unit_count.reshape(CLASSES, PER_CLASS) + 0.5
        net.p["c"][:] = np.log(by_class.sum(1) / by_class.sum())
        net.p["w"][:] = np.log(by_class / by_class.sum(1, keepdims=True))
        return net

    def step(self, units: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.move(self.p["X"][units], h)

    def move(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after an input of which ``x`` is the row in X, and what it comes from."""
        k = HIDDEN
        u = h @ self.p["U"]
        gates = x[:, : 2 * k] + u[:, : 2 * k]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, inner = gates[:, :k], gates[:, k:], u[:, 2 * k :]
        n = r * inner
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return after, z, r, n, inner

    @staticmethod
    def by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and (class, begin, end) of those that occur."""
        owner = targets // PER_CLASS
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(CLASSES + 1)).tolist()
        return order, [(c, ends[c], ends[c + 1]) for c in range(CLASSES) if ends[c] < ends[c + 1]]

    @staticmethod
    def exp(logits: np.ndarray) -> np.ndarray:
        """In place; capped, so that no sum overflows."""
        return np.exp(np.minimum(logits, 80, out=logits), out=logits)

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        order, parts = self.by_class(targets)
        states, own = states[order], targets[order] % PER_CLASS
        share = self.exp(states @ self.p["C"] + self.p["c"])
        total = share.sum(1)
        got = np.empty(len(targets), "f4")
        for c, a, b in parts:
            inner = self.exp(states[a:b] @ self.p["W"][c] + self.p["w"][c])
            got[a:b] = inner[np.arange(b - a), own[a:b]] / inner.sum(1) * share[a:b, c]
        out = np.empty(len(targets))
        out[order] = np.log(np.maximum(got / total, 1e-37))
        return out

    def forward(self, units: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States of a window (time, lane), and what the way back needs: for each time the state before, z, r, n, inner."""
        states, past, x = np.empty((*units.shape, HIDDEN), "f4"), np.empty((5, *units.shape, HIDDEN), "f4"), self.p["X"][units]
        for t in range(len(units)):
            h = np.multiply(h, fresh[t][:, None], out=past[0, t])
            states[t], past[1, t], past[2, t], past[3, t], past[4, t] = self.move(x[t], h)
            h = states[t]
        return states, past

    def gradient(self, units: np.ndarray, targets: np.ndarray, weight: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean loss over a window (time, lane), and the state after it."""
        steps, lanes = units.shape
        grad = Network(np.zeros(len(self.flat), "f4"))
        g, k = grad.p, HIDDEN
        states, past = self.forward(units, fresh, h)
        order, parts = self.by_class(targets.ravel())
        flat, own = states.reshape(-1, k)[order], targets.ravel()[order] % PER_CLASS
        scale = weight.ravel()[order] / max(1.0, float(weight.sum()))
        share = self.exp(flat @ self.p["C"] + self.p["c"])
        share *= (scale / share.sum(1))[:, None]
        for c, a, b in parts:
            share[a:b, c] -= scale[a:b]
        g["C"][:], g["c"][:] = flat.T @ share, share.sum(0)
        back = share @ self.p["C"].T
        for c, a, b in parts:
            inner = self.exp(flat[a:b] @ self.p["W"][c] + self.p["w"][c])
            inner *= (scale[a:b] / inner.sum(1))[:, None]
            inner[np.arange(b - a), own[a:b]] -= scale[a:b]
            g["W"][c], g["w"][c] = flat[a:b].T @ inner, inner.sum(0)
            back[a:b] += inner @ self.p["W"][c].T
        placed = np.empty_like(back)
        placed[order] = back
        back = placed.reshape(steps, lanes, k)
        before, z, r, n, inner = past
        rest = 1 - z
        to_n, to_z, to_r = rest * (1 - n * n), (before - n) * z * rest, inner * r * (1 - r)
        gates, through, d = np.empty((steps, lanes, 3 * k), "f4"), np.empty((steps, lanes, 3 * k), "f4"), np.zeros((lanes, k), "f4")
        for t in reversed(range(steps)):
            d += back[t]
            dn = d * to_n[t]
            gate = gates[t]
            np.multiply(d, to_z[t], out=gate[:, :k])
            np.multiply(dn, to_r[t], out=gate[:, k : 2 * k])
            gate[:, 2 * k :] = dn
            through[t, :, : 2 * k] = gate[:, : 2 * k]
            np.multiply(dn, r[t], out=through[t, :, 2 * k :])
            d *= z[t]
            d += through[t] @ self.p["U"].T
            d *= fresh[t][:, None]
        g["U"][:] = before.reshape(-1, k).T @ through.reshape(-1, 3 * k)
        order = np.argsort(units.ravel(), kind="stable")
        ordered = units.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        g["X"][ordered[first]] = np.add.reduceat(gates.reshape(-1, 3 * k)[order], first, axis=0)
        return grad.flat, states[-1]


class Trainer:
    """Adam over windows of lanes; documents lie end to end in the lanes."""

    def __init__(self, net: Network, lanes: int):
        self.net, self.lanes, self.seen, self.updates = net, lanes, 0, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)

    def learn(self, documents: list[np.ndarray]) -> None:
        total = sum(map(len, documents))
        columns = -(-total // self.lanes)
        pad = columns * self.lanes - total
        targets = np.concatenate([*documents, np.zeros(pad, np.int32)])
        units = np.concatenate([*[np.concatenate([[TAILS], d[:-1]]) for d in documents], np.zeros(pad, np.int32)]).astype(np.int32)
        fresh = np.ones(len(targets), "f4")
        fresh[np.cumsum([0, *map(len, documents)])[:-1]] = 0
        weight = np.ones(len(targets), "f4")
        weight[total:] = 0
        shaped = [np.ascontiguousarray(x.reshape(self.lanes, columns).T) for x in (units, targets, weight, fresh)]
        h = np.zeros((self.lanes, HIDDEN), "f4")
        for at in range(0, columns, WINDOW):
            slope, h = self.net.gradient(*(x[at : at + WINDOW] for x in shaped), h)
            self.move(slope)
        self.seen += total

    def move(self, slope: np.ndarray) -> None:
        self.updates += 1
        norm = float(np.sqrt((slope**2).sum()))
        if norm > CLIP:
            slope = slope * (CLIP / norm)
        self.m += 0.1 * (slope - self.m)
        self.v += 0.01 * (slope**2 - self.v)
        fade = 1 / math.sqrt(1 + self.updates / 200)
        self.net.flat -= RATE * fade * (self.m / (1 - 0.9**self.updates)) / (np.sqrt(self.v / (1 - 0.99**self.updates)) + 1e-6)


def train_rows(lexicon, weights: np.ndarray, lanes: int, at_once: int):
    """Task: trains over its rows and yields its weights times tokens, in one row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer, held, size = Trainer(Network(weights.copy()), lanes), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(lexicon.value.units(text))
                size += len(held[-1])
                if size >= at_once:
                    trainer.learn(held)
                    held, size = [], 0
        if held:
            trainer.learn(held)
        if trainer.seen:
            yield pd.DataFrame({"tokens": [trainer.seen], "weights": [trainer.net.flat.astype("f8") * trainer.seen]})

    return rows


TRAINED, SUMS = "tokens bigint, weights array<double>", 16


def summed(trained: DataFrame) -> DataFrame:
    """One row for each partition: its sums."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = 0, None
        for batch in batches:
            for tokens_, weights in batch.itertuples(index=False):
                seen, total = seen + tokens_, weights if total is None else total + weights
        if seen:
            yield pd.DataFrame({"tokens": [seen], "weights": [total]})

    return trained.mapInPandas(add, TRAINED)


def average(trained: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """Mean of the partitions' weights by tokens. They are summed where they lie, then in ``SUMS`` tasks, whose sums come
    to the driver."""
    rows = summed(summed(trained).repartition(SUMS)).collect()
    if not rows:
        return otherwise
    return (sum(np.array(r["weights"]) for r in rows) / sum(r["tokens"] for r in rows)).astype("f4")


def train(docs: DataFrame, lexicon: Lexicon, sent) -> np.ndarray:
    texts = docs.select("doc_id", text_of().alias("text"))
    start = Network.begin(lexicon.unit_count).flat
    share = min(1.0, WARM_TOKENS / max(lexicon.total, 1))
    warm = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < math.ceil(share * (1 << 40))).select("text")
    once = warm.repartition(1).mapInPandas(train_rows(sent, start, WARM_LANES, 1 << 18), TRAINED)
    warmed = average(once, start)
    parts = written(texts.select("text").mapInPandas(train_rows(sent, warmed, LANES, 1 << 20), TRAINED), "trained")
    return average(parts, warmed)


def score_block(net: Network, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document; lanes are documents, longest first, and leave as they end."""
    order = np.argsort([-len(d) for d in documents], kind="stable")
    sizes = np.array([len(documents[k]) for k in order])
    out, h = np.zeros(len(documents)), np.zeros((len(documents), HIDDEN), "f4")
    last = np.full(len(documents), TAILS, np.int32)
    for begin in range(0, int(sizes[0]), WINDOW):
        end = min(begin + WINDOW, int(sizes[0]))
        alive = int(np.searchsorted(-sizes, -begin))
        targets = np.zeros((end - begin, alive), np.int32)
        for lane in range(alive):
            part = documents[order[lane]][begin:end]
            targets[: len(part), lane] = part
        lanes, state = np.searchsorted(-sizes[:alive], -np.arange(begin, end)), np.empty((alive, HIDDEN), "f4")
        for low in range(0, alive, TILE):  # so many at once stay near the processor
            part, live = slice(low, min(low + TILE, alive)), np.clip(lanes - low, 0, TILE)
            own = targets[:, part]
            x = net.p["X"][np.concatenate([last[None, part], own[:-1]])]
            states, now = np.empty((end - begin, own.shape[1], HIDDEN), "f4"), h[part]
            for t, n in enumerate(live.tolist()):
                states[t, :n] = now = net.move(x[t, :n], now[:n])[0]
            state[low : low + len(now)] = now
            on = np.arange(own.shape[1])[None, :] < live[:, None]
            gain = np.zeros(on.shape)
            gain[on] = net.log_probs(states[on], own[on])
            out[part] += gain.sum(0)
        h, last = state, targets[-1]
    result = np.empty(len(documents))
    result[order] = out
    return result


def score_rows(lexicon, weights):
    """Task: head sums of each document, and its tokens beyond the head."""

    def done(known: Lexicon, net: Network, rows: list[tuple]) -> pd.DataFrame:
        likelihood = score_block(net, [r[3] for r in rows]) / math.log(10)
        out = []
        floor = math.log10(known.total + known.types + 1)
        for (uid, doc_id, held, units, counts, beyond), score in zip(rows, likelihood, strict=True):
            inside = counts >= 0
            logs = np.log10(counts[inside] + 1)
            tail = inside & (units < TAILS)
            score += float(np.log10(counts[tail] + 1).sum() - np.log10(known.tail_mass[units[tail]]).sum())
            spread = [(t, n, k) for (t, k), n in beyond.items()]
            out.append((uid, doc_id, held, len(units), int((counts > 0).sum()), float(logs.sum()) - floor * int(inside.sum()), score, spread))
        return pd.DataFrame(out, columns=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "beyond"]).astype({"doc_id": "Int64"})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, net, held, size = lexicon.value, Network(weights.value), [], 0
        for batch in batches:
            for uid, doc_id, out, text in batch.itertuples(index=False):
                held.append((uid, doc_id, out, *known.read(text)))
                size += len(held[-1][3])
                if size >= SCORE_TOKENS:
                    yield done(known, net, held)
                    held, size = [], 0
        if held:
            yield done(known, net, held)

    return rows


SCORED = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, beyond array<struct<token: binary, n: int, tail: int>>"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = written(counted(training), "counts")
    lexicon = Lexicon.of(counts)
    sent = spark.sparkContext.broadcast(lexicon)
    weights = spark.sparkContext.broadcast(train(training, lexicon, sent))
    source = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    seen = written(source.mapInPandas(score_rows(sent, weights), SCORED), "scored")
    beyond = seen.select("uid", F.explode("beyond").alias("b")).select("uid", "b.*").join(counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    mass = F.element_at(F.array(*[F.lit(float(x)) for x in lexicon.tail_mass]), F.col("tail") + 1)
    floor = math.log10(lexicon.total + lexicon.types + 1)
    tail = beyond.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(c + 1) - floor)).alias("more_base"),
        F.sum(F.col("n") * (F.log10(c + 1) - F.log10(mass))).alias("more_score"),
    )
    return seen.drop("beyond").join(tail, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-likelihood, and that of the base counts."""
    return score(table(spark, sf_dir, "documents"))
