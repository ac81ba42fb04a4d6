"""Quality of documents by labels of their lines.

Each line that has a word is content or boilerplate. A linear-chain conditional random field scores a line by its features
(shares of symbols, capitals, digits and marks, words that repeat, the line's own repeats, its length and ends) and a line's
label by the one before; Viterbi decoding finds the best labels of a document's lines. A document stays if content lines hold
at least ``LEAST_SHARE`` of its words, and it does not fail the base rules of length and repetition.

The field is trained on the labelled documents: lines of good documents are content. Of a bad document it is not known which
lines are to blame: all are, at first; after each round its lines are labelled anew by decoding, as long as boilerplate
keeps the larger part. As documents that are good or bad as a whole would teach that labels never change, the lines of each
bad document are also set into a good one. The likelihood's gradient comes from forward and backward sums, and climbs by Adam.

Training takes about ``FIT_ROWS`` labelled documents, half of either class where there are as many, picked by a hash of
doc_id, and of each up to ``FIT_LINES`` lines. Labels of rows whose crc32(doc_id as text) mod 5 is 0 are not used, so that
accuracy can be measured on them. All rows are judged as a whole.

Defined results: null and empty texts have no words and fail. Labels that are null or for unknown ids are ignored; of
several labels for an id the least counts, of several texts the least. Without labels of both classes every line is
content. Rows that repeat each get their row. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, text_of

FIT_ROWS, FIT_LINES = 2_000, 64
LEAST_SHARE = 0.5
#: Base rules: words that a text has at least, words of a window, and percent of words in repeated windows at most.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
STEP_BYTES = 4 << 20
ROUNDS, STEPS, RATE, WEIGHT_DECAY = 3, 50, 0.1, 0.002

_KINDS = ("blank", "start", "symbol", "upper", "lower", "digit", "mark", "shout")
_OF = {
    "blank": b" \t\n\v\f\r", "symbol": SYMBOLS, "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "mark": b".,;:!?", "shout": b"!?", "start": bytes(k for k in range(256) if not 0x80 <= k < 0xC0),
}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _OF.items()}
FEATURES = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def within(running: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return running[ends] - running[begins]


def repeated(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a window that its document has twice or more. Windows of equal hashes are compared as a whole."""
    n = len(ids) - WINDOW + 1
    out = np.zeros(len(ids), bool)
    if n <= 1:
        return out
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    h = doc[inside].astype(np.uint64)
    for k in range(WINDOW):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[inside + k].astype(np.uint64)
    _, where, many = np.unique(h, return_inverse=True, return_counts=True)
    maybe = inside[many[where] > 1]
    if not len(maybe):
        return out
    code = doc[maybe].astype(np.int64)
    for k in range(WINDOW):  # exact: windows equal so far share a number
        code = np.unique(code * (int(ids.max()) + 1) + ids[maybe + k], return_inverse=True)[1]
    starts = maybe[np.bincount(code)[code] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


@dataclass
class Read:
    """What a slice of documents holds; lines are those with a word, in order."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def read(texts: list[str]) -> Read:
    n_docs = len(texts)
    parts = [t.encode() for t in texts]
    raw = b"\n".join(parts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    doc_ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.empty(0, np.int64)
    blank = _TABLES["blank"][data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, raw.split()), np.int64, len(starts))
    feeds = np.flatnonzero(data == 0x0A)
    word_line = np.searchsorted(feeds, starts)
    word_doc = np.searchsorted(doc_ends, starts, "right")
    again = repeated(ids, word_doc)
    # Lines that have a word.
    has = np.flatnonzero(np.bincount(word_line, minlength=len(feeds)))
    begins, ends = np.concatenate([[0], feeds[:-1] + 1])[has] if len(feeds) else feeds, feeds[has]
    line_doc = np.searchsorted(doc_ends, begins, "right")
    line_of_word = np.searchsorted(has, word_line)
    words = np.bincount(line_of_word, minlength=len(has))
    seen: set[tuple[int, bytes]] = set()
    copies = np.zeros(len(has), bool)
    for k, (d, a, b) in enumerate(zip(line_doc.tolist(), begins.tolist(), ends.tolist(), strict=True)):
        line = (d, raw[a:b])
        if line in seen:
            copies[k] = True
        else:
            seen.add(line)
    counts = {}
    for kind in _KINDS:
        running = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_TABLES[kind][data], out=running[1:])
        counts[kind] = within(running, begins, ends)
        if kind in ("start", "symbol", "blank"):
            edges = np.concatenate([[0], doc_ends])
            counts[f"doc_{kind}"] = within(running, edges[:-1], edges[1:]).astype(np.int64)
    size = np.maximum(ends - begins - counts["blank"], 1)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    per_line = lambda mask: np.bincount(line_of_word, mask, len(has))
    different = np.bincount(np.unique(line_of_word * (len(number) + 1) + ids) // (len(number) + 1), minlength=len(has))
    share = {k: counts[k] / size for k in ("symbol", "upper", "digit", "mark", "shout")}
    letters = np.maximum(counts["upper"] + counts["lower"], 1)
    last = data[np.maximum(ends - 1, 0)]
    stuttered, twice = per_line(same) / np.maximum(words, 1), per_line(again) / np.maximum(words, 1)
    features = np.stack([
        np.ones(len(has)), np.log1p(words) / 5, share["symbol"], np.minimum(share["symbol"] * 10, 1), counts["upper"] / letters, (counts["upper"] > 0.5 * letters) * 1.0,
        share["digit"], share["mark"], np.minimum(share["shout"] * 10, 1), stuttered, (stuttered > 0.3) * 1.0, different / np.maximum(words, 1),
        _TABLES["mark"][last] * 1.0, size / np.maximum(words, 1) / 10, copies * 1.0, twice,
    ], axis=1)
    per_doc = lambda doc, mask: np.bincount(doc, mask, n_docs).astype(np.int64)
    chars = counts["doc_start"] - counts["doc_blank"]
    return Read(np.bincount(word_doc, minlength=n_docs), chars, counts["doc_symbol"], per_doc(line_doc, copies), per_doc(word_doc, again), line_doc, words, features)


# --- the field ----------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Scores for label 1 (content) against 0: weights of features, and of a label after another (before, after)."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of each line; equal scores go to content."""
        gain = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.steps.tolist()
        back0, back1 = bytearray(len(gain)), bytearray(len(gain))
        firsts = np.concatenate([[True], doc[1:] != doc[:-1]]).tolist() if len(doc) else []
        lasts = firsts[1:] + [True] if firsts else []
        s0 = s1 = 0.0
        ends = []
        for k, (g, first, last) in enumerate(zip(gain, firsts, lasts, strict=True)):
            if first:
                s0, s1 = 0.0, g
            else:
                a, b = s0 + t00, s1 + t10
                c, d = s0 + t01, s1 + t11
                back0[k], back1[k] = b >= a, d >= c
                s0, s1 = (b if b >= a else a), (d if d >= c else c) + g
            if last:
                ends.append((k, s1 >= s0))
        out = bytearray(len(gain))
        at = len(ends) - 1
        label = False
        for k in range(len(gain) - 1, -1, -1):
            if at >= 0 and ends[at][0] == k:
                label, at = ends[at][1], at - 1
            out[k] = label
            label = (back1 if label else back0)[k] if not firsts[k] else label
        return np.frombuffer(bytes(out), np.uint8).astype(bool)


def gradient(field: Field, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels, and its gradients. Sequences are rows of lines, longest first, padded where ``mask`` is
    false; a step goes over the rows that are as long."""
    gain, steps = x @ field.weights, field.steps
    n, length = mask.shape
    long = mask.sum(0)
    emit = np.stack([np.zeros_like(gain), gain], 2)
    forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, length):
        before = forward[: long[t], t - 1]
        forward[: long[t], t] = np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1]) + emit[: long[t], t]
    for t in range(length - 2, -1, -1):
        after = emit[: long[t + 1], t + 1] + backward[: long[t + 1], t + 1]
        backward[: long[t + 1], t] = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
    last = forward[np.arange(n), mask.sum(1) - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    content = np.exp(np.where(mask, forward[:, :, 1] + backward[:, :, 1] - total[:, None], -np.inf))
    after = emit[:, 1:] + backward[:, 1:] - total[:, None, None]
    both = mask[:, 1:]
    pairs = np.array([[np.exp(np.where(both, forward[:, :-1, a] + steps[a, b] + after[:, :, b], -np.inf)).sum() for b in (0, 1)] for a in (0, 1)])
    met = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    score = (gain * y * mask).sum() + (met * steps).sum() - total.sum()
    return score, np.tensordot((y - content) * mask, x, 2), met - pairs


def train(documents: list[tuple[bool, np.ndarray, np.ndarray]]) -> Field:
    """Of (is good, features, words by line) for each document."""
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    field.weights[0] = 1.0
    documents = [d for d in documents if len(d[1])]
    if len({good for good, _, _ in documents}) < 2:
        return field
    labels = [np.full(len(f), float(good)) for good, f, _ in documents]
    goods, bads = ([k for k, d in enumerate(documents) if d[0] == want] for want in (True, False))
    # Sequences of (document, from, to): each document, and bad ones within good ones.
    sequences = [[(k, 0, len(f))] for k, (_, f, _) in enumerate(documents)]
    for g, b in zip(goods, bads, strict=False):
        half = len(labels[g]) // 2
        sequences.append([(g, 0, half), (b, 0, len(labels[b])), (g, half, len(labels[g]))])
    sequences.sort(key=lambda parts: -sum(b - a for _, a, b in parts))
    n, length = len(sequences), sum(b - a for _, a, b in sequences[0])
    x, mask, y = np.zeros((n, length, FEATURES)), np.zeros((n, length), bool), np.zeros((n, length))
    for row, parts in enumerate(sequences):
        own = np.concatenate([documents[k][1][a:b] for k, a, b in parts])
        x[row, : len(own)], mask[row, : len(own)] = own, True
    lines = mask.sum()
    field.weights[0] = 0.0
    moments = [np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.zeros((2, 2))]
    step = 0
    for turn in range(ROUNDS):
        if turn:
            for k, (good, f, words) in enumerate(documents):
                if not good:
                    found = field.decode(f, np.zeros(len(f), np.int64))
                    labels[k] = found * float(words[found].sum() < LEAST_SHARE * words.sum())
        for row, parts in enumerate(sequences):
            own = np.concatenate([labels[k][a:b] for k, a, b in parts])
            y[row, : len(own)] = own
        for _ in range(STEPS):
            step += 1
            _, by_weight, by_step = gradient(field, x, mask, y)
            for k, (value, g) in enumerate(((field.weights, by_weight), (field.steps, by_step))):
                g = g / lines - WEIGHT_DECAY * value
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * g * g
                value += RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.999**step)) + 1e-8)
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Field:
    """The field of a sample of labelled rows. Its ids and its lines' features are all that the driver gets."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for quality, n in sizes.items():
        share = F.when(F.col("quality") == quality, int(min(1.0, rows / len(sizes) / n) * 1_000_000)).otherwise(share)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).select("doc_id", "quality", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = read(part.column(2).to_pylist())
                cut = np.searchsorted(found.line_doc, np.arange(part.num_rows + 1)).tolist()
                held = [slice(a, min(b, a + FIT_LINES)) for a, b in zip(cut, cut[1:], strict=False)]
                columns = [part.column(0), part.column(1), pa.array([found.features[h].astype("<f8").tobytes() for h in held], pa.binary()), pa.array([found.line_words[h].astype("<i8").tobytes() for h in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "features", "words"])

    found = sample.mapInArrow(lines, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, features binary, words binary").orderBy("doc_id").collect()
    return train([(r["quality"] == 1, np.frombuffer(r["features"], "<f8").reshape(-1, FEATURES), np.frombuffer(r["words"], "<i8")) for r in found])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most STEP_BYTES, or one longer row."""
    begin = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if k > begin and held + n > STEP_BYTES:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """key, the counts, base_failed, kept, content_words; with ``spans`` also the labels of the lines that have a word, as a text of
    1 (content) and 0."""
    sent = df.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                found = read(part.column(1).to_pylist())
                content = own.decode(found.features, found.line_doc)
                words = np.bincount(found.line_doc, content * found.line_words, part.num_rows).astype(np.int64)
                failed = (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > MOST_REPEATED * found.n_words)
                kept = ~failed & (words >= LEAST_SHARE * found.n_words)
                columns = [part.column(0), *(pa.array(getattr(found, c).astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(words)]
                if spans:
                    shown = (content + np.uint8(48)).astype(np.uint8).tobytes().decode()
                    cut = np.searchsorted(found.line_doc, np.arange(part.num_rows + 1)).tolist()
                    columns.append(pa.array([shown[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, *COUNTS, "base_failed", "kept", "content_words", *["lines"] * spans])

    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, content_words bigint" + ", lines string" * spans
    return df.select(key, text_of(text).alias("_text")).mapInArrow(rows, schema)


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words of every document."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
