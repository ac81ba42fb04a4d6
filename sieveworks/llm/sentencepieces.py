"""Unigram encoding and decoding with SentencePiece vocabularies.

The pieces stand in a double-array trie with their log scores, and the best segmentation is found by Viterbi. A
character that no piece begins with falls back to its UTF-8 bytes. Spaces become the marker U+2581, one is put in
front, and decoding turns them back. Where no piece has a marker behind another character (checked when the
vocabulary is read), the best path of a text is the best paths of its words one after another, so each distinct word is
segmented once for a task and kept. New words of up to ``SIDE_BY_SIDE`` bytes go through the trie and the Viterbi
recurrence side by side, on arrays; longer ones one by one.

A vocabulary of merge ranks has no probabilities; its k-th merge of n gets the Zipf log probability -log(k * H_n).

Defined results: null and empty texts have no pieces and are lossless. A text that itself holds the marker comes back
with a space in its place, and one with lone surrogates cannot occur in Spark; ``lossless`` tells. Rows that repeat
each get their row. Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words kept by a task before it starts anew.
KEPT_WORDS = 300_000
#: Vocabularies are sent to all executors; larger ones are refused.
MOST_PIECES = 1_000_000
UNKNOWN_PENALTY = 10.0
ROWS_OUT = 256
#: Longest word, in bytes, that is segmented side by side with others, and bytes of words at once.
SIDE_BY_SIDE, BLOCK_BYTES = 64, 1 << 20


class DoubleArray:
    """Trie over bytes: the child of ``node`` for byte c is ``base[node] + c + 1`` if that place's check is ``node``."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0] * 512, [-1] * 512, [-1] * 512
        self.check[0] = 0
        free = 1
        words = sorted(keys)
        todo = [(0, 0, len(words), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            if len(words[low]) == depth:
                self.value[node] = keys[words[low]]
                low += 1
            groups: list[tuple[int, int, int]] = []
            for k in range(low, high):
                c = words[k][depth] + 1
                if groups and groups[-1][0] == c:
                    groups[-1] = (c, groups[-1][1], k + 1)
                else:
                    groups.append((c, k, k + 1))
            if not groups:
                continue
            while self.check[free] >= 0:
                free += 1
                self._grow(free + 300)
            base = begin = max(1, free - groups[0][0])
            while True:
                self._grow(base + 300)
                if all(self.check[base + c] < 0 for c, _, _ in groups):
                    break
                base += 1
            if base - begin > 100:  # crowded; its few holes stay empty
                free = base
            self.base[node] = base
            for c, a, b in groups:
                self.check[base + c] = node
                todo.append((base + c, a, b, depth + 1))

    def _grow(self, size: int) -> None:
        if len(self.base) <= size:
            more = len(self.base)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


@dataclass
class Vocabulary:
    pieces: list[bytes]
    scores: list[float]
    byte_ids: list[int]
    by_word: bool
    trie: DoubleArray = field(repr=False)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        """Pieces and scores of a model file; merge ranks become log probabilities."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > MOST_PIECES:
            raise ValueError(f"{path} has {n} pieces; at most {MOST_PIECES} are sent to executors")
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        raw = {i: model.get_score(i) for i in plain}
        ranks = all(s <= 0 and s == int(s) for s in raw.values())
        if ranks:
            total = math.log(sum(1 / k for k in range(1, len(plain) + 1)))
            raw = {i: -math.log(k) - total for k, i in enumerate(plain, 1)}
        return cls.of({i: model.id_to_piece(i) for i in plain}, raw, {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}, n)

    @classmethod
    def of(cls, plain: dict[int, str], score: dict[int, float], bytes_at: dict[int, int], n: int) -> Vocabulary:
        pieces, scores = [b""] * n, [0.0] * n
        for i, piece in plain.items():
            pieces[i], scores[i] = piece.encode(), score[i]
        unknown = min(score.values()) - UNKNOWN_PENALTY
        for byte, i in bytes_at.items():
            pieces[i], scores[i] = bytes([byte]), unknown
        by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain.values())
        return cls(pieces, scores, [bytes_at[b] for b in range(256)], by_word, DoubleArray({p.encode(): i for i, p in plain.items()}))

    def best(self, word: str) -> list[int]:
        """Piece ids of the best path."""
        data = word.encode()
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        unknown = scores[self.byte_ids[0]]
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, whole = 0, False
            for j in range(i, n):
                at = base[node] + data[j] + 1
                if check[at] != node:
                    break
                node = at
                if value[node] >= 0:
                    score = here + scores[value[node]]
                    whole = whole or j + 1 == i + width
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = score, i, value[node]
            if not whole and here + unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = here + unknown, i, -1
        ids: list[int] = []
        while n:
            start = back[n]
            ids += [piece[n]] if piece[n] >= 0 else [self.byte_ids[b] for b in reversed(data[start:n])]
            n = start
        return ids[::-1]

    def best_of_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of the best path of each of the words, none of which is empty or longer than SIDE_BY_SIDE bytes."""
        base, check, value, scores = self.arrays
        sizes = np.array([len(w) for w in words])
        data, owner = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        first = np.flatnonzero((data & 0xC0) != 0x80)  # a path goes from character to character
        # All matches of pieces, by walking the trie from every character at once.
        start, at, node, found = first, first, np.zeros(len(first), np.int32), []
        while len(start):
            after = base[node] + data[at] + np.int32(1)
            on = check[after] == node
            start, at, node = start[on], at[on] + 1, after[on]
            hit = value[node] >= 0
            found.append((start[hit], at[hit], value[node[hit]]))
            on = at < ends[owner[start]]
            start, at, node = start[on], at[on], node[on]
        lead = data[first]
        next_ = first + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        starts, stops, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        width = np.zeros(len(data), np.int64)
        width[first] = next_ - first
        whole = np.zeros(len(data), bool)
        whole[starts[stops - starts == width[starts]]] = True
        bare = ~whole[first]
        starts, stops = np.append(starts, first[bare]), np.append(stops, next_[bare])
        ids = np.append(ids, np.full(int(bare.sum()), -1))
        # The recurrence takes one place in all words at a time; equal scores go to the earliest start.
        place = stops - begins[owner[starts]]
        order = np.argsort((place << 40) | (stops << 10) | (1023 - (stops - starts)))
        starts, stops, ids, place = starts[order], stops[order], ids[order], place[order]
        gain = np.where(ids >= 0, scores[ids], scores[self.byte_ids[0]])
        source, target = starts + owner[starts], stops + owner[starts]  # a word of n bytes has n + 1 places
        best, back = np.zeros(len(data) + len(words)), np.zeros(len(data) + len(words), np.int64)
        cuts = np.searchsorted(place, np.arange(1, int(place[-1]) + 2)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            reached, score = target[a:b], best[source[a:b]] + gain[a:b]
            new = np.concatenate([[True], reached[1:] != reached[:-1]])
            heads = np.flatnonzero(new)
            most, group = np.maximum.reduceat(score, heads), np.cumsum(new) - 1
            top = np.flatnonzero(score == most[group])
            top = top[np.concatenate([[True], group[top[1:]] != group[top[:-1]]])]
            best[reached[heads]], back[reached[heads]] = most, top + a
        root = begins + np.arange(len(words))
        here, path = ends + np.arange(len(words)), []
        while len(here):
            path.append(back[here])
            here = source[path[-1]]
            going = here != root
            here, root = here[going], root[going]
        path = np.concatenate(path)
        path = path[np.argsort(starts[path])]
        starts, stops, ids = starts[path], stops[path], ids[path]
        many = np.where(ids >= 0, 1, stops - starts)
        out = np.repeat(ids, many)
        fallback = np.flatnonzero(out < 0)
        inside = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
        out[fallback] = np.array(self.byte_ids)[data[(np.repeat(starts, many) + inside)[fallback]]]
        packed = out.astype("<i4").tobytes()
        to = np.cumsum(np.bincount(owner[starts], many, len(words)).astype(np.int64)) * 4
        return [packed[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return *(np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores)

    def decode(self, ids) -> str:
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")[1:]


WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Encodes whole texts, keeping the ids of words it has met as packed integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.kept = vocabulary, {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of new words. Short ones are kept; the others are returned for the texts at hand."""
        own, long, short, held = self.vocabulary, {}, [], 0

        def learn() -> None:
            self.kept.update(zip([w for w, _ in short], own.best_of_many([raw for _, raw in short]), strict=True))

        for word in words:
            raw = word.encode()
            if len(raw) > SIDE_BY_SIDE:
                long[word] = np.array(own.best(word), "<i4").tobytes()
                continue
            short.append((word, raw))
            held += len(raw)
            if held >= BLOCK_BYTES:
                learn()
                short, held = [], 0
        if short:
            learn()
        return long

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        if not self.vocabulary.by_word:
            return [np.array(self.vocabulary.best(m) if m else [], "<i4") for m in marked]
        words = [WORDS.findall(m) for m in marked]
        new = set().union(*words) - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = set().union(*words)
        long = self._learn(new)
        known = self.kept
        get = (lambda w: known[w] if w in known else long[w]) if long else known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in words]


def encode(df: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, n_pieces, n_bytes (pieces from byte fallback), score (log), lossless (the ids decode to the text)."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("score", pa.float64()), ("lossless", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        encoder, scores = Encoder(own), np.array(own.scores)
        fallback = np.zeros(len(own.pieces), bool)
        fallback[own.byte_ids] = True
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                texts = part.column(1).to_pylist()
                found = encoder.encode(texts)
                flat = np.concatenate(found) if found else np.empty(0, "<i4")
                ends = np.cumsum([0, *map(len, found)]).astype("i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                columns = [
                    part.column(0), ids, pa.array(np.diff(ends).astype("i8")),
                    pa.array([int(fallback[f].sum()) for f in found], pa.int64()),
                    pa.array([float(scores[f].sum()) for f in found], pa.float64()),
                    pa.array([own.decode(f.tolist()) == t for f, t in zip(found, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *schema.names])

    source = df.select(key, text_of(text).alias("_text"))
    return source.mapInArrow(rows, f"{key} {dict(df.dtypes)[key]}, ids array<int>, n_pieces bigint, n_bytes bigint, score double, lossless boolean")


def decode(df: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded``: the text of ``ids``; null where they are null."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else vocabulary.value.decode(x) if len(x) else "")

    return df.withColumn("decoded", texts(F.col(ids)))


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether they decode to its text."""
    return encode(table(spark, sf_dir, "documents"))
