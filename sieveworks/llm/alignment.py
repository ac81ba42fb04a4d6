"""Alignment of two tokenizers over the same texts.

A byte-level merge vocabulary (A) and a piece vocabulary with byte fallback (B) both cut the bytes of space+text. The
tokens of a whole slice of an Arrow batch are laid end to end, so their ends are byte offsets that count through all of
its documents. The ends of A and of B are counted once by offset; where both end, a group ends. Running sums of these
counts tell the group, the A token and the B token of every offset, and their values at the documents' ends tell each
document's own numbers. Between two neighbouring ends lies one A and one B token, so each such stretch is one link.

Links are counted over the corpus by pair of ids: each task sums what it has before the shuffle. The counts go back to the
documents in blocks of at most ``PAIR_BLOCK`` pairs (and those of one A id), each of which passes over the pairs that the
documents have kept.

No piece of B has a space behind another character (checked when it is read; otherwise whole texts are encoded), so B's
tokens of a text are those of its words one after another, and a worker keeps the ids of words it has met.

Defined results: a text that is null or empty, or whose tokens of A or B do not give back the bytes of space+text, has no
tokens: its numbers are 0 and its digest is ''. Rows that repeat each get their row, and their links all count. Only key
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, text_of, written

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A word of B begins at a space behind another character that is not the text's last.
WORD = re.compile(r"(?<=[^ ]) (?=.)", re.DOTALL)
#: Words that a worker keeps, and the longest one kept, in characters.
KEPT, LONGEST = 500_000, 64
#: Texts with a run of so much white space go to the slower library, as the quicker one's pattern gives up on long runs.
BLANK = re.compile(r"\s{1000}")
#: Bytes of texts that are laid end to end; a longer text stands alone.
STEP_BYTES = 2 << 20
#: Pairs whose counts are sent to executors at a time, and different pairs that a task sums before it hands them on.
PAIR_BLOCK, HELD_PAIRS = 2_000_000, 2_000_000
#: The pattern by which byte-level vocabularies split texts (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class ByteLevel:
    """Vocabulary A: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_of_letters(), spec["model"]["vocab"]
        special = {x["content"] for x in spec.get("added_tokens") or [] if x.get("special")}
        self.path, self.pieces = path, [b""] * (max(vocab.values()) + 1)
        ranks = {}
        for token, k in vocab.items():
            self.pieces[k] = token.encode() if token in special else bytes(letters[c] for c in token)
            if token not in special:
                ranks[self.pieces[k]] = k
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ordered = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        form = spec.get("pre_tokenizer") or {}
        plain = form.get("type") == "ByteLevel" and form.get("use_regex", True) and not form.get("add_prefix_space") and not spec.get("normalizer")
        self.ranks = ranks if ordered and plain else None
        self.sizes = np.array([len(p) for p in self.pieces])

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True
        return own

    @cached_property
    def fast(self):
        """Ids in the order of the merges serve as ranks of the quicker library."""
        import tiktoken

        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranks is None or BLANK.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """Vocabulary B, which puts a space in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        shown = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(shown)]
        self.sizes = np.array([len(p) for p in self.pieces])
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in shown)
        self.kept: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words whose ids do not give back their bytes

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of new words."""
        ids = self.model.encode(words, num_threads=1)
        flat, ends = np.fromiter(chain.from_iterable(ids), "<i4"), np.cumsum(list(map(len, ids)))
        joined, raw = b"".join([self.pieces[i] for i in flat.tolist()]), [b" " + w.encode() for w in words]
        sizes = np.concatenate([[0], np.cumsum(self.sizes[flat])])[ends]
        if joined != b"".join(raw) or not np.array_equal(sizes, np.cumsum(list(map(len, raw)))):
            self.odd |= {w for w, r, x in zip(words, raw, ids, strict=True) if b"".join([self.pieces[i] for i in x]) != r}
        packed, ends = flat.tobytes(), (ends * 4).tolist()
        return {w: packed[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; none where they do not give back its bytes."""
        split = WORD.split if self.by_word else lambda t: [t]
        words = [(t.split(" ") if self.by_word and "  " not in t and t[0] != " " and t[-1] != " " else split(t)) if t else [] for t in texts]
        every = set().union(*words)
        new = every - self.kept.keys()
        if len(self.kept) + len(new) > KEPT:
            self.kept, self.odd, new = {}, set(), every
        if new:
            self.kept |= self._learn(list(new))
        out = [b"".join(map(self.kept.__getitem__, ws)) for ws in words]
        if self.odd:
            for k, ws in enumerate(words):
                if not self.odd.isdisjoint(ws) and b"".join([self.pieces[i] for i in np.frombuffer(out[k], "<i4").tolist()]) != b" " + texts[k].encode():
                    out[k] = b""
        for w in [w for w in new if len(w) > LONGEST]:
            del self.kept[w]
            self.odd.discard(w)
        return out


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimals of 0 to n-1, the first digit in the lowest of eight bytes, and how many digits each has."""
    if n > 10**7:
        raise ValueError("ids of at most seven digits")
    text = np.array([b"%d" % k for k in range(n)], "S8")
    return text.view("<u8"), np.char.str_len(text)


class Aligner:
    """Aligns slices of documents inside a task."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.digits, self.widths = decimals(max(len(x.pieces) for x in (self.a, self.b)))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """Ids of A and packed ids of B of each text; none where their bytes are not those of space+text."""
        of_b = self.b.encode(texts)
        return [self.a.encode(" " + t) if ids else [] for t, ids in zip(texts, of_b, strict=True)], of_b

    def read(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], list[bytes]]:
        """Per text: n_a, n_b, n_groups, n_links; the digest of the groups; its different pairs, sorted (A id times the size of B
        plus B id, 8 bytes each), then how often each is linked (4 bytes each)."""
        of_a, of_b = self.encode(texts)
        n_a, n_b = np.array(list(map(len, of_a)), np.int64), np.array([len(p) // 4 for p in of_b], np.int64)
        a, b = np.fromiter(chain.from_iterable(of_a), "<i4", int(n_a.sum())), np.frombuffer(b"".join(of_b), "<i4")
        if not len(a):
            zero = np.zeros(len(texts), np.int64)
            return {"n_a": n_a, "n_b": n_b, "n_groups": zero, "n_links": zero}, [""] * len(texts), [b""] * len(texts)
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        total = int(ends_a[-1])
        ended = np.bincount(np.concatenate([ends_a, ends_b]), minlength=total + 1)
        stops = np.flatnonzero(ended)  # each ends a link
        cut = ended[stops] == 2  # and these a group
        at_a = np.zeros(total + 1, bool)
        at_a[ends_a] = True
        at_a = at_a[stops]
        at_b = cut | ~at_a
        doc_links = np.searchsorted(stops, np.concatenate([[0], ends_a])[np.cumsum(n_a)], "right")  # links up to each document's end
        groups = np.concatenate([[0], np.cumsum(cut)])
        n_groups, n_links = np.diff(groups[doc_links], prepend=0), np.diff(doc_links, prepend=0)
        # A link lies in the token that ends at its end or next behind it.
        ids_a, ids_b = a[np.cumsum(at_a) - at_a], b[np.cumsum(at_b) - at_b]
        pair = ids_a.astype(np.int64) * len(self.b.pieces) + ids_b
        key, many = np.unique(np.repeat(np.arange(len(texts)) << 40, n_links) | pair, return_counts=True)
        held_at = np.searchsorted(key, np.arange(len(texts) + 1) << 40)
        key, many = key & ((1 << 40) - 1), many.astype("<i4")
        held = [key[x:y].tobytes() + many[x:y].tobytes() for x, y in zip(held_at, held_at[1:], strict=False)]
        group = groups[1:] - cut  # of each link
        last_a, last_b = cut[at_a], cut[at_b]
        digests = self._digests(a, b, group[at_a], group[at_b], last_a, last_b, groups[doc_links], n_groups)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}, digests, held

    def _digests(self, a, b, group_a, group_b, last_a, last_b, groups, n_groups) -> list[str]:
        """SHA-256 of every document's groups as text: a group's A tokens, then its B tokens. ``groups`` are counted up to each
        document's end; the others tell the group of each token, and whether it is the last there."""
        many = int(groups[-1])
        in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        shown, widths = np.empty(len(a) + len(b), "<u8"), np.empty(len(a) + len(b), np.int64)
        for ids, place, last, mark in ((a, place_a, last_a, b"|"), (b, place_b, last_b, b";")):
            widths[place] = self.widths[ids] + 1
            shown[place] = self.digits[ids] | (np.where(last, mark[0], ord(",")).astype("<u8") << np.uint64(56))
        flat = shown.view(np.uint8)
        stops = np.cumsum(widths)[np.cumsum(in_a + in_b)[groups[n_groups > 0] - 1] - 1]
        stops = np.concatenate([[0], stops]).tolist()
        text, out, k = memoryview(flat[flat != 0].tobytes()), [], 0
        for n in n_groups.tolist():
            out.append(hashlib.sha256(text[stops[k] : stops[k + 1] - 1]).hexdigest() if n else "")
            k += n > 0
        return out


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """Kept for the worker's later tasks."""
    return Aligner(a, b)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most STEP_BYTES, or one longer row."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and held + n > STEP_BYTES:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(df: DataFrame, a: str = MODEL_A, b: str = MODEL_B, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256, pairs (packed, as ``Aligner.read`` says)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            for part in slices(batch, 1):
                numbers, digests, pairs = own.read(part.column(1).to_pylist())
                columns = [part.column(0), *(pa.array(numbers[n]) for n in NUMBERS), pa.array(digests, pa.string()), pa.array(pairs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *NUMBERS, "groups_sha256", "pairs"])

    source = df.select(key, text_of(text).alias("_text"))
    return source.mapInArrow(rows, f"{key} {dict(df.dtypes)[key]}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary")


def unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and their numbers of several documents, and how many each document has."""
    n = np.array([len(p) // 12 for p in packed], np.int64)
    keys = np.frombuffer(b"".join([p[: 8 * k] for p, k in zip(packed, n.tolist(), strict=True)]), "<i8")
    many = np.frombuffer(b"".join([p[8 * k :] for p, k in zip(packed, n.tolist(), strict=True)]), "<i4")
    return keys, many.astype(np.int64), n


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """a, b, n (links of the pair over all documents), best (no pair of this b has more)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, many = held.pop()
            return pa.RecordBatch.from_arrays([pa.array((keys // n_b).astype("i4")), pa.array((keys % n_b).astype("i4")), pa.array(many)], names=["a", "b", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                held.append(unpacked(batch.column(0).slice(at, 512).to_pylist())[:2])
                if sum(len(k) for k, _ in held) > HELD_PAIRS:
                    held[:] = [summed()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield out()
        if held:
            held[:] = [summed()]
            yield out()

    counts = written(found.select("pairs").mapInArrow(rows, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return written(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def blocks(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of A ids with at most ``most`` pairs each, or one id. The driver gets a number for each A id."""
    out: list[tuple[int, int]] = []
    held = 0
    for a, n in sorted((r["a"], r["n"]) for r in counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()):
        if out and held + n <= most:
            out[-1], held = (out[-1][0], a), held + n
        else:
            out.append((a, a))
            held = n
    return out


def linked(found: DataFrame, counts: DataFrame, n_b: int, most: int = PAIR_BLOCK) -> DataFrame:
    """Per ``row`` of ``found``: n_best and count_sum."""
    spark, parts = found.sparkSession, []
    for low, high in blocks(counts, most):
        block = counts.filter(F.col("a").between(low, high)).toArrow()
        keys = block["a"].to_numpy().astype(np.int64) * n_b + block["b"].to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], block["n"].to_numpy()[order], block["best"].to_numpy(zero_copy_only=False)[order]))

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, n, best = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    mine, many, sizes = unpacked(part.column(1).to_pylist())
                    place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    many = np.where(keys[place] == mine, many, 0)  # pairs of other blocks count there
                    ends = np.cumsum(sizes)
                    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (many * best[place], many * n[place])]
                    yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums)], names=["row", "n_best", "count_sum"])

        parts.append(written(found.select("row", "pairs").mapInArrow(rows, "row bigint, n_best bigint, count_sum bigint"), "linked"))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "row bigint, n_best bigint, count_sum bigint")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_documents(df: DataFrame, a: str = MODEL_A, b: str = MODEL_B, key: str = "doc_id", text: str = "text", pair_block: int = PAIR_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Every document's numbers, and the counts of all pairs (a, b, n, best)."""
    n_b = len(Pieces(b).pieces)
    found = written(aligned(df, a, b, key, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(found, n_b)
    out = found.drop("pairs").join(linked(found, counts, n_b, pair_block), "row", "left").drop("row")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in ("n_best", "count_sum")}), counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    out = aligned_documents(table(spark, sf_dir, "documents"))[0]
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *NUMBERS, "n_best", "count_sum", "groups_sha256")
