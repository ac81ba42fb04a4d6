"""The alignment of two tokenizers against a version that walks token by token."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from sieveworks.llm import alignment


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.MODEL_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)


def tokens(a, b, text):
    """(ids, sizes) of A and of B by the public libraries, or nothing if the bytes differ."""
    letters = alignment.byte_of_letters()
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    raw = (" " + text).encode()
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    return x, list(accumulate(map(len, of_a))), y, list(accumulate(map(len, of_b)))


def brute(texts):
    a, b = libraries()
    every, counts = [], Counter()
    for text in texts:
        found = tokens(a, b, text)
        if found is None:
            every.append(None)
            continue
        x, ends_x, y, ends_y = found
        links, j = [], 0
        for i, end in enumerate(ends_x):
            begin = ends_x[i - 1] if i else 0
            while ends_y[j] <= begin:
                j += 1
            k = j
            while k < len(y) and (ends_y[k - 1] if k else 0) < end:
                links.append((x[i], y[k]))
                k += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_x) & set(ends_y)):
            p, q = ends_x.index(cut) + 1, ends_y.index(cut) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        every.append((len(x), len(y), groups, links))
        counts.update(links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (0,) * 6 + ("",) if e is None else (e[0], e[1], len(e[2]), len(e[3]), sum(counts[p] == most[p[1]] for p in e[3]), sum(counts[p] for p in e[3]), hashlib.sha256(";".join(e[2]).encode()).hexdigest())
        for e in every
    ]


ODD = ["", " ", "  ", "a ", " a", "a   b", "<|endoftext|> x", "\n", "x \n y", "a▁b c", "ab" * 900, "\x00", "é x", "ﬁ ½ ①", "don't we'll 12345", "日本語 😀😀", "a　 b\x85 c", " " * 1500 + "x", None]


def mixed(n):
    r = random.Random(5)
    letters = list(" \n\t  abcé'sll,.!▁0x\x1c\xa0　😀\rABß日'd'")
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 16))) for _ in range(n)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [alignment.PAIR_BLOCK, 400])
def test_against_brute_force(spark, block):
    texts = ODD + mixed(150) + ["the same text twice", "the same text twice"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, row int").repartition(5)
    out = alignment.aligned_documents(df, pair_block=block)[0].orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in out] == brute(texts)


def test_documents_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = df.collect()
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.op13_alignment(spark, sf_dir).collect()}
    assert [out[r["doc_id"]] for r in rows] == brute([r["text"] for r in rows])


def test_empty_table_and_texts_without_tokens(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.aligned_documents(df)[0].count() == 0
    df = spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id bigint, text string")
    rows = alignment.aligned_documents(df)[0].collect()
    assert len(rows) == 3 and all(tuple(r[c] for c in COLUMNS) == (0,) * 6 + ("",) for r in rows)


def test_long_text(spark):
    text = "wörd, and another one\n" * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = alignment.aligned_documents(df)[0].select("n_links", F.col("n_groups") > 0).first()
    assert row[0] > 0 and row[1]
