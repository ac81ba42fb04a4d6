"""Phrase collocations against a version that counts strings."""

import random
import re
from collections import Counter

import duckdb
import pytest

from sieveworks.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=None):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    hidden = set()
    for (lang, words), a in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if 100 * a >= 80 * f[part]:
                    hidden.add(part)
    out = {}
    for (lang, words), a in frequent.items():
        if (lang, words) not in hidden:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, found in out.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(found)[:top], 1)}


def read(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def texts(seed, n=300):
    r = random.Random(seed)
    words = ["the", "of", "A", "é", "nd.", "x-y", "#", "of the", "in a big old", "new york", "\t", "  ", "\n", "\x0b", "thing!", " ", "日本"]
    weights = [r.random() ** 2 for _ in words]
    return [(r.choice(["en", "de", None, ""]), " ".join(r.choices(words, weights, k=r.randint(0, 30)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = [*texts(seed), ("en", None), ("en", ""), (None, "x " * 500), ("en", "left out " * 400)]
    df = spark.createDataFrame([(k, *r, 1, 1) for k, r in enumerate(rows)], "doc_id int, lang string, text string, level int, h int").repartition(6)
    expected = brute(rows, 30)
    assert len(expected) > 10 and {len(p[2].split()) for p in expected} >= {2, 4}
    assert read(collocations.collocations(df, top=10**6)) == expected
    assert {tuple(r) for r in collocations.collocations(df, top=None).collect()} == {(e[0], *e[2:]) for e in expected}


def test_merging_in_steps_and_full_bitmaps(monkeypatch):
    """Tasks import their own limits, so what they do is driven here by hand."""
    monkeypatch.setattr(collocations, "MERGED", 5)
    import numpy as np

    r = np.random.default_rng(1)
    path = [r.integers(0, 4, 400).astype(np.uint64) for _ in range(3)]
    whole = collocations.summed(path, np.ones(400, np.int64))
    own = collocations.Merge(3)
    for a in range(0, 400, 7):
        p, n = collocations.summed([x[a : a + 7] for x in path], np.ones(len(path[0][a : a + 7]), np.int64))
        own.add(b"".join([*(x.tobytes() for x in p), n.tobytes()]))
    p, n = own.done()
    assert all((x == y).all() for x, y in zip(p, whole[0], strict=True)) and (n == whole[1]).all()
    full = np.full(1 << 23, 255, np.uint8)
    assert collocations.marked(full, np.array([0, 2**64 - 1], np.uint64), 26).all()


def test_shared_hashes_are_told(spark, monkeypatch):
    rows = spark.createDataFrame([("en", "w", 7, 40), ("en", "v", 7, 1)], "lang string, word string, h bigint, n bigint")
    fine = spark.createDataFrame([("en", "w", 7, 40), ("en", "v", 8, 1)], "lang string, word string, h bigint, n bigint")
    monkeypatch.setattr(collocations, "word_counts", lambda texts, seed: rows if seed < 2 else fine)
    assert collocations.frequent_words(rows, 30)[2] == 2
    monkeypatch.setattr(collocations, "word_counts", lambda texts, seed: rows)
    with pytest.raises(RuntimeError):
        collocations.frequent_words(rows, 30)


def test_exact_scores_and_ties(spark):
    """Equal scores go by occurrences, then by bytes; cuts of equal scores to the first."""
    rows = [("en", "b a, a b. " * 50), ("en", "é z\n" * 50), ("en", "p q r s\n" * 31)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert read(collocations.collocations(df, top=3)) == brute(rows, 30, 3)


def test_empty_table_and_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two")], "lang string, text string")).count() == 0


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.sql(collocations.OP12_SQL)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert read(collocations.op12_collocations(spark, sf_dir)) == set(found.fetchall())
