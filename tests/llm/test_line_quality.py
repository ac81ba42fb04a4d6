"""Line labelling: counts and decoding against plain versions, accuracy on labels that training does not see."""

import itertools
import random
import re

import numpy as np

from sieveworks.llm import line_quality
from sieveworks.llm.line_quality import FEATURES, Field

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in BLANK.split(text) if w]
    lines, copies = set(), 0
    for line in text.split("\n"):
        if any(BLANK.split(line)):
            copies += line in lines
            lines.add(line)
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    again = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(again), failed


def mixed(seed, n):
    r = random.Random(seed)
    words = ["a", "bé", "The", "#x", "1.", "日本", "\x1c", "\xa0", "don't", "|", "A!!"]
    return ["".join(r.choice([r.choice(words), r.choice(words), " ", "\n", "\t", "\r", "\n\n"]) for _ in range(r.randint(0, 90))) for _ in range(n)]


def test_counts_against_brute_force(spark):
    repeated = "one two three four five six seven eight nine "
    texts = [*mixed(3, 300), None, "", " \n ", "\n", repeated * 3, repeated * 40, "x " * 30, "same line\n" * 5, "a\r\na\r\na", "word " * 100_000]
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id bigint, text string, kept boolean").repartition(3)
    field = Field(np.eye(FEATURES)[0], np.zeros((2, 2)))
    out = line_quality.judged(df, field).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in (*line_quality.COUNTS, "base_failed")) for r in out] == [brute(t) for t in texts]
    assert all(r["kept"] == (not r["base_failed"]) and r["content_words"] == r["n_words"] for r in out)  # all lines are content


def test_decoding_against_all_labellings():
    r = np.random.default_rng(4)
    for _ in range(30):
        n = r.integers(1, 9)
        field = Field(r.normal(size=FEATURES), r.normal(size=(2, 2)))
        x, doc = r.normal(size=(2 * n, FEATURES)), np.repeat([0, 1], n)
        found = field.decode(x, doc)
        for d in (0, 1):
            gain = x[doc == d] @ field.weights
            score = lambda y: sum(g * k for g, k in zip(gain, y)) + sum(field.steps[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
            best = max(itertools.product((0, 1), repeat=int(n)), key=score)
            assert np.isclose(score(found[doc == d].astype(int).tolist()), score(best))


def test_gradient_against_differences():
    r = np.random.default_rng(2)
    x, mask = r.normal(size=(3, 5, FEATURES)), np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0]], bool)
    y = r.integers(0, 2, (3, 5)) * mask
    field = Field(r.normal(size=FEATURES), r.normal(size=(2, 2)))
    score, by_weight, by_step = line_quality.gradient(field, x, mask, y)
    assert score < 0
    for value, g in ((field.weights, by_weight), (field.steps, by_step)):
        for at in np.ndindex(*value.shape):
            value[at] += 1e-5
            up = line_quality.gradient(field, x, mask, y)[0]
            value[at] -= 2e-5
            down = line_quality.gradient(field, x, mask, y)[0]
            value[at] += 1e-5
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-4)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    field = line_quality.fit(docs, labels)
    known = labels.filter(line_quality.held_out(labels["doc_id"])).filter("quality is not null")
    rows = line_quality.judged(docs, field).join(known, "doc_id").select("kept", "quality").collect()
    bad, good = [r["kept"] for r in rows if r["quality"] == 0], [r["kept"] for r in rows if r["quality"] == 1]
    assert len(bad) > 50 and sum(bad) / len(bad) < 0.1 and sum(good) / len(good) > 0.9


def test_mixed_document_keeps_its_content_lines(spark):
    """Labels are of lines: marks of a shop do not spoil the prose around them."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    field = line_quality.fit(docs, labels)
    prose = [t for (t,) in docs.join(labels, "doc_id").filter("quality = 1").select("text").orderBy("doc_id").limit(3).collect()]
    noise = "WIN$$$ NOW### FREE&&& CALL*** CASH$$$ MORE### DEAL&&& FAST***"
    text = "\n".join([*prose[0].split("\n")[:8], noise, noise.lower(), *prose[1].split("\n")[:8]])
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    lines = line_quality.judged(df, field, spans=True).first()["lines"]
    place = [line for line in text.split("\n") if line.strip()].index(noise)
    assert lines[place : place + 2] == "00" and lines.count("1") >= len(lines) - 4


def test_no_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + " ".join(f"w{k}" for k in range(30))), (1, None), (None, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (9, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    field = line_quality.fit(docs, none)
    assert sorted((r["n_words"], r["kept"]) for r in line_quality.judged(docs, field).collect()) == [(0, False), (0, False), (33, True)]
    assert line_quality.judged(docs.limit(0), line_quality.fit(docs.limit(0), none.limit(0))).count() == 0
