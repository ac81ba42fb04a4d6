import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.llm import fingerprints as fp


def brute(rows):
    """Edited texts: rows of one id by Spark's hash, so only distinct ids are used here."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        out[i] = (len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_edited(spark, frame, n):
    rng = random.Random(n)
    parts = ["One. ", "zwei ü\n", "🇩🇪 three! ", "\n", "four? Five", "", " "]
    rows = [(None if n > 1 and k == 0 else k * 37 % 1009, None if k == 1 else "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for k in range(n)]
    out = {r["doc_id"]: r for r in fp.edited_neighbours(frame(rows, extra=True)).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in out.items()} == brute(rows)
    # The edited fingerprint comes from taking paragraphs out and putting others in: it must be that of the edited text.
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t) in enumerate(order[:8]):
        t, following = t or "", order[(k + 1) % n][1] or ""
        q = len(t) // 4
        text = t[: len(t) - q] + following[:q]
        whole = frame([(1, text)]).select(fp.as_hex(fp.fingerprint(F.col("text")))).first()[0]
        assert out[i]["edited_fingerprint"] == whole
        assert 0 <= out[i]["near_next"] <= 1 and (out[i]["near_edited"] == 1.0) == (out[i]["fingerprint"] == whole)


def test_multiset(spark, frame):
    df = frame([(1, "a\nb\nc"), (2, "c\na\nb"), (3, "a\nb"), (4, "a\nb\nb"), (5, "")]).withColumn("v", fp.fingerprint(F.col("text")))
    marks = {r["doc_id"]: r["v"] for r in df.collect()}
    assert marks[1] == marks[2] != marks[3] and len({tuple(v) for v in marks.values()}) == 4
    grown = df.select("doc_id", fp.inserted(F.col("v"), F.lit("c")).alias("i"), fp.deleted(F.col("v"), F.lit("b")).alias("d"))
    got = {r["doc_id"]: r for r in grown.collect()}
    assert got[3]["i"] == marks[1] and got[4]["d"] == marks[3]


def test_repeats_and_empty(spark, frame):
    out = fp.edited_neighbours(frame([(1, "one. two. three"), (1, "one. two. three"), (2, "xxxxxxxx")])).collect()
    assert len(out) == 3 and len({r["edited_sha256"] for r in out if r["doc_id"] == 1}) == 1
    assert fp.edited_neighbours(frame([])).count() == 0


def sentences(n, seed, end=". "):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(12)) + end for _ in range(n)]


@pytest.mark.parametrize("n", [100, 2000])
@pytest.mark.parametrize("end", [". ", "\n", " "])
def test_likeness_does_not_fall_with_length(spark, frame, n, end):
    """Each text keeps 75% in its edited text, also as one endless paragraph."""
    texts = ["".join(sentences(n, 10 * n + k, end)) for k in range(8)]
    out = fp.edited_neighbours(frame(enumerate(texts))).collect()
    near, far = ([r[c] for r in out] for c in ("near_edited", "near_next"))
    assert all(0.5 < x < 0.95 for x in near) and 0.65 < sum(near) / 8 < 0.85
    assert sum(far) / 8 < 0.2 and max(far) < min(near)


def test_likeness_of_near_copies(spark, frame):
    old, new = sentences(1000, 1), sentences(1000, 2)
    whole, changed = "".join(old), "".join(new[k] if k % 10 == 0 else s for k, s in enumerate(old))
    shifted, junk = "one more word " + " ".join(old).replace(". ", ""), "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20000))
    pairs = [(whole, changed, 0.9), (" ".join(old).replace(". ", ""), shifted, 1.0), (junk, "x" + junk[:15000] + junk[:5000][::-1], 0.75), ("a b " * 3000, "a b " * 2900, 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("want", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 0.15 and r["got"] < 1
    # Blank lines are no likeness.
    blank = frame([(1, "\n\n".join(old)), (2, "\n\n".join(new))]).agg(F.collect_list(fp.fingerprint(F.col("text"))).alias("v"))
    assert blank.select(fp.likeness(F.col("v")[0], F.col("v")[1])).first()[0] < 0.45


def test_inserted_texts_are_cut(spark):
    """A paragraph of several sentences goes in and out as it would as part of the text."""
    from pyspark.sql import functions as F

    from sieveworks.llm import fingerprints as fp

    df = spark.createDataFrame([("First one.\nSecond", "One. Two! Three"), ("", "a\nb"), ("x. y", "")], "t string, p string")
    whole = fp.fingerprint(F.concat("t", F.lit("\n"), "p"))
    put, taken = fp.inserted(fp.fingerprint(F.col("t")), F.col("p")), fp.deleted(whole, F.col("p"))
    for row in df.select((put == whole).alias("a"), (taken == fp.fingerprint(F.col("t"))).alias("b"), (fp.fingerprint(F.lit("One. Two")) == fp.fingerprint(F.lit("One.\nTwo"))).alias("c")).collect():
        assert tuple(row) == (True, True, True)
