import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from sieveworks.llm import language_model as lm, toxicity as tx

UNITS = lm.CLASSES * lm.PER_CLASS


def test_gradient():
    """Backpropagation against differences."""
    rng = np.random.default_rng(1)
    net = lm.Network.begin(rng.integers(1, 9, lm.CLASSES * lm.PER_CLASS).astype(float))
    net.flat[:] += rng.normal(0, 0.3, len(net.flat))
    units, targets = rng.integers(0, UNITS, (6, 5)), rng.integers(0, UNITS, (6, 5))
    weight, fresh = np.ones((6, 5), "f4"), rng.integers(0, 2, (6, 5)).astype("f4")
    weight[4, 2] = 0
    h = rng.normal(0, 0.5, (5, lm.HIDDEN)).astype("f4")
    slope, after = net.gradient(units, targets, weight, fresh, h)
    strong = np.argsort(-np.abs(slope))[:: max(1, (slope != 0).sum() // 40)][:40]
    for k in strong:
        values = []
        for step in (1e-2, -1e-2):
            moved = lm.Network(net.flat.copy())
            moved.flat[k] += step
            states = moved.forward(units, fresh, h)[0].reshape(-1, lm.HIDDEN)
            values.append(-float((moved.log_probs(states, targets.ravel()) * weight.ravel()).sum()))
        assert (values[0] - values[1]) / 2e-2 / weight.sum() == pytest.approx(slope[k], rel=0.05, abs=3e-4)
    assert after.shape == h.shape


def test_scores_are_those_of_one_long_run():
    rng = np.random.default_rng(2)
    net = lm.Network.begin(np.ones(UNITS))
    net.flat[:] += rng.normal(0, 0.3, len(net.flat))
    documents = [rng.integers(0, UNITS, n).astype(np.int32) for n in (1, 200, 33, 32, 64, 1, 77)]
    got = lm.score_block(net, documents)
    for document, score in zip(documents, got, strict=True):
        h, last, total = np.zeros((1, lm.HIDDEN), "f4"), lm.TAILS, 0.0
        for unit in document:
            h = net.step(np.array([last]), h)[0]
            total += float(net.log_probs(h, np.array([unit]))[0])
            last = unit
        assert total == pytest.approx(score, rel=1e-4)
    h = rng.normal(0, 1, (1, lm.HIDDEN)).astype("f4")
    assert np.exp(net.log_probs(np.repeat(h, UNITS, 0), np.arange(UNITS))).sum() == pytest.approx(1, rel=1e-3)


def text(rng, n):
    """Two languages; the next word depends on the one before."""
    own = ["ba", "be", "bi", "bo."] if rng.random() < 0.5 else ["ka", "ke", "ki", "ko,"]
    at, out = 0, []
    for _ in range(n):
        at = (at + 1) % 4 if rng.random() < 0.8 else rng.randrange(4)
        out.append(own[at] if rng.random() < 0.95 else f"rare{rng.randrange(500)}")
    return " ".join(out)


@pytest.mark.parametrize(("head", "long"), [(60, 1 << 22), (0, 0)])
def test_language_model(spark, frame, monkeypatch, head, long):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "LONG_BYTES", long)
    rng = random.Random(1)
    rows = [(k, text(rng, rng.randrange(1, 120))) for k in range(400)] + [(900, None), (901, ""), (902, "NEW \x0bÄB\tnew"), (None, "ba be"), (3, "x" * 200), (903, "   ")]
    out = collections.defaultdict(list)
    for r in lm.score(frame(rows, extra=True)).collect():
        out[r["doc_id"]].append(r)
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert sum(map(len, out.values())) == len(rows)
    own = base = 0.0
    for i, t in rows:
        w = words(t)
        r = min(out[i], key=lambda r: abs(r["n_tokens"] - len(w)) + 1e-6 * abs(r["base_score"] - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, held(i))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        own, base = own + held(i) * r["score"], base + held(i) * r["base_score"]
    assert head == 0 or own > 0.85 * base


def test_end_counts_where_the_head_is_tiny(spark, frame, monkeypatch):
    """Few long documents of tokens that are as rare as the end."""
    monkeypatch.setattr(lm, "HEAD", 2)
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 7 != 2][:2]
    for texts in (["a b c d e f a b c d e f"], [" ".join(f"w{k}" for k in range(300)), "-" * 100 + " w1 " + "-" * 100]):
        rows = list(zip(ids, texts, strict=False))
        counts = collections.Counter(w for _, t in rows for w in [*t.split(), ""])
        n, v = sum(counts.values()), len(counts)
        for r in lm.score(frame(rows)).collect():
            w = [*dict(rows)[r["doc_id"]].split(), ""]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), len(w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))


def test_head_takes_frequent_long_tokens(spark):
    counts = spark.createDataFrame([(b"", 2, 9), (b"a", 0, 50), (b"b", 0, 1), (b"-" * 100, 1, 40), (b"=" * 100, 1, 1)], "token binary, tail int, c long")
    assert {bytes(r["token"]) for r in lm.head_of(counts).collect()} == {b"", b"a", b"b", b"-" * 100, b"=" * 100}


def test_language_model_without_rows(spark, frame):
    assert lm.score(frame([])).count() == 0
    only = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = lm.score(frame([(only, "a b")])).first()
    assert (row["held_out"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 0, 0, 0.0) and row["score"] < 0


def corpus(prose):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        words, toxic = prose(rng.randrange(5, 80), k).split(), rng.random() < 0.2
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "vile" + rng.choice("abcdef") * 2]))
        if not toxic and rng.random() < 0.2:
            words.append("vile")
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark, frame, prose):
    rows, labels = corpus(prose)
    table = spark.createDataFrame([*[(k, 1, t) for k, t in labels], (5, 1, None), (None, 1, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    classifier = tx.fit(frame(rows, extra=True), table)
    out = {r["doc_id"]: r for r in tx.scored(frame([*rows, (5000, None), (5001, ""), (None, "you moron scum")]), classifier).collect()}
    wrong = sum(out[k]["predicted"] != t for k, t in labels if out[k]["held_out"])
    n = sum(out[k]["held_out"] for k, _ in labels)
    assert n > 120 and wrong <= 0.03 * n and all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in labels)
    assert out[5000]["score"] == out[5001]["score"] < 0.5 <= out[None]["score"] <= 1
    kept = tx.kept(frame([(1, "you moron scum"), (2, "abc"), (3, None)], extra=True), classifier)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3} and "score" in kept.columns


def test_toxicity_without_labels(spark, frame):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.scored(frame([(1, "a")]), tx.fit(frame([(1, "a")]), empty)).first()["predicted"] == 0
    assert tx.scored(frame([]), tx.fit(frame([]), empty)).count() == 0


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    vote = lambda accuracy, share: np.where(rng.random(4000) < share, np.where(rng.random(4000) < accuracy, truth, ~truth), -1).astype("i1")
    first = vote(0.7, 0.9)
    ballots = np.stack([first, first, first, vote(0.9, 0.8), vote(0.85, 0.8)], 1)
    gold = np.where(rng.random(4000) < 0.97, truth, ~truth).astype("i1")
    model = tx.LabelModel.fit(ballots, gold)
    right = model.rates[:, 1, 2] / (model.rates[:, 1, 2] + model.rates[:, 1, 1])
    assert right[3] == pytest.approx(0.9, abs=0.06) and right[0] == pytest.approx(0.7, abs=0.06)
    assert model.right == pytest.approx((0.97, 0.97), abs=0.02)
    # Of three voters that say the same, two depend on another and add nothing.
    repeats = [j for j in range(3) if model.parent[j] in range(3)]
    assert len(repeats) == 2 and all(abs(model.gain[j, v + 1, v + 1]) < 0.05 for j in repeats for v in (-1, 0, 1))
    assert ((model.belief(ballots, gold) > 0.5) == truth).mean() > 0.96
    once = tx.LabelModel.fit(ballots[:, 2:], gold)
    assert np.abs(once.belief(ballots[:, 2:]) - model.belief(ballots)).max() < 0.05


def test_posterior_leaves_wrong_labels():
    """Where most voters disagree with a label the posterior goes with them."""
    rng = np.random.default_rng(6)
    truth = rng.random(3000) < 0.2
    ballots = np.stack([np.where(rng.random(3000) < 0.9, truth, ~truth).astype("i1") for _ in range(9)], 1)
    wrong = rng.random(3000) < 0.05
    gold = (truth ^ wrong).astype("i1")
    found = tx.LabelModel.fit(ballots, gold).belief(ballots) > 0.5
    assert (found != truth).mean() < 0.01 < 0.04 < (found != (gold > 0)).mean()


def test_fit_widens_no_input_as_a_whole():
    """Beside the inputs of the classifier, of 16 MB, and the votes, of 6 MB, the driver holds slices only."""
    rng = np.random.default_rng(1)
    counts, ballots = rng.poisson(0.1, (16_000, 256)).astype("f4"), rng.integers(-1, 2, (16_000, 33)).astype("i1")
    gold = (counts[:, 0] > 0).astype("i1")
    sizes = []
    for run in (lambda: tx.Classifier.fit(["x"] * 256, counts, gold * 0.98 + 0.01, steps=2), lambda: tx.LabelModel.fit(ballots, gold, rounds=1)):
        tracemalloc.start()
        run()
        sizes.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert sizes[0] < 26 and sizes[1] < 16
