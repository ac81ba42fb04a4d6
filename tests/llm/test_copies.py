import collections
import random
import re

import pytest

from sieveworks.llm import decontamination as dc, graph, jaccard


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_copies(prose, families=6, size=9):
    rng, rows = random.Random(8), []
    for f in range(families):
        words = prose(80, f).split()
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows += [rows[0], rows[1].upper(), "", None, "...", "two words", "Two, words!", prose(40, 99)]
    return list(enumerate(rows))


@pytest.mark.parametrize(("small", "block", "most"), [(32, 256, 1 << 20), (2, 256, 1 << 20), (2, 4, 1 << 20), (2, 256, 200)])
def test_join(spark, frame, prose, monkeypatch, small, block, most):
    """Small buckets, families in one block and families over many blocks all find what comparing all pairs finds."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", most)
    rows = near_copies(prose)
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    links, root = collections.Counter(x for e in edges for x in e), roots(sets, edges)
    out = jaccard.classes(frame([*rows, (None, rows[0][1])], extra=True)).collect()
    assert len(out) == len(rows) + 1 and [(r["class_id"], r["n_links"]) for r in out if r["doc_id"] is None] == [(None, 0)]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out if r["doc_id"] is not None} == {i: (root[i], links[i]) for i in sets}


def test_deduplicated(spark, frame, prose):
    """One row of each class stays, with or without an id; a row without one is a copy like any other."""
    rows = near_copies(prose, 2, 4)
    df = frame([*rows, (None, rows[0][1]), (None, prose(30, 5)), (None, prose(30, 5))], extra=True)
    kept = jaccard.deduplicated(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and {0, 10, 11, 12} <= set(ids) and 8 not in ids and jaccard.classes(frame([])).count() == 0
    assert ids.count(None) == 1 and len(ids) == len(set(ids)) and jaccard.deduplicated(frame([])).count() == 0


def test_deduplicated_by_row(spark, frame, prose):
    """Rows that repeat an id are judged one by one: repeats go, other texts stay."""
    a, b, c = (prose(30, k) for k in range(3))
    left = lambda rows: sorted((r["doc_id"], r["text"]) for r in jaccard.deduplicated(frame(rows)).collect())
    assert left([(1, a), (1, a), (5, b)]) == [(1, a), (5, b)]
    assert left([(1, a), (2, a), (2, c)]) == [(1, a), (2, c)]
    assert left([(3, ""), (3, "")]) == [(3, ""), (3, "")]


def test_recall_of_bands():
    bands = jaccard.bands_for()
    assert 1 - (1 - 0.8**jaccard.ROWS) ** bands >= 0.9999 > 1 - (1 - 0.8**jaccard.ROWS) ** (bands - 1)


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"path": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 300)] + [(500, 501)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]}[kind]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    out = graph.components(spark.createDataFrame(edges, "u long, v long"), "t")
    assert {(r["node"], r["root"]) for r in out.collect()} == set(roots(nodes, [e for e in edges if e[0] != e[1]]).items())


def test_families_need_no_rounds(spark, monkeypatch):
    """Cliques and stars over several tasks are settled by the contraction alone; a chain cut into its edges goes on in rounds."""
    rounds = []
    monkeypatch.setattr(graph, "with_leader", lambda *a, own=graph.with_leader: rounds.append(a) or own(*a))
    edges = [(a, b) for f in range(8) for a in range(20 * f, 20 * f + 12) for b in range(20 * f, a)] + [(500 + k, 400) for k in range(300)]
    random.Random(5).shuffle(edges)
    out = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7), "t").collect()
    assert {(r["node"], r["root"]) for r in out} == set(roots({n for e in edges for n in e}, edges).items()) and not rounds
    monkeypatch.setattr(graph, "EDGES", 1)
    monkeypatch.setattr(graph, "contracted", lambda e: e.select(graph.F.greatest("u", "v").alias("u"), graph.F.least("u", "v").alias("v")))
    edges = [(k, k + 1) for k in range(40)]
    out = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7), "t").collect()
    assert {(r["node"], r["root"]) for r in out} == {(k, 0) for k in range(41)} and rounds


def test_contraction_in_slices(spark, monkeypatch):
    """Edges of binary nodes in slices keep their components, and no slice yields more edges than it has nodes."""
    rng = random.Random(6)
    edges = [(b"%03d" % rng.randrange(200), b"%03d" % rng.randrange(200)) for _ in range(400)]
    edges = [e for e in edges if e[0] != e[1]]
    monkeypatch.setattr(graph, "EDGES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        out = [(bytes(u), bytes(v)) for u, v in graph.contracted(spark.createDataFrame(edges, "u binary, v binary")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nodes = {n for e in edges for n in e}
    assert all(u > v for u, v in out) and len(out) < len(edges) and roots(nodes, out) == roots(nodes, edges)


def test_containment(spark, frame, prose, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng.choice([5, 6, 12, 30, 60]), 1000 + k)) for k in range(40)] + [(50, ""), (51, None), (52, "only four words here"), (53, prose(20, 1000)), (None, prose(30, 77))]
    docs = []
    for k in range(80):
        words = prose(rng.choice([3, 50, 3000]), k).split()
        for item in rng.sample(items, 2):
            part = (item[1] or "").split()
            if len(part) > 12 and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((k, " ".join(words)))
    docs += [(200, ""), (201, None), (None, docs[0][1]), (0, docs[0][1])]
    first = docs[3][1].split()
    items += [(60, " ".join(first[:2])), (61, first[4].upper() + "!"), (62, " ".join(first[:4])), (63, first[4]), (64, " ".join(first[3:1:-1])), (65, "...")]
    want = collections.Counter()
    words_of = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda t, n: {tuple(w[j : j + n]) for w in [words_of(t)] for j in range(len(w) - n + 1)}
    of_item = [(i, n, grams(t, n)) for i, t in items for n in [min(5, len(words_of(t)))] if n]
    for d, t in docs:
        have = {n: grams(t, n) for n in range(1, 6)}
        want.update((d, i, round(len(q & have[n]) / len(q), 6)) for i, n, q in of_item if len(q & have[n]) >= 0.8 * len(q) - 1e-9)
    assert {60, 61, 62, 63} <= {i for _, i, _ in want}
    df, test = frame(docs, extra=True), spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK_SHINGLES, 60):
        monkeypatch.setattr(dc, "BLOCK_SHINGLES", block)
        got = collections.Counter((r["doc_id"], r["item_id"], round(r["containment"], 6)) for r in dc.search(df, test).collect())
        assert got == want and len(want) > 60
    clean = dc.decontaminated(df, test)
    short = {i for i, n, _ in of_item if n < 5}  # they condemn no document
    bad = {d for d, i, _ in want if i not in short}
    assert clean.columns == df.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert dc.search(frame([]), test).count() == 0 and dc.search(df, test.limit(0)).count() == 0


def test_signature_recall():
    """The bound on missed items holds for the bins that are chosen."""
    import numpy as np

    rng, missed = np.random.default_rng(1), 0
    for _ in range(300):
        doc = np.unique(rng.integers(0, 2**63, 5000, np.uint64) * np.uint64(2))
        common = rng.choice(doc, 8, replace=False)
        bits = dc.bin_bits(int(len(doc) - 1).bit_length(), 8)
        missed += not np.isin(common, dc.signature(doc, bits)).any()
    assert missed == 0
