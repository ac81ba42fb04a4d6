import collections
import hashlib
import random

import numpy as np
import pytest

from sieveworks.llm import suffixes


def brute(rows, length, keep_first):
    """Marks each byte of each repeated window."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, count = set(), collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in ordered]
    for _, raw in raws:
        count.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen if keep_first else count[window] > 1:
                gone[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((str(i), len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def documents(prose):
    rng = random.Random(9)
    shared = [prose(120, 50 + k) for k in range(4)]
    rows = []
    for k in range(30):
        part = rng.choice(shared)
        cut = rng.randrange(len(part) - 420) if rng.random() < 0.7 else 0
        rows.append((k, prose(rng.randrange(40), k) + part[cut : cut + rng.randrange(300, 700)] + prose(rng.randrange(60), 99 + k)))
    base = prose(200, 7)
    for k in range(12):  # near copies: one letter differs
        at = rng.randrange(len(base))
        rows.append((100 + k, base[:at] + "Z" + base[at + 1 :]))
    rows += [(200, "ab" * 700), (201, "ü" * 450), (202, "x" * 399), (203, "x" * 400), (204, None), (205, ""), (206, prose(3, 1)), (207, (prose(12, 5) + "\n") * 30), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize(("keep_first", "crowd", "steps"), [(False, 4096, ()), (True, 4096, ()), (False, 3, (64, 16, 1)), (True, 3, (64, 16, 1)), (False, 1, (1,)), (True, 1, (16, 1))])
def test_removal(spark, frame, prose, monkeypatch, keep_first, crowd, steps):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "STEPS", steps)
    rows = documents(prose)
    out = suffixes.removed(frame(rows, extra=True), keep_first=keep_first).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(rows, 400, keep_first)


def test_repeated_rows_and_empty(spark, frame, prose):
    text = prose(200, 3)
    out = suffixes.removed(frame([(1, text), (1, text), (2, "short"), (2, "short")]), keep_first=False).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, len(text)), (1, len(text)), (2, 0), (2, 0)]
    assert suffixes.removed(frame([]), keep_first=False).count() == 0


def test_many_repeats_of_a_row_do_not_widen_its_spans(spark, frame, prose):
    text = prose(900, 3)
    sizes = []
    for n in (2, 300):
        docs = frame([(1, text)] * n + [(2, text[:900] + prose(90, 4))]).select("doc_id", "text").selectExpr("*", "xxhash64(text) AS h")
        taken = suffixes.spans(docs, 400, False)[1]
        sizes.append(sorted((r["doc_id"], len(r["taken"])) for r in taken.collect()))
    assert sizes[0] == sizes[1]
    out = suffixes.removed(frame([(1, text)] * 300), keep_first=False).collect()
    assert len(out) == 300 and {r["n_removed"] for r in out} == {len(text)}


def test_query_names_documents_with_planted_passages(spark, frame, prose, tmp_path):
    """Passages of over 50 words in documents that are otherwise different: those of 400 bytes or more show, shorter ones and clean documents do not."""
    long, short = prose(90, 500), " ".join(["ab"] * 30 + prose(30, 501).split())[:390]
    assert len(long) >= 400 > len(short) and len(short.split()) > 50 and len(long.split()) > 50
    rows = [(k, f"{prose(80, k)}. {(long, short, '')[k % 3]} {prose(60, 40 + k)}") for k in range(12)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = suffixes.op9_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["has_repeats"] for r in out} == {k: k % 3 == 0 for k, _ in rows}
    # What stands around a passage can agree by chance, which makes a run longer, never shorter.
    assert all((r["n_removed"] >= len(long)) == r["has_repeats"] and r["n_bytes"] == len(rows[r["doc_id"]][1]) for r in out)


def test_chunks_give_the_same_anchors(monkeypatch, prose):
    data = np.frombuffer(prose(900, 4).encode(), np.uint8)
    whole = {(k, p) for k, a, b in suffixes.anchors(data) for p in range(a, b + 1)}
    monkeypatch.setattr(suffixes, "CHUNK", 777)
    assert {(k, p) for k, a, b in suffixes.anchors(data) for p in range(a, b + 1)} == whole and len(whole) == len(data) - 399


def test_suffix_order(prose):
    data = np.frombuffer((prose(60, 1) * 2 + "aaaa" * 60).encode(), np.uint8)
    for length in (16, 21, 100):
        starts = np.arange(len(data) - length + 1)
        order = suffixes.suffix_order(data, starts, length)[0]
        raw = data.tobytes()
        assert [raw[p : p + length] for p in order] == sorted(raw[p : p + length] for p in starts)
        assert order.tolist() == sorted(starts.tolist(), key=lambda p: (raw[p : p + length], p))


def test_smaller_positions():
    rng = np.random.default_rng(2)
    for x in (rng.permutation(300), np.arange(50), np.arange(50)[::-1], np.array([0]), np.array([1, 0])):
        want = [max((k for k in range(i) if x[k] < x[i]), default=-1) for i in range(len(x))]
        assert suffixes.previous_smaller(x).tolist() == want


@pytest.mark.parametrize("length", [16, 21, 100])
def test_longest_previous_factor(prose, length):
    """Against all pairs of windows: the factor is exact up to the length, and the match it names has it."""
    a, b = prose(30, 1), prose(20, 2)
    data = np.frombuffer((a + b + a[:90] + "x" * 130 + b[20:] + a + "x" * 120).encode(), np.uint8)
    raw, starts = data.tobytes(), np.concatenate([np.arange(0, 150), np.arange(160, len(data) - length + 1)])
    factor, source = suffixes.longest_previous(data, starts, length)

    def common(p, q):
        return next((k for k in range(length) if raw[p + k] != raw[q + k]), length)

    for i, p in enumerate(starts):
        assert factor[i] == max((common(p, q) for q in starts[:i]), default=0)
        assert factor[i] == 0 or source[i] < i and common(p, starts[source[i]]) == factor[i]


@pytest.mark.parametrize("step", [64, 16, 1])
def test_parts_of_slices(prose, step):
    """Parts cover a slice's windows once, and equal windows of slices that share an anchor get equal keys."""
    rng, shared = random.Random(4), prose(200, 60)
    keys, slices = {}, 0
    for k in range(40):
        text = (prose(rng.randrange(30), k) + shared[: rng.randrange(300, 900)] + prose(rng.randrange(40), 99 + k)).encode()
        for key, first, last in suffixes.anchors(np.frombuffer(text, np.uint8)):
            data, covered = text[first : last + 400], []
            for own, a, b in suffixes.parts_of(data, 400, suffixes.GRAM, step):
                covered += range(a, b + 1)
                for w in range(a, b + 1):
                    assert keys.setdefault((key, data[w : w + 400]), own) == own
            assert sorted(covered) == list(range(last - first + 1))
            slices += 1
    assert len(keys) > 1000 and slices > 100
