import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from sieveworks.llm import registry, sentencepieces

from ..conftest import SF


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "sentencepieces"]
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES}


def test_all_operators_are_registered():
    dealt = [q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(dealt) == sorted(f"op{n}" for n in range(1, 14))
    assert {q.split("_")[0] for q in registry.LATER} == {"op11", "op12", "op13"}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.6 * docs.count() < out.count() < docs.count() and out.filter("not lossless").count() == 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.select("doc_id").distinct().count() == out.count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with documents, labels and benchmark; documents have further columns whose names operators use."""

    def make(rows, labels, items):
        docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in ("uid", "row", "node", "h", "leader", "score", "_salt", "ids"):
            docs = docs.selectExpr("*", f"'x' AS {name}")
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    width = min(5, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def test_stages_against_brute_force(spark, folder, prose):
    """Null, empty and repeated rows, ids that are missing or repeated, copies, test items, secrets and toxic texts."""
    rng, rows, labels, toxic = random.Random(3), [], [], set()
    for k in range(120):
        words = prose(rng.randrange(20, 60), k).split()
        if k % 3 == 0:
            toxic.add(k)
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("moron", "scum")))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k in toxic)))
    item = prose(14, 900)
    near = rows[1][1].split()
    near[3] = "changed"
    rows += [(200, rows[1][1]), (201, rows[1][1].upper()), (202, " ".join(near) + " " + prose(1, 5)), (None, rows[2][1]), (4, rows[4][1]), (4, rows[4][1])]
    rows += [(4, prose(30, 901)), (300, f"{prose(9, 1)} {item} {prose(9, 2)}"), (301, None), (302, ""), (302, ""), (303, "password=abcdefghijkl0123 " + prose(9, 7)), (None, prose(25, 902))]
    path = folder(rows, [*labels, (5, 1, None), (None, 1, 1), (10**6, 1, 1)], [(1, item), (2, None), (3, "too short")])
    left, seen = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if doc_id in toxic:
            continue
        own = shingles(text)
        if own and any(len(own & s) >= 0.8 * len(own | s) - 1e-9 for s in seen):
            continue
        seen.append(own)
        if not own & shingles(item) or len(own & shingles(item)) < 0.8 * len(shingles(item)):
            left.append((doc_id, re.sub("password=[a-z0-9]+", "[SECRET]", text or "")))
    out = corpus_pipeline.run(spark, path)
    vocabulary = sentencepieces.Vocabulary.read()
    got = [(r["doc_id"], vocabulary.decode(r["ids"]) if r["ids"] else "") for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, left)) and all(r["lossless"] for r in out.collect())


def test_empty_tables(spark, folder):
    path = folder([], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_warc_sql(spark):
    import duckdb

    own = sorted(map(tuple, registry.QUERIES["op1_warc"](spark, SF).collect()), key=str)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert own == sorted(connection.sql(registry.ORACLE_SQL["op1_warc"]).fetchall(), key=str)
