"""Every registered core query against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sieveworks import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(df: pd.DataFrame) -> list:
    return sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    own, other = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns) and rows(own) == rows(other)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())


def test_terms_count_wherever_they_stand(spark, tmp_path):
    """By brute force: a term after 300 characters of a text, and one after 80 of its first line."""
    texts = ["x " * 200 + "er nd thor", "x " * 50 + "thor\nx", "er x\n" + "x " * 200 + "nd", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def boost(text, full, every):
        found = sum(t in text for t in ("er", "nd", "thor"))
        return round(full * (every if found == 3 else 1) * found / 3, 6)

    for name, full, every, part in (("title_match_whole", 1.0, 1.5, lambda t: t.split("\n")[0]), ("content_match_whole", 0.4, 1.2, str)):
        got = {r["doc_id"]: r["boost"] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {k: boost(part(t), full, every) for k, t in enumerate(texts)}, name


def test_no_row_is_missing(spark):
    parts, docs = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("part", "documents"))
    for name in ("sort_override_numeric_all", "sort_override_string_all"):
        assert sorted(r["rank"] for r in registry.queries()[name](spark, SF).collect()) == list(range(1, parts + 1)), name
    assert registry.queries()["batch_score_all"](spark, SF).count() == 3 * docs


@pytest.mark.parametrize("name", ["batch_score_configs", "batch_score_top", "score_results_ordered", "score_results_page"])
def test_no_recency_after_the_day_of_asking(spark, tmp_path, name):
    """Ids from 3654 on stand for dates after 2026-01-01; the SQL of these queries has no recency."""
    texts = ["er nd thor", "er\nnd worthless", "the hend", "clown\nthor", "x"]
    spark.createDataFrame([(k, texts[k % 5]) for k in range(3600, 3900)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = registry.queries()[name](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as connection:
        connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        other = connection.sql(registry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns) and rows(own) == rows(other)
