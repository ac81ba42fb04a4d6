import math

import pytest
from pyspark.sql import functions as F

from sieveworks.config import PriorityPage, ScoringConfig
from sieveworks.functions import dates, relevance
from sieveworks.operators import score

QUIET = ScoringConfig(recency_strategy="none")


def ages(spark, config, days):
    return [r[0] for r in spark.createDataFrame([(float(d),) for d in days], "d double").select(dates.recency_of_age(F.col("d"), config)).collect()]


@pytest.mark.parametrize(
    ("config", "days", "expected"),
    [
        (ScoringConfig(), [0, 365, 730, 1825, 2190, 3650, 4015, 9125], [0.5, 0.25, 0.125, 0, -0.05, -0.25, -0.3, -0.3]),
        (ScoringConfig(recency_half_life_days=30, recency_boost_max=1.0), [30, 60], [0.5, 0.25]),
        (ScoringConfig(recency_half_life_days=0), [0, 5000], [0, 0]),
        (ScoringConfig(recency_strategy="linear"), [0, 1825, 2190], [0.5, 0, -0.05]),
        (ScoringConfig(recency_strategy="step"), [1, 364, 365, 366], [0.5, 0.5, 0, 0]),
        (ScoringConfig(recency_strategy="custom", recency_curve=((0.0, 1.0), (365.0, 0.5), (730.0, 0.0))), [0, 182.5, 365, 547.5, 730, 1000], [1, 0.75, 0.5, 0.25, 0, 0]),
        (ScoringConfig(recency_strategy="custom", recency_curve=((10.0, 0.7),)), [0, 10, 99], [0.7] * 3),
        (ScoringConfig(recency_strategy="custom"), [1], [0]),
        (ScoringConfig(recency_strategy="odd"), [365], [0.25]),
    ],
)
def test_recency(spark, config, days, expected):
    assert ages(spark, config, days) == pytest.approx(expected, abs=1e-12)


def test_dates(spark):
    cases = {"2026-01-05": "2026-01-05", "2026-1-5": "2026-01-05", "2025-02-31": "2025-03-03", "2026-13-01": None, "2026-01-05T00:00": None, "0-1-1": None, "": None, "+2026-+1-5": "2026-01-05", "99999999999-1-1": None, "2026-01": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", dates.parse_date(F.col("t")).cast("string")).collect()
    assert {r[0]: r[1] for r in rows} == cases
    boost = spark.createDataFrame([("2999-12-31",), ("x",), ("2025-01-01",)], "t string").select(dates.recency_boost(F.col("t"), QUIET, "2026-01-01"))
    assert [r[0] for r in boost.collect()] == [0.5, 0.0, 0.0]


def test_phrase(spark):
    cases = [([], 2, 1.0), ([5], 3, 1.0), ([5], 1, 1.0), ([5, 5, 5, 5], 2, 2.5), ([10, 11], 2, 2.5), ([10, 11, 12], 3, 2.5), ([10, 12], 2, 1.5), ([10, 15], 2, 1.5), ([10, 16], 2, 1.0), ([50, 10, 30, 11], 2, 2.5), ([2**32 - 2, 2**32 - 1], 2, 2.5)]
    for at, n, expected in cases:
        df = spark.createDataFrame([(at,)], "at array<bigint>")
        assert df.select(relevance.phrase_multiplier(["w"] * n, F.col("at"), ScoringConfig())).first()[0] == expected, (at, n)
        assert df.select(relevance.phrase_multiplier(F.array(*[F.lit("w")] * n), F.col("at"), ScoringConfig())).first()[0] == expected, (at, n)


def test_matches(spark):
    df = spark.createDataFrame([("Hello World Page",), ("Hello there",), (None,)], "t string")
    for terms in (["hello", "world"], F.array(F.lit("hello"), F.lit("world"))):
        assert [r[0] for r in df.select(relevance.title_match(terms, F.col("t"), ScoringConfig())).collect()] == [1.5, 0.5, 0.0]
    assert [r[0] for r in df.select(relevance.content_match(["hello", "world"], F.col("t"), ScoringConfig())).collect()] == pytest.approx([0.48, 0.2, 0])
    assert df.select(relevance.title_match([], F.col("t"), ScoringConfig())).first()[0] == 0.0


def rows(spark, *data):
    return spark.createDataFrame(list(data), "url string, title string, excerpt string, date string, score double, locations array<bigint>, price string, pos int")


def test_composite(spark):
    df = rows(
        spark, ("/a", "Ferry Harbour Timetable", "ferry harbour hours", "", None, None, "12.5", 0), ("/b", "Tickets", "fares and zones", "", 0.0, None, "7", 1),
        ("/c", "Winter Ferry", "ice", "", -3.0, None, "11", 2), ("/d", "Moon", "winter tide", "", None, [0, 1], None, 3),
    )
    out = {r["url"]: r["score"] for r in score.score_results(df, "ferry harbour", QUIET).collect()}
    assert out == pytest.approx({"/a": 2.98, "/b": 1.0, "/c": 1.5, "/d": 1.0})
    out = [(r["url"], r["score"]) for r in score.score_results(df, "winter tide", QUIET).collect()]
    assert [u for u, _ in out] == ["/d", "/c", "/a", "/b"] and [s for _, s in out] == pytest.approx([2.2, 1.5, 1, 1])
    assert score.score_results(df, "x1", QUIET, primary_query="winter").filter("url = '/c'").first()["score"] == 2.0
    assert [r["url"] for r in score.score_results(df, "zz", QUIET, sort_field="price").collect()] == ["/b", "/c", "/a"]
    assert [r["url"] for r in score.score_results(df, "zz", QUIET, sort_field="price", direction="desc").collect()] == ["/a", "/c", "/b"]
    assert score.score_results(df, "zz", QUIET, sort_field="title").count() == 0
    assert [r["url"] for r in score.score_results(df, "zz", QUIET, limit=2, offset=1).collect()] == ["/b", "/c"]


def test_priority_pages(spark):
    pages = (PriorityPage("/a", ("PRICE",), 0.5, "own words zz1"), PriorityPage("a", ("price",), 0.25, "later"), PriorityPage("/A", ("price",), 7.0))
    df = rows(spark, ("/a", "t", "e", "", None, None, None, 0))
    for terms in ("price zz1", "Price zz1"):
        out = score.score_results(df, terms, ScoringConfig(recency_strategy="none", priority_pages=pages)).first()
        assert out["excerpt"] == "own words zz1" and out["score"] == pytest.approx(1 + 0.4 / 2 + 0.75)
    assert score.match_priority_pages(score.pages_frame(spark, pages), "x").count() == 0


def test_batch(spark):
    asked = spark.createDataFrame([(1, "hello world", None), (2, "hello", "flat")], "query_id int, query string, config_name string")
    base = rows(spark, ("/a", "Hello World", "x", "", None, None, None, 0), ("/b", "x", "hello", "", None, None, None, 1))
    results = base.crossJoin(spark.createDataFrame([(1,), (2,)], "query_id int"))
    out = score.batch_score_results(asked, results, QUIET, {"flat": ScoringConfig(recency_strategy="none", title_match_boost=0.0)}, top=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["url"], round(r["score"], 6)) for r in out] == [(1, "/a", 2.5), (1, "/b", 1.2), (2, "/b", 1.4), (2, "/a", 1.0)]


def test_plans(spark):
    df = rows(spark, ("/a", "t", "e", "", None, None, None, 0))
    plan = score.scored(df, "hello world", ScoringConfig())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and math.isfinite(len(plan))
