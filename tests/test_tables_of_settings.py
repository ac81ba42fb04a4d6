"""Settings, patterns and pages as tables, against the same done one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.config import PriorityPage, ScoringConfig
from sieveworks.operators import configs, patterns, score

ODD = {
    "plain": ScoringConfig(),
    "far": ScoringConfig(recency_boost_max=7.25, recency_half_life_days=0, recency_max_penalty=-0.5, results_per_page=0, max_pagefind_results=501),
    "tiny": ScoringConfig(recency_boost_max=-0.00002, recency_max_penalty=2e20, recency_half_life_days=9999),
    "large": ScoringConfig(recency_boost_max=123456789.5, recency_max_penalty=-0.0005),
    "strange": ScoringConfig(recency_strategy="weekly", language="de", custom_stop_words=("Haus",)),
    "bare": ScoringConfig(recency_strategy="custom"),
    "falling": ScoringConfig(recency_strategy="custom", recency_curve=((10.0, 1.0), (5.0, 0.5), (5.0, 0.25))),
    "curved": ScoringConfig(recency_strategy="custom", recency_curve=((0.0, 1.0), (100.0, 0.25), (3000.0, 0.0))),
    "linear": ScoringConfig(recency_strategy="linear", recency_penalty_after_days=0, title_match_boost=3.0),
    "step": ScoringConfig(recency_strategy="step", phrase_near_window=1, phrase_adjacent_multiplier=9.0, content_match_boost=1.5),
    "none": ScoringConfig(recency_strategy="none", priority_pages=(PriorityPage("/a", ("HELLO",), 0.5), PriorityPage("a", ("hello", "zz"), 0.25, "shown"), PriorityPage("", ("",), 0.125, "later"))),
    "unlucky": ScoringConfig(recency_half_life_days=0),
}


def test_validated_equals_clamped(spark):
    out = {r["config_name"]: r for r in configs.validated(configs.configs_frame(spark, ODD)).collect()}
    for name, config in ODD.items():
        moved, warnings = config.clamped()
        row = out[name]
        assert configs.warnings_of(row) == warnings, name
        shown = configs.values_of(moved)
        assert [row[n] if not isinstance(row[n], list) else [tuple(x) if not isinstance(x, str) else x for x in row[n]] for n in configs.SETTINGS] == list(shown), name


def test_what_is_missing_takes_its_default(spark):
    df = spark.createDataFrame([("a", None, -5, None), ("b", 9.0, 3, ["x"])], "config_name string, title_match_boost double, results_per_page int, custom_stop_words array<string>")
    rows = {r["config_name"]: r for r in configs.validated(df.withColumn("kept", F.lit(1))).collect()}
    usual = ScoringConfig()
    assert rows["a"]["title_match_boost"] == usual.title_match_boost and rows["a"]["results_per_page"] == usual.results_per_page and rows["a"]["custom_stop_words"] == []
    assert (rows["b"]["title_match_boost"], rows["b"]["results_per_page"], rows["b"]["custom_stop_words"], rows["b"]["language"], rows["b"]["kept"]) == (9.0, 3, ["x"], "en", 1)


def test_scores_by_table_equal_scores_one_by_one(spark):
    days = ("2026-05-01", "2025-12-30", "2024-01-01", "2015-01-01", "never", None)
    data = [(f"/{c}{k}", t, e, d, None, p, k) for k, (c, t, e, d, p) in enumerate((c, t, e, d, p) for c in "ab" for t, e in (("Hello World", "das Haus"), ("x", "hello haus world")) for d in days for p in ([3, 4], None))]
    results = spark.createDataFrame(data, "url string, title string, excerpt string, date string, score double, locations array<bigint>, pos int")
    queries = [(k, q, name) for k, (q, name) in enumerate((q, n) for q in ("hello world", "Das Haus") for n in [*ODD, "not there", None])]
    asked = spark.createDataFrame(queries, "query_id int, query string, config_name string")
    every = results.withColumn("query_id", F.explode(F.array(*[F.lit(k) for k, _, _ in queries])))
    default = ScoringConfig(title_match_boost=0.75)
    out = {}
    for r in score.batch_scored(asked, every, default, ODD, "2026-01-01").collect():
        out[r["query_id"], r["pos"]] = (r["score"], r["excerpt"])
    assert len(out) == len(queries) * len(data)
    from_table = score.batch_scored(asked, every, default, configs.configs_frame(spark, ODD), "2026-01-01")
    assert {(r["query_id"], r["pos"]): (r["score"], r["excerpt"]) for r in from_table.collect()} == out
    for k, q, name in queries[:: 3]:
        for r in score.scored(results, q, ODD.get(name, default), as_of="2026-01-01").collect():
            s, shown = out[k, r["pos"]]
            assert math.isclose(s, r["score"], abs_tol=1e-12) and shown == r["excerpt"], (q, name, r)


def test_one_expression_for_all_configs(spark):
    results = spark.createDataFrame([(1, "/a", "t", "e", 0)], "query_id int, url string, title string, excerpt string, pos int")
    asked = spark.createDataFrame([(1, "hello", "c1")], "query_id int, query string, config_name string")
    sizes = [len(score.batch_scored(asked, results, configs={f"c{k}": ScoringConfig(title_match_boost=float(k)) for k in range(n)})._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 200)]
    assert sizes[1] < 1.5 * sizes[0] + 20_000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_against_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé%/_.") for _ in range(r.randint(0, n)))
    texts = [word(30) for _ in range(80)] + ["", None, "x" * 500]
    wanted = [word(7) for _ in range(120)] + ["", None, "xxxx", "x" * 400, "absent pattern"]
    t, p = spark.createDataFrame([(x, 1) for x in texts * 2], "text string, n int"), spark.createDataFrame([(x,) for x in wanted * 2], "pattern string")
    out = sorted(tuple(x) for x in patterns.contained(t, "text", p, "pattern").collect())
    assert out == sorted({(x, y) for x in texts for y in wanted if x is not None and y and y in x})
    plan = patterns.contained(t, "text", p, "pattern")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pages_by_table_equal_pages_of_a_config(spark):
    pages = [("/a", ["hello"], 0.5, None), ("", ["hello"], 0.25, "all"), ("a", ["HELLO", "x"], 1.0, "a page"), ("b/c", ["none"], 9.0, "no"), ("absent", ["hello"], 3.0, "no"), ("/b", [""], 2.0, None)]
    results = spark.createDataFrame([("/a", "t", "e", 0), ("/b/c", "t", "e", 1), ("zz", "hello", "e", 2), (None, "hello", "e", 3), ("/a", "t", "again", 4)], "url string, title string, excerpt string, pos int")
    own = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page int, url_pattern string, keywords array<string>, boost double, custom_excerpt string")
    level = ScoringConfig(recency_strategy="none", priority_pages=tuple(PriorityPage(u, tuple(k), b, e) for u, k, b, e in pages))
    read = lambda df: sorted((r["pos"], r["url"], r["excerpt"], round(r["score"], 9)) for r in df.filter("url is not null").collect())
    assert read(score.scored_by_pages(results, "Hello", own, ScoringConfig(recency_strategy="none"))) == read(score.scored(results, "Hello", level))
    out = score.scored_by_pages(results, "Hello", own.limit(0), ScoringConfig(recency_strategy="none"))
    assert out.count() == 5 and set(out.columns) >= {"url", "score", "excerpt"} and "_url" not in out.columns
