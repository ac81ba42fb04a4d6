"""Strict rows, the open tail, figures of merging, conversations of times, and streams played to their end."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sieveworks.config import ContextConfig, ConversationConfig
from sieveworks.errors import ParseError
from sieveworks.functions.context import extract_context
from sieveworks.operators import dialogue, merge, score
from sieveworks.sources import requests
from sieveworks.streaming import live

from .test_context import passages

ROWS = [
    {"url": "/a", "title": "t", "excerpt": "e"}, {"url": "/b", "title": "t", "excerpt": "e", "score": 2, "date": "2020-01-01", "locations": [1, 2], "k": None},
    {"url": 5, "title": "t", "excerpt": "e"}, {"url": None, "title": "t", "excerpt": "e"}, {"title": "t", "excerpt": "e"}, {"url": "/c", "excerpt": "e", "title": ["t"]},
    {"url": "/d", "title": "t", "excerpt": "e", "score": "3"}, {"url": "/e", "title": "t", "excerpt": "e", "score": 1.5, "source_weight": None, "locations": None},
    {"url": "/f", "title": "t", "excerpt": "e", "locations": [1, -2]}, {"url": "/g", "title": "t", "excerpt": "e", "locations": [2**32]}, {"url": "/h", "title": "t", "excerpt": "e", "locations": [1.5]},
    {"url": "/i", "title": "t", "excerpt": "e", "locations": []}, {"url": "/j", "title": True, "excerpt": "e"}, {"url": "/k", "title": "t", "excerpt": "e", "date": None}, [1], "x", 5, None,
    {"url": "/l", "title": "t", "excerpt": "e", "locations": ["1"]}, {"url": "/m", "title": "t", "excerpt": "e", "locations": 7}, {"url": "", "title": "", "excerpt": "", "content_type": 1},
    {"url": "/n", "title": "t", "excerpt": "e", "score": None}, {"url": "/o", "title": "t", "excerpt": "e", "site_name": "s", "source_weight": 0.5, "reason": "own"},
]


def test_strict_rows_equal_the_requests(spark):
    lines = [json.dumps(r) for r in ROWS]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*lines, "{", "", None])], "n int, value string")
    out = {r["n"]: r for r in requests.checked_rows(df).collect()}
    for k, row in enumerate(ROWS):
        try:
            requests._row("f", "rows", row)
            reason = None
        except ParseError as e:
            reason = str(e).split("rows: ")[1]
        assert out[k]["reason"] == reason, row
        if reason is None:
            assert out[k]["url"] == row["url"] and out[k]["score"] == row.get("score") and out[k]["locations"] == row.get("locations")
    assert [out[len(ROWS) + k]["reason"] for k in range(3)] == ["it is not JSON"] * 3
    good, bad = requests.quarantined(requests.checked_rows(df))
    assert good.count() + bad.count() == len(ROWS) + 3 and "reason" not in good.columns and bad.columns == ["n", "value", "reason"]


def test_load_results(spark, tmp_path):
    (tmp_path / "in.json").write_text("".join(json.dumps(r) + "\n" for r in ROWS if r is not None) + "broken\n")
    requests.load_results(spark, str(tmp_path / "in.json"), str(tmp_path / "good"), str(tmp_path / "bad"))
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.count() == 5 and bad.count() == len(ROWS) - 1 - 5 + 1 and "broken" in {r["value"] for r in bad.collect()}
    assert sorted(r["url"] for r in score.score_results(good, "t").collect()) == ["/a", "/b", "/e", "/i", "/o"]


def test_order_by_an_open_tail(spark):
    tails = ['{"k": 10}', '{"k": "9.5"}', '{"k": "word"}', '{"k": null}', "{}", '{"k": true}', '{"k": -2e3}', None, "[1]", '{"k": "Word", "a b": 1}', '{"k": 10.0}', '{"k": ""}']
    df = spark.createDataFrame([(k, t, float(k % 2)) for k, t in enumerate(tails)], "pos int, t string, score double").withColumn("tail", F.parse_json("t"))
    assert [r["pos"] for r in score.sort_override(df, "k", tail="tail").collect()] == [6, 1, 0, 10, 3, 5, 11, 9, 2]
    down = [r["pos"] for r in score.sort_override(df, "k", "desc", "tail").collect()]
    assert down in ([2, 9, 3, 5, 11, 10, 0, 1, 6], [2, 9, 3, 5, 11, 0, 10, 1, 6])
    assert [r["pos"] for r in score.sort_override(df, "a b", tail="tail").collect()] == [9]
    assert score.sort_override(df, "url", tail="tail").count() == 0
    again = df.withColumn("k", F.try_variant_get("tail", "$.k", "string")).filter("k is not null")
    assert score.sort_override(again, "k").columns == again.columns


@pytest.mark.parametrize("options", [{}, {"deduplicate_by": "url", "normalize_urls": True, "exclude_urls": ["http://B.org"]}, {"deduplicate_by": "title"}])
def test_figures_by_observation(spark, options):
    a = spark.createDataFrame([("https://b.org/", "T", 1.0, 0), ("/x", "t", 3.0, 1)], "url string, title string, score double, pos int")
    b = spark.createDataFrame([("http://b.org", "u", 2.0, 0), ("/y", "T", None, 1), (None, None, 1.0, 2)], "url string, title string, score double, pos int")
    sets = [(a, 0.5), (b, 1.0)]
    rows, figures = merge.merge_observed(sets, **options)
    own = sorted(map(str, rows.collect()))
    assert own == sorted(map(str, merge.merge_results(sets, **options).collect()))
    table = dict(options, exclude_urls=spark.createDataFrame([(u,) for u in options.get("exclude_urls", ["/none"])], "url string"))
    for told in (options, table):
        stats = merge.merge_stats(sets, **told)
        assert stats.first().asDict(recursive=True) == figures()
    plan = merge.merge_stats(sets, **options)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2 and "Join" not in plan


def conversations(seed, times):
    r, rows = random.Random(seed), []
    for conv in range(15):
        at = 0
        for _ in range(r.randrange(20)):
            at += r.randrange(1, 10**9) if times else 1
            rows.append((conv, at, "x" * r.randrange(9)))
    return rows


def test_conversation_of_times_is_spread(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK_TURNS", 50)
    rows = [(1, 1_700_000_000_000 + k * 3_600_000, "abc") for k in range(1000)] + [(None, k * 10**6, "abcd") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id int, at bigint, content string")
    summed = dialogue.running(df, "conv_id", "at", {"_before": F.lit(3)})
    assert {(r["conv_id"], r["at"]): r["_before"] for r in summed.collect()} == {(c, at): 3 * (k if c else k - 1000) for k, (c, at, _) in enumerate(rows)}
    kept = dialogue.truncate_conversation(df, ConversationConfig(30, 2, 2), turn="at").groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in kept} == {1: 10, None: 6}


@pytest.mark.parametrize(("most", "keep", "unit"), [(15, 2, 2), (30, 1, 3), (40, 2, 0), (0, 0, 1), (25, 50, 2)])
def test_a_stream_of_turns_ends_as_the_batch(spark, tmp_path, most, keep, unit):
    rows = conversations(most, True)
    schema = "conv_id int, turn bigint, content string"
    config = ConversationConfig(most, keep, unit)
    for k in range(3):  # each conversation's turns in order, dealt over three files, the last turn of each file once more
        part = [x for n, x in enumerate(rows) if 3 * n // max(len(rows), 1) in (k, k - 1) or 3 * n // max(len(rows), 1) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.trimmed_conversations(stream, config)
    query = out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
        last[r["conv_id"]] = (r["kept_from"], r["n_kept"], r["kept_bytes"])
    batch = {}
    for r in dialogue.truncate_conversation(spark.createDataFrame(rows, schema), config).orderBy("turn").collect():
        batch.setdefault(r["conv_id"], []).append((r["turn"], len(r["content"])))
    every = {}
    for conv, turn, _ in rows:
        every.setdefault(conv, []).append(turn)
    for conv, (kept_from, n, size) in last.items():
        kept = batch.get(conv, [])
        behind = [t for t, _ in kept if t not in every[conv][:keep]]
        assert (kept_from, n, size) == (behind[0] if behind else None, len(kept), sum(s for _, s in kept)), conv


def test_idle_conversations_let_their_state_go(spark, tmp_path):
    """The turn after a long pause begins anew, as what was known of the conversation is gone."""
    schema, at = "conv_id int, turn bigint, content string, t timestamp", "timestamp '2024-01-01 {}:00:00'"
    for k, rows in enumerate(([(1, 1, "aaaa", "00"), (1, 2, "bbbb", "00")], [(2, 1, "c", "05")], [(1, 3, "dd", "06")])):
        df = spark.createDataFrame(rows, "conv_id int, turn bigint, content string, h string").selectExpr("conv_id", "turn", "content", "to_timestamp('2024-01-01 ' || h || ':00:00') AS t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read by their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.trimmed_conversations(stream, ConversationConfig(100, 0, 1), time_column="t")
    query = out.writeStream.outputMode("update").format("memory").queryName("idle_out").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["conv_id"], r["n_turns"], r["kept_bytes"]) for r in spark.table("idle_out").collect()) == [(1, 1, 2), (1, 2, 8), (2, 1, 1)]


def test_a_stream_of_results_ends_as_the_batch(spark, tmp_path):
    r = random.Random(7)
    rows = [(f"https://A.org/{r.randrange(9)}/", "t", float(r.randrange(5)), k) for k in range(60)]
    schema = "url string, title string, score double, pos int"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    best = live.best_of_key(merge.weighted([(stream, 0.5)]), normalize_urls=True)
    query = best.writeStream.outputMode("complete").format("memory").queryName("best_out").start()
    query.processAllAvailable()
    query.stop()
    own = merge.merge_results([(spark.createDataFrame(rows, schema), 0.5)], "url", normalize_urls=True)
    read = lambda df: sorted((x["url"], x["score"], x["pos"]) for x in df.collect())
    assert read(spark.table("best_out")) == read(own)


def test_windows_let_their_state_go(spark, tmp_path):
    rows = [("/a", "2024-01-01 10:00:00", 1.0, 0), ("/a", "2024-01-01 10:30:00", 2.0, 1), ("/a", "2024-01-01 11:10:00", 5.0, 2), ("/b", "2024-01-02 00:00:00", 1.0, 3)]
    df = spark.createDataFrame(rows, "url string, t string, score double, pos int").select("url", F.to_timestamp("t").alias("t"), "score", "pos", F.lit("x").alias("title"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    best = live.best_of_key(merge.weighted([(stream, 1.0)]), time_column="t")
    query = best.writeStream.outputMode("append").format("memory").queryName("window_out").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((x["url"], x["pos"]) for x in spark.table("window_out").collect()) == [("/a", 1), ("/a", 2)]


def test_context_of_a_hundred_thousand_hits(spark):
    text = "intro " * 100 + "thor some words between them here\n" * 100_000
    config = ContextConfig(10**7, 300, 3)
    assert config.max_length > len(text)
    config = ContextConfig(3_000_000, 300, 3)
    df = spark.createDataFrame([(text,)], "t string")
    df.select(extract_context(F.col("t"), "warm", config)).collect()
    began = time.perf_counter()
    out = df.select(extract_context(F.col("t"), "thor", config)).first()[0]
    took = time.perf_counter() - began
    assert out == passages(text, "thor", config) and took < 10, took
    far = "thor" * 60_000 + "x" * 10**6  # no space to widen to
    assert spark.createDataFrame([(far,)], "t string").select(extract_context(F.col("t"), "thor", ContextConfig(1000, 100, 5))).first()[0] == passages(far, "thor", ContextConfig(1000, 100, 5))
