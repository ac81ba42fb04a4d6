import json

import pytest

from sieveworks import errors
from sieveworks.functions import sql
from sieveworks.operators import score
from sieveworks.operators.manifest import FUNCTIONS
from sieveworks.sources import requests as api
from sieveworks.streaming import live


def item(url, title="T", excerpt="e", **more):
    return {"url": url, "title": title, "excerpt": excerpt, **more}


def test_every_function():
    assert all(callable(getattr(api, f[0])) for f in FUNCTIONS)


def test_score(spark):
    rows = [item("/oak", "Oak desk", date="2025-11-30", weight="71.5", tags=[1, {"a": None}]), item("/pin", "Pin", weight="3.25"), item("/lamp", "Lamp", weight=18), item("/air", "Air")]
    request = {"query": "pin", "results": rows, "config": {"recency_strategy": "none"}}
    out = json.loads(api.score_results(spark, json.dumps(request), "2026-06-01"))
    assert out[0] == {"url": "/pin", "title": "Pin", "excerpt": "e", "date": "", "score": 2.0, "content_type": "", "site_name": "", "weight": "3.25"}
    assert [r["url"] for r in out] == ["/pin", "/oak", "/lamp", "/air"] and out[1]["tags"] == [1, {"a": None}]
    for direction, expected in (("asc", ["/pin", "/lamp", "/oak"]), ("desc", ["/oak", "/lamp", "/pin"]), ("odd", ["/pin", "/lamp", "/oak"])):
        sort = {"sort_override": {"field": "weight", "direction": direction}}
        assert [r["url"] for r in json.loads(api.score_results(spark, json.dumps(request | sort)))] == expected
    assert json.loads(api.score_results(spark, json.dumps(request | {"sort_override": {"field": "title", "direction": "asc"}}))) == []
    assert json.loads(api.score_results(spark, json.dumps({"query": "", "results": []}))) == []


@pytest.mark.parametrize(
    ("function", "request_", "error", "message"),
    [
        ("score_results", "nope", errors.InvalidJson, "score_results: the input is no JSON"), ("score_results", "[]", errors.InvalidJson, "it is not an object"),
        ("score_results", '{"query": 5, "results": []}', errors.MissingField, "score_results: field 'query' is missing"), ("score_results", '{"query": ""}', errors.MissingField, "'results'"),
        ("score_results", '{"query": "", "results": [{"url": "a"}]}', errors.ParseError, "score_results: cannot read results"), ("merge_results", "{}", errors.MissingField, "'sets'"),
        ("merge_results", '{"sets": [{"results": []}]}', errors.ParseError, "merge_results"), ("batch_score_results", '{"queries": [{"query": "a"}]}', errors.ParseError, "queries[0] has no results"),
        ("batch_score_results", '{"queries": [1]}', errors.ParseError, "queries[0] is not an object"), ("match_priority_pages", '{"query": "a"}', errors.MissingField, "'priority_pages'"),
        ("match_priority_pages", '{"query": "a", "priority_pages": [{}]}', errors.ParseError, "match_priority_pages"), ("extract_context", '{"query": "a"}', errors.MissingField, "'content'"),
        ("batch_extract_context", '{"query": "a", "items": 1}', errors.ParseError, "items"), ("sanitize_query", "{}", errors.MissingField, "'query'"),
        ("truncate_conversation", '{"messages": [{"role": "a"}]}', errors.ParseError, "messages"), ("resolve_prompt", '{"prompt_name": "zz"}', errors.UnknownPrompt, "there is no template 'zz'"),
    ],
)
def test_errors(spark, function, request_, error, message):
    with pytest.raises(error) as caught:
        getattr(api, function)(spark, request_)
    assert message in str(caught.value)


def test_others(spark):
    batch = {"queries": [{"query": "one", "results": [item("/a", "x"), item("/b", "One")]}, {"query": "one", "results": [item("/b", "One")], "config": {"title_match_boost": 0}}], "default_config": {"title_match_boost": 4, "recency_strategy": "none"}}
    assert [[(r["url"], r["score"]) for r in rows] for rows in json.loads(api.batch_score_results(spark, json.dumps(batch)))] == [[("/b", 5.0), ("/a", 1.0)], [("/b", 1.0)]]
    assert json.loads(api.batch_score_results(spark, '{"queries": []}')) == []
    sets = {"sets": [{"results": [item("/a", score=10)], "weight": 0.7}, {"results": [item("/a", score=10, k=1)], "weight": 0.3}], "deduplicate_by": "url", "debug": True}
    merged = json.loads(api.merge_results(spark, json.dumps(sets)))
    assert [r["score"] for r in merged["results"]] == [7.0] and merged["debug"]["total_before_dedup"] == 2 and merged["debug"]["excluded_count"] == 0
    page = {"url_pattern": "/p", "keywords": ["Price"], "boost": 1}
    assert json.loads(api.match_priority_pages(spark, json.dumps({"query": "prices", "priority_pages": [page]})))[0]["url_pattern"] == "/p"
    assert json.loads(api.parse_expansion(spark, json.dumps({"text": '["Hallo", "der"]', "language": "de"}))) == ["Hallo"]
    assert json.loads(api.extract_context(spark, json.dumps({"content": "short", "query": "x"}))) == "short"
    assert json.loads(api.batch_extract_context(spark, json.dumps({"query": "x", "items": [{"content": "c"}, 5]}))) == [{"url": "", "title": "", "context": "c"}, {"url": "", "title": "", "context": ""}]
    assert json.loads(api.sanitize_query(spark, json.dumps({"query": "a@b.org", "config": {"redact_email": False}}))) == "a@b.org"
    messages = [{"role": "s", "content": t} for t in ("rules", "hi", "one", "uno", "two", "due", "three", "tre")]
    kept = json.loads(api.truncate_conversation(spark, json.dumps({"messages": messages, "config": {"max_length": 20}})))
    assert [m["content"] for m in kept] == ["rules", "hi", "three", "tre"]
    assert "Shop" in api.resolve_prompt(spark, json.dumps({"prompt_name": "summarize", "site_name": "Shop"}))
    assert len(json.loads(api.describe(spark))["functions"]) == 13 and api.version(spark)


def test_read_results(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps(item("/a", score=2)) + "\n" + json.dumps({"url": "/b"}) + "\n")
    assert [r["url"] for r in api.read_results(spark, str(path), "drop").collect()] == ["/a"]
    with pytest.raises(Exception, match="lacks url"):
        api.read_results(spark, str(path)).collect()


def test_read_results_keeps_further_fields(spark, tmp_path):
    path = tmp_path / "r.json"
    rows = [item("/a", weight="10.5", pos=0), item("/b", weight="9", pos=1), item("/c", pos=2), item("/d", weight="heavy", site_name="s", pos=3)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    for extra in (None, "weight string, pos int"):
        df = api.read_results(spark, str(path), extra=extra)
        assert dict(df.dtypes)["weight"] == "string" and dict(df.dtypes)["score"] == "double"
        out = score.score_results(df, "x", sort_field="weight", direction="desc").collect()
        assert [r["url"] for r in out] == ["/d", "/a", "/b"] and out[0]["site_name"] == "s"


def test_sql_functions(spark):
    assert "sw_terms" in sql.register(spark)
    row = spark.sql("SELECT sw_terms('What is Ferry'), sw_sanitize('a@b.org'), CAST(sw_parse_date('2025-02-31') AS STRING), sw_recency('2025-01-01', DATE '2026-01-01'), sw_url_key('https://A.b/C/'), sw_is_valid_term('the'), sw_first_sentences('One. Two three', 8)").first()
    assert tuple(row) == (["ferry"], "[EMAIL]", "2025-03-03", 0.25, "a.b/C", False, "One.")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("/a", "Hello", "a@b.org", 0), ("/b", "x", "y", 1)], "url string, title string, excerpt string, pos int").write.parquet(source)
    stream = spark.readStream.schema("url string, title string, excerpt string, pos int").parquet(source)
    out = live.scored_stream(live.sanitized_stream(stream, "excerpt"), "hello", as_of="2026-01-01").select("url", "excerpt", "score")
    running = out.writeStream.format("memory").queryName("live_out").start()
    running.processAllAvailable()
    running.stop()
    assert {tuple(r) for r in spark.table("live_out").collect()} == {("/a", "[EMAIL]", 2.0), ("/b", "y", 1.0)}
    ranked = live.ranked_batches(stream, "hello", str(tmp_path / "out"), as_of="2026-01-01", top=1).option("checkpointLocation", str(tmp_path / "c")).start()
    ranked.processAllAvailable()
    ranked.stop()
    assert [r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["/a"]
