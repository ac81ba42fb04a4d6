import random

import pytest
from pyspark.sql import functions as F

from sieveworks.config import ConversationConfig, ExpansionConfig, SanitizeConfig
from sieveworks.errors import UnknownPrompt
from sieveworks.functions import redact
from sieveworks.functions.expansion import parse_expansion
from sieveworks.operators import dialogue, manifest, merge, templates


def results(spark, *data):
    return spark.createDataFrame(list(data), "url string, title string, excerpt string, score double, pos int")


def test_merge(spark):
    a = results(spark, ("https://Example.com/Page/", "One", "", 10.0, 0), ("/b", "Two", "", 1.0, 1))
    b = results(spark, ("http://example.com/Page", "one", "", 5.0, 0), ("/b", "Three", "", 10.0, 1), ("/c", "x", "", None, 2))
    sets = [(a, 0.7), (b, 0.3)]
    urls = lambda **o: [(r["url"], r["score"]) for r in merge.merge_results(sets, **o).collect()]
    assert len(urls()) == 5
    assert urls(deduplicate_by="url") == [("https://Example.com/Page/", 7.0), ("/b", 3.0), ("http://example.com/Page", 1.5), ("/c", 0.0)]
    assert urls(deduplicate_by="anything", normalize_urls=True) == [("https://Example.com/Page/", 7.0), ("/b", 3.0), ("/c", 0.0)]
    assert len(urls(deduplicate_by="title")) == 4 and len(urls(deduplicate_by="title", case_sensitive=True)) == 5
    # An excluded row still stands for its duplicates.
    assert [u for u, _ in urls(deduplicate_by="title", exclude_urls=["https://Example.com/Page/"])] == ["/b", "/b", "/c"]
    assert [u for u, _ in urls(normalize_urls=True, exclude_urls=["http://EXAMPLE.com/Page"])] == ["/b", "/b", "/c"]
    table = spark.createDataFrame([("/b",), ("/c",)], "url string")
    assert len(urls(exclude_urls=table)) == 2
    stats = merge.merge_stats(sets, "url", exclude_urls=["/b"], normalize_urls=True).first().asDict(recursive=True)
    assert stats == {"sets": [{"weight": 0.7, "input_count": 2}, {"weight": 0.3, "input_count": 3}], "total_before_dedup": 5, "total_after_dedup": 3, "excluded_count": 1}


def test_url_keys(spark):
    cases = {"https://Example.com/Page/": "example.com/Page", "HTTP://x.org": "http:/" + "/x.org", "Foo//": "foo", "http://https://a": "https:/" + "/a", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", merge.url_key(F.col("u"), True))
    assert dict(df.collect()) == cases


def dropped_by_loop(sizes, most, keep, unit):
    left = list(range(len(sizes)))
    while sum(sizes[k] for k in left) > most and len(left) > keep and min(unit, len(left) - keep):
        del left[keep : keep + min(unit, len(left) - keep)]
    return left


@pytest.mark.parametrize(("most", "keep", "unit"), [(15, 2, 2), (0, 0, 1), (30, 1, 3), (40, 2, 0), (25, 50, 2), (33, 3, 1)])
def test_conversations(spark, monkeypatch, most, keep, unit):
    monkeypatch.setattr(dialogue, "BLOCK_TURNS", 3)
    rng, rows, expected = random.Random(most), [], set()
    for conv in range(12):
        sizes = [rng.randrange(9) for _ in range(rng.randrange(14))]
        rows += [(conv, turn, "user", "ä" * (n // 2) + "x" * (n % 2)) for turn, n in enumerate(sizes)]
        expected |= {(conv, turn) for turn in dropped_by_loop(sizes, most, keep, unit)}
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    out = dialogue.truncate_conversation(df, ConversationConfig(most, keep, unit))
    assert out.columns == df.columns and {(r["conv_id"], r["turn"]) for r in out.collect()} == expected


def expanded(spark, answer, **config):
    column = parse_expansion(F.col("t"), ExpansionConfig(**config))
    return spark.createDataFrame([(answer,)], "t string").select(column).first()[0]


def test_expansion(spark):
    assert expanded(spark, '["cardiac surgery", " heart ", 5, {"a": "b"}, "the", "1", "42", null]') == ["cardiac surgery", "heart"]
    assert expanded(spark, 'Here:\n```json\n["a b", "cd"]\n``` and ```x```') == ["a b", "cd"]
    assert expanded(spark, "```\n[\"ef\"]\n```") == ["ef"]
    assert expanded(spark, '["ab"] trailing') == ['["ab"] trailing']
    assert expanded(spark, 'one, "two"\n\'three\'\n\n,the') == ["one", "two", "three"]
    assert expanded(spark, '{"terms": ["x"]}') == ['{"terms": ["x"]}']
    assert expanded(spark, "") == [] and expanded(spark, "[]") == []
    generic = {"generic_terms": ("Services", "help")}
    assert expanded(spark, '["services", "API", "help", "the help", "help desk", "Help"]', **generic) == ["API", "help desk", "Help"]
    assert expanded(spark, '["services", "API", "Help"]', keep_acronyms=False, keep_proper_nouns=False, **generic) == ["API"]
    assert expanded(spark, '["abc", "Dup", "dup"]', min_term_length=3) == ["abc", "Dup", "dup"]
    assert expanded(spark, '["Dup", "dup"]', existing_terms=("DUP", "more", "the")) == ["Dup", "more", "the"]
    df = spark.createDataFrame([('{"terms": ["heart", 1]}',)], "t string")
    assert df.select(parse_expansion(F.col("t"), accept_terms_object=True)).first()[0] == ["heart"]


def test_sanitize(spark):
    def clean(text, **config):
        return spark.createDataFrame([(text,)], "t string").select(redact.sanitize(F.col("t"), SanitizeConfig(**config))).first()[0]

    assert clean("mail a.b@c.org from 10.0.0.1, ssn 123-45-6789") == "mail [EMAIL] from [IP], ssn [SSN]"
    assert clean("4111 1111 1111 1111 or (555) 123-4567") == "[CC] or [PHONE]"
    assert clean("a.b@c.org 10.0.0.1", redact_email=False) == "a.b@c.org [IP]"
    assert clean("order 17", custom_patterns=(("(", "x"), (r"order (\d+)", "<$1>"))) == "<17>"
    assert clean("٤١١١ ١١١١ ١١١١ ١١١١") == "[CC]"
    assert clean(None) is None and clean("") == ""
    assert redact.java_replacement("$1a ${1} $$ \\") == " $1 \\$ \\\\"


def test_templates(spark):
    assert set(templates.TEMPLATES) == {"expand_query", "summarize", "follow_up"}
    assert "{DYNAMIC_ANCHORS}" not in templates.get_prompt("expand_query") and "{SITE_NAME}" in templates.get_prompt(" summarize\n")
    with pytest.raises(UnknownPrompt):
        templates.get_prompt("other")
    out = templates.resolve_prompt("summarize", "{SITE_DESCRIPTION}", "shop", ["x", "y"])
    assert "shop, shop" in out and "x\ny" in out and "{" not in out
    asked = spark.createDataFrame([("summarize", "{SITE_DESCRIPTION}", "shop", ["x", "y"]), ("other", "", "", None)], "prompt_name string, site_name string, site_description string, dynamic_anchors array<string>")
    assert [r["prompt"] for r in templates.resolve_prompts(asked).collect()] == [out, None]


def test_manifest(spark):
    rows = manifest.describe(spark).collect()
    assert len(rows) == 13 and len({r["name"] for r in rows}) == 13 and manifest.version()
