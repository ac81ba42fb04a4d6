"""Requests and answers as JSON text, for callers that have no DataFrame: the thirteen functions of the interface.

Each builds a small DataFrame, runs the operator on it and returns JSON (or plain text). Rows are read strictly, settings
leniently. ``read_results`` is the source for larger inputs: JSON lines on any file system.
"""

from __future__ import annotations

import datetime
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..config import ContextConfig, ConversationConfig, ExpansionConfig, PriorityPage, SanitizeConfig, ScoringConfig
from ..errors import InvalidJson, MissingField, ParseError, UnknownPrompt
from ..functions.context import extract_context as context_of
from ..functions.expansion import parse_expansion as terms_of
from ..functions.redact import sanitize
from ..operators import dialogue, manifest, merge, passages, score, templates
from ..tables import emptied, written

REQUIRED = ("url", "title", "excerpt")
CORE = "url string, title string, excerpt string, date string, score double, content_type string, site_name string, source_weight double, locations array<bigint>"
_TYPES = {"url": str, "title": str, "excerpt": str, "date": str, "score": float, "content_type": str, "site_name": str, "source_weight": float, "locations": list}


def read_results(spark: SparkSession, path: str, bad_rows: str = "fail", extra: str | None = None) -> DataFrame:
    """Candidates from JSON lines. Rows without url, title or excerpt fail the query, or are dropped with bad_rows="drop".

    Further fields become further columns, to sort by for example. ``extra`` gives their schema; without it one more pass
    over the file finds them. A field with numbers and texts is read as text.
    """
    if extra is None:
        found = [f for f in spark.read.json(path).schema.fields if f.name not in _TYPES and f.name != "_corrupt_record"]
    else:
        found = [f for f in StructType.fromDDL(extra).fields if f.name not in _TYPES]
    df = spark.read.schema(StructType([*StructType.fromDDL(CORE).fields, *found])).json(path)
    whole = F.lit(True)
    for name in REQUIRED:
        whole = whole & F.col(name).isNotNull()
    if bad_rows == "drop":
        return df.filter(whole)
    return df.withColumn("url", F.when(whole, F.col("url")).otherwise(F.raise_error(F.lit("a row lacks url, title or excerpt")).cast("string")))


def checked(lines: Column) -> Column:
    """A line of JSON as a strictly read row: STRUCT<reason, row, tail>. ``reason`` is null for a row that is fit, else says what
    keeps it out; ``row`` has the core fields, ``tail`` the whole object as VARIANT, for its further fields.

    Fields must have their types, as in the JSON requests: a number is no url. Lines with a key twice are no JSON here."""
    value = F.try_parse_json(lines)
    whole = F.schema_of_variant(value)
    part = {n: F.try_variant_get(value, f"$.{n}", "variant") for n in _TYPES}
    reason = F.when(value.isNull(), F.lit("it is not JSON")).when(~F.startswith(whole, F.lit("OBJECT")), F.lit("a row is not an object"))
    for name in REQUIRED:
        reason = reason.when(part[name].isNull(), F.lit(f"a row lacks {name}"))
    for name, kind in _TYPES.items():
        told = F.schema_of_variant(part[name])
        fits = {str: told == "STRING", float: told.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)")}.get(kind)
        if kind is list:
            places = F.try_variant_get(value, f"$.{name}", "array<bigint>")
            fits = told.isin("ARRAY<BIGINT>", "ARRAY<VOID>") & F.coalesce(F.forall(places, lambda x: x.isNotNull() & x.between(0, 2**32 - 1)), F.lit(False))
        if name in ("source_weight", "locations"):
            fits = fits | (told == "VOID")
        reason = reason.when(part[name].isNotNull() & ~fits, F.lit(f"{name} has a wrong type"))
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(CORE).fields}
    row = F.struct(*[F.try_variant_get(value, f"$.{n}", kinds[n]).alias(n) for n in _TYPES])
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), row).alias("row"), value.alias("tail"))


def checked_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ``reason``, the core fields and ``tail``; what stands under these names already is replaced."""
    others = [c for c in lines.columns if c not in {"reason", "tail", *_TYPES}]
    return lines.select(*others, checked(F.col(column)).alias("_checked")).select(*others, "_checked.reason", "_checked.row.*", "_checked.tail")


def quarantined(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Of ``checked_rows``: those that are fit, and the lines of the others with their reason."""
    return rows.filter("reason is null").drop("reason", column), rows.filter("reason is not null").select(*[c for c in rows.columns if c not in {"tail", *_TYPES}])


def load_results(spark: SparkSession, path: str, good: str, bad: str) -> None:
    """Read JSON lines once and add the fit rows to the Parquet table ``good``, the others to ``bad``. The rows go through a table in
    the shared folder, so the lines are parsed once."""
    rows = written(checked_rows(spark.read.text(path)), "checked")
    fit, unfit = quarantined(rows)
    fit.write.mode("append").parquet(good)
    unfit.write.mode("append").parquet(bad)
    emptied(rows)


def _loaded(function: str, text: str) -> dict[str, Any]:
    try:
        value = json.loads(text)
    except ValueError as e:
        raise InvalidJson(function, str(e)) from None
    if not isinstance(value, dict):
        raise InvalidJson(function, "it is not an object")
    return value


def _text(function: str, request: dict, name: str) -> str:
    if not isinstance(request.get(name), str):
        raise MissingField(function, name)
    return request[name]


def _present(function: str, request: dict, name: str) -> Any:
    if name not in request:
        raise MissingField(function, name)
    return request[name]


def _row(function: str, what: str, value: Any) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ParseError(function, f"cannot read {what}: a row is not an object")
    for name in REQUIRED:
        if name not in value:
            raise ParseError(function, f"cannot read {what}: a row lacks {name}")
    for name, kind in _TYPES.items():
        v = value.get(name)
        fits = isinstance(v, kind) or (kind is float and isinstance(v, int))
        if name in value and not (fits and not isinstance(v, bool)) and not (v is None and name in ("source_weight", "locations")):
            raise ParseError(function, f"cannot read {what}: {name} has a wrong type")
        if kind is list and v is not None and not all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 2**32 for x in v):
            raise ParseError(function, f"cannot read {what}: {name} has a wrong type")
    return value


def _rows(function: str, what: str, value: Any) -> list[dict[str, Any]]:
    if not isinstance(value, list):
        raise ParseError(function, f"cannot read {what}: they are not an array")
    return [_row(function, what, v) for v in value]


def _frame(spark: SparkSession, rows: list[dict[str, Any]], sort_field: str | None = None, **more: int) -> DataFrame:
    """Rows with their place, and everything that is not a core field kept as JSON."""
    names = list(_TYPES)
    data = []
    for pos, row in enumerate(rows):
        extra = {k: v for k, v in row.items() if k not in _TYPES}
        meta = extra.get(sort_field) if sort_field else None
        shown = meta if isinstance(meta, str) else json.dumps(meta) if isinstance(meta, (int, float)) and not isinstance(meta, bool) else "" if sort_field in extra else None
        core = [float(row[n]) if _TYPES[n] is float and row.get(n) is not None else row.get(n) for n in names]
        data.append((*core, pos, json.dumps(extra, ensure_ascii=False), shown, *more.values()))
    schema = f"{CORE}, pos bigint, _extra string, _meta string" + "".join(f", {k} int" for k in more)
    return spark.createDataFrame(data, schema)


def _answer(row: Any) -> dict[str, Any]:
    optional = ("source_weight", "locations")
    out = {n: row[n] for n in _TYPES if n not in optional or row[n] is not None}
    for name, empty in (("date", ""), ("score", 0.0), ("content_type", ""), ("site_name", "")):
        out[name] = empty if out[name] is None else out[name]
    return out | json.loads(row["_extra"])


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def score_results(spark: SparkSession, text: str, as_of: str | datetime.date | None = None) -> str:
    request = _loaded("score_results", text)
    query = _text("score_results", request, "query")
    rows = _rows("score_results", "results", _present("score_results", request, "results"))
    config = ScoringConfig.from_dict(request.get("config"))
    primary = request.get("primary_query")
    sort = request.get("sort_override")
    sort = sort if isinstance(sort, dict) and isinstance(sort.get("field"), str) and isinstance(sort.get("direction"), str) else None
    df = score.scored(_frame(spark, rows, sort and sort["field"]), query, config, primary if isinstance(primary, str) else None, as_of)
    df = df.orderBy(F.desc("score"), "pos") if sort is None else score.sort_override(df, "_meta", sort["direction"])
    return _dump([_answer(r) for r in df.collect()])


def batch_score_results(spark: SparkSession, text: str, as_of: str | datetime.date | None = None) -> str:
    name = "batch_score_results"
    request = _loaded(name, text)
    if not isinstance(request.get("queries"), list):
        raise MissingField(name, "queries")
    every, queries, configs = [], [], {}
    for k, entry in enumerate(request["queries"]):
        if not isinstance(entry, dict):
            raise ParseError(name, f"queries[{k}] is not an object")
        if not isinstance(entry.get("query"), str):
            raise ParseError(name, f"queries[{k}] has no query")
        if "results" not in entry:
            raise ParseError(name, f"queries[{k}] has no results")
        try:
            rows = _rows(name, "results", entry["results"])
        except ParseError as e:
            raise ParseError(name, f"queries[{k}].results: {e}") from None
        configs[str(k)] = ScoringConfig.from_dict(entry.get("config", request.get("default_config")))
        queries.append((k, entry["query"], str(k)))
        every.append(_frame(spark, rows, query_id=k))
    if not every:
        return "[]"
    results = every[0]
    for df in every[1:]:
        results = results.unionByName(df)
    asked = spark.createDataFrame(queries, "query_id int, query string, config_name string")
    out: list[list] = [[] for _ in queries]
    for r in score.batch_score_results(asked.drop("config_name") if len(set(configs.values())) == 1 else asked, results, configs["0"], configs, as_of).collect():
        out[r["query_id"]].append(_answer(r))
    return _dump(out)


def merge_results(spark: SparkSession, text: str) -> str:
    name = "merge_results"
    request = _loaded(name, text)
    sets = _present(name, request, "sets")
    if not isinstance(sets, list):
        raise ParseError(name, "cannot read sets: they are not an array")
    frames = []
    for s in sets:
        if not isinstance(s, dict) or "results" not in s or not isinstance(s.get("weight"), (int, float)) or isinstance(s.get("weight"), bool):
            raise ParseError(name, "cannot read sets: one lacks results or weight")
        frames.append((_frame(spark, _rows(name, "sets", s["results"])), float(s["weight"])))
    by, urls = request.get("deduplicate_by"), request.get("exclude_urls")
    options = {
        "deduplicate_by": by if isinstance(by, str) else None, "case_sensitive": request.get("case_sensitive") is True,
        "exclude_urls": urls if isinstance(urls, list) and all(isinstance(u, str) for u in urls) else [], "normalize_urls": request.get("normalize_urls") is True,
    }
    if request.get("debug") is not True:
        return _dump([_answer(r) for r in merge.merge_results(frames, **options).collect()] if frames else [])
    if not frames:
        return _dump({"results": [], "debug": {"sets": [], "total_before_dedup": 0, "total_after_dedup": 0, "excluded_count": 0}})
    merged, figures = merge.merge_observed(frames, **options)
    rows = sorted(merged.collect(), key=lambda r: (-r["score"], r["set_id"], r["pos"]))
    return _dump({"results": [_answer(r) for r in rows], "debug": figures()})


def match_priority_pages(spark: SparkSession, text: str) -> str:
    name = "match_priority_pages"
    request = _loaded(name, text)
    query, pages = _text(name, request, "query"), _present(name, request, "priority_pages")
    try:
        if not isinstance(pages, list):
            raise ValueError("expected an array")
        read = [PriorityPage.from_dict(p) for p in pages]
    except ValueError as e:
        raise ParseError(name, f"cannot read priority_pages: {e}") from None
    return _dump([r.asDict() for r in score.match_priority_pages(score.pages_frame(spark, read), query).collect()])


def parse_expansion(spark: SparkSession, text: str) -> str:
    """A bare answer of a model, or an object with text and settings; never fails."""
    config = ExpansionConfig()
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    if isinstance(value, dict) and isinstance(value.get("text"), str):
        text, config = value["text"], ExpansionConfig.from_dict(value)
    return _dump(_one(spark, text, lambda c: terms_of(c, config)))


def _one(spark: SparkSession, text: str, column) -> Any:
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def extract_context(spark: SparkSession, text: str) -> str:
    request = _loaded("extract_context", text)
    content, query = _text("extract_context", request, "content"), _text("extract_context", request, "query")
    return _dump(_one(spark, content, lambda c: context_of(c, query, ContextConfig.from_dict(request.get("config")))))


def batch_extract_context(spark: SparkSession, text: str) -> str:
    name = "batch_extract_context"
    request = _loaded(name, text)
    query, items = _text(name, request, "query"), _present(name, request, "items")
    if not isinstance(items, list):
        raise ParseError(name, "items: expected an array")
    part = lambda item, n: item[n] if isinstance(item, dict) and isinstance(item.get(n), str) else ""
    rows = [(k, part(i, "content"), part(i, "url"), part(i, "title")) for k, i in enumerate(items)]
    df = spark.createDataFrame(rows, "pos int, content string, url string, title string").orderBy("pos")
    found = passages.batch_extract_context(df, query, ContextConfig.from_dict(request.get("config")))
    return _dump([r.asDict() for r in found.collect()])


def sanitize_query(spark: SparkSession, text: str) -> str:
    request = _loaded("sanitize_query", text)
    query = _text("sanitize_query", request, "query")
    return _dump(_one(spark, query, lambda c: sanitize(c, SanitizeConfig.from_dict(request.get("config")))))


def truncate_conversation(spark: SparkSession, text: str) -> str:
    name = "truncate_conversation"
    request = _loaded(name, text)
    messages = _present(name, request, "messages")
    if not isinstance(messages, list) or not all(isinstance(m, dict) and isinstance(m.get("role"), str) and isinstance(m.get("content"), str) for m in messages):
        raise ParseError(name, "messages: expected an array of role and content")
    df = spark.createDataFrame([(0, k, m["role"], m["content"]) for k, m in enumerate(messages)], "conv_id int, turn int, role string, content string")
    kept = dialogue.truncate_conversation(df, ConversationConfig.from_dict(request.get("config"))).orderBy("turn")
    return _dump([{"role": r["role"], "content": r["content"]} for r in kept.collect()])


def resolve_prompt(spark: SparkSession, text: str) -> str:
    request = _loaded("resolve_prompt", text)
    name = _text("resolve_prompt", request, "prompt_name")
    if name not in templates.TEMPLATES:  # here white space around the name counts
        raise UnknownPrompt(name)
    of = lambda n: request[n] if isinstance(request.get(n), str) else ""
    anchors = request.get("dynamic_anchors")
    known = isinstance(anchors, list) and all(isinstance(a, str) for a in anchors)
    return templates.resolve_prompt(name, of("site_name"), of("site_description"), anchors if known else ())


def get_prompt(spark: SparkSession, name: str) -> str:
    return templates.get_prompt(name)


def version(spark: SparkSession) -> str:
    return manifest.version()


def describe(spark: SparkSession) -> str:
    rows = manifest.describe(spark).collect()
    functions = {r["name"]: {f: r[f] for f in manifest.FIELDS[1:]} for r in rows}
    return _dump({"name": "sieveworks", "version": manifest.version(), "interface_version": manifest.INTERFACE_VERSION, "functions": functions})
