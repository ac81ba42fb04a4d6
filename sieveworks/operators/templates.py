"""Prompt templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import WHITE
from ..errors import UnknownPrompt

EXPAND_QUERY = """Suggest other searches for {SITE_NAME}, {SITE_DESCRIPTION}.
Take the subject of the visitor's question and name two to four different ways to say it: synonyms, technical and everyday words, the usual department or product name. Keep words together that belong together, keep any restriction the visitor made, and leave the question itself out.
Answer with one JSON object of the form {"terms": ["...", "..."]} and nothing else."""

SUMMARIZE = """You answer for {SITE_NAME}, {SITE_DESCRIPTION}, from the search results below and from nothing else.
{DYNAMIC_ANCHORS}
Begin with the answer, in two or three sentences. Then name the pages that say more, each with a link and a line on what it holds. If the results do not answer the question, say so and point to the nearest page. Do not invent links, names, prices or dates."""

FOLLOW_UP = """You continue a conversation for {SITE_NAME}, {SITE_DESCRIPTION}.
{DYNAMIC_ANCHORS}
Use the results already shown and any new ones that are given. Answer the new question directly, refer back instead of repeating, and say when the results at hand do not cover it."""

TEMPLATES = {"expand_query": EXPAND_QUERY, "summarize": SUMMARIZE, "follow_up": FOLLOW_UP}


def get_prompt(name: str) -> str:
    """The raw template; white space around the name is ignored."""
    bare = WHITE.sub(" ", name).strip(" ")
    if bare not in TEMPLATES:
        raise UnknownPrompt(bare)
    return TEMPLATES[bare]


def filled(template: Column, site_name: Column, site_description: Column, anchors: Column) -> Column:
    """Placeholders one after the other, so that one inside a value is filled too; no anchors give an empty string."""
    joined = F.coalesce(F.array_join(anchors, "\n"), F.lit(""))
    for mark, value in (("{SITE_NAME}", site_name), ("{SITE_DESCRIPTION}", site_description), ("{DYNAMIC_ANCHORS}", joined)):
        template = F.replace(template, F.lit(mark), F.coalesce(value, F.lit("")))
    return template


def resolve_prompt(name: str, site_name: str = "", site_description: str = "", anchors: Sequence[str] = ()) -> str:
    out = get_prompt(name)
    for mark, value in (("{SITE_NAME}", site_name), ("{SITE_DESCRIPTION}", site_description), ("{DYNAMIC_ANCHORS}", "\n".join(anchors))):
        out = out.replace(mark, value)
    return out


def templates_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "prompt_name string, template string")


def resolve_prompts(requests: DataFrame) -> DataFrame:
    """Add ``prompt`` to requests (prompt_name, site_name, site_description, dynamic_anchors); null for unknown names."""
    table = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])
    template = F.try_element_at(table, F.regexp_replace("prompt_name", r"(?U)\A\s+|\s+\z", ""))
    return requests.withColumn("prompt", filled(template, F.col("site_name"), F.col("site_description"), F.col("dynamic_anchors")))
