"""Trimming of conversations to a number of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import ConversationConfig
from ..tables import numbered

#: Turns of one conversation that are summed at a time.
BLOCK_TURNS = 4096


def running(df: DataFrame, conv: str, turn: str, values: dict[str, Column]) -> DataFrame:
    """Add, for each value, its sum over the earlier turns of the conversation.

    Turns are sorted over ranges and numbered, whatever their values are (counts, or times with gaps); a block is a run of
    neighbouring numbers. Turns are summed in blocks, and blocks among each other, so a very long conversation is not sorted
    in one task.
    """
    rows = numbered(df.orderBy(conv, turn)).withColumn("_block", F.floor(F.col("rank") / BLOCK_TURNS))
    inside = Window.partitionBy(conv, "_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(conv, "_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(conv).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(conv).alias("_c"), F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    inner = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    joined = inner.join(blocks, F.col(conv).eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return joined.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in values}).drop("rank", "total", "_block", "_c", "_b", *[f"_{k}_{n}" for k in "io" for n in values])


def truncate_conversation(
    df: DataFrame, config: ConversationConfig = ConversationConfig(), conv: str = "conv_id", turn: str = "turn", content: str = "content"  # noqa: B008
) -> DataFrame:
    """Drop the oldest groups of ``removal_unit`` turns behind the first ``preserve_first_n`` until the rest fits.

    A turn stays if the preserved ones and all from its group on fit together; that sum falls from group to group, so this is
    where dropping one group after the other ends. Null content counts no bytes; turns should differ within a conversation.
    """
    if config.removal_unit == 0:
        return df
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint")
    rows = running(df, conv, turn, {"_idx": F.lit(1), "_before": size})
    rows = rows.withColumn("_fixed", F.col("_idx") < config.preserve_first_n).withColumn("_size", size)
    totals = rows.groupBy(F.col(conv).alias("_c")).agg(F.sum("_size").alias("_all"), F.coalesce(F.sum(F.when(F.col("_fixed"), F.col("_size"))), F.lit(0)).alias("_kept"))
    rows = rows.join(totals, F.col(conv).eqNullSafe(F.col("_c")))
    group = F.when(~F.col("_fixed"), F.floor((F.col("_idx") - config.preserve_first_n) / config.removal_unit))
    begin = F.min("_before").over(Window.partitionBy(conv, group))
    left = F.col("_kept") + F.col("_all") - begin
    return rows.withColumn("_left", left).filter(F.col("_fixed") | (F.col("_left") <= config.max_length)).select(*df.columns)
