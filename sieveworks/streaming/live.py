"""The operators over streams. An addition. The row-wise ones are stateless projections and run under readStream as they are.

Merging and trimming keep state by key: the best row of a key so far, and what of a conversation still fits. What they put
out last for a key, over a stream that has been played to its end, is what the batch operators return.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ConversationConfig, SanitizeConfig, ScoringConfig
from ..operators import merge, passages, score


def scored_stream(results: DataFrame, query: str, config: ScoringConfig = ScoringConfig(), as_of=None) -> DataFrame:  # noqa: B008
    """Scores of arriving candidates; the stream must carry ``pos``, as an order of arrival is not defined."""
    return score.scored(results, query, config, as_of=as_of)


def sanitized_stream(rows: DataFrame, column: str, config: SanitizeConfig = SanitizeConfig()) -> DataFrame:  # noqa: B008
    return passages.sanitized(rows, column, config)


def first_seen(results: DataFrame, time_column: str, within: str = "1 hour", normalize_urls: bool = True) -> DataFrame:
    """The first arrival of each URL within the time given; the state of older ones is let go."""
    keyed = results.withColumn("_key", merge.url_key(results["url"], normalize_urls)).withWatermark(time_column, within)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def best_of_key(results: DataFrame, by: str = "url", case_sensitive: bool = False, normalize_urls: bool = False, time_column: str | None = None, within: str = "1 hour") -> DataFrame:
    """The best row of each key so far, by score, ``set_id`` and ``pos``: weighted results as ``merge.weighted`` makes them. Spark's
    own aggregation keeps one row for each key. For output mode update (or complete).

    With ``time_column``, keys count within windows of ``within``, whose state goes when the watermark has passed them; in mode
    append each window's best rows come out then, once.
    """
    key = merge.dedup_key(by, case_sensitive, normalize_urls).alias("_key")
    order = F.struct((-F.col("score")).alias("s"), F.col("set_id"), F.col("pos"))
    best = F.min_by(F.struct(*results.columns), order).alias("_row")
    if time_column is None:
        return results.groupBy(key).agg(best).select("_row.*")
    timed = results.withWatermark(time_column, within).groupBy(F.window(time_column, within).alias("_window"), key)
    return timed.agg(best).select("_row.*")


TRIMMED = "kept_from bigint, n_kept bigint, kept_bytes bigint, n_turns bigint"


def trimmed_conversations(
    turns: DataFrame, config: ConversationConfig = ConversationConfig(), conv: str = "conv_id", turn: str = "turn", content: str = "content",  # noqa: B008
    time_column: str | None = None, idle: str = "1 hour",
) -> DataFrame:
    """For each conversation that has new turns: behind the first ``preserve_first_n`` turns, the first turn that is kept (null if
    none is), and how many turns and bytes are kept in all. For output mode update.

    The state of a conversation is the size of what is always kept and the groups of turns that still fit; groups that do not
    fit now never will, so it holds at most ``max_length`` bytes' worth of them. With ``time_column`` it goes once the watermark
    is ``idle`` past the conversation's last turn. Turns come in order; one that is not later than the last is taken for a
    repeat.
    """
    first, unit, most = config.preserve_first_n, config.removal_unit, config.max_length
    kind = dict(turns.dtypes)[conv]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, fixed, begins, sizes, gone_at = state.get if state.exists else (0, None, 0, [], [], None)
        begins, sizes = list(begins), list(sizes)
        if time_column and gone_at is not None and state.getCurrentWatermarkMs() > gone_at:  # new turns came before the timer
            n, last, fixed, begins, sizes = 0, None, 0, [], []
        rows = pd.concat(list(batches)).sort_values("_turn")
        for at, size in zip(rows["_turn"].tolist(), rows["_size"].tolist(), strict=True):
            if last is not None and at <= last:
                continue
            if n < first:
                fixed += size
            elif unit == 0 or (n - first) % unit:
                begins, sizes = begins or [at], sizes or [0]
                sizes[-1] += size
            else:
                begins.append(at)
                sizes.append(size)
            n, last = n + 1, at
        # With groups of ``unit`` turns, all but the last are whole.
        while unit and sizes and fixed + sum(sizes) > most:
            begins.pop(0)
            sizes.pop(0)
        gone_at = max(int(rows["_time"].max()), state.getCurrentWatermarkMs()) + idle_ms if time_column else None
        state.update((n, last, fixed, begins, sizes, gone_at))
        if time_column:
            state.setTimeoutTimestamp(gone_at)
        tail = n - first
        kept = 0 if not sizes else tail if not unit else (len(sizes) - 1) * unit + ((tail - 1) % unit + 1)
        yield pd.DataFrame({conv: [key[0]], "kept_from": pd.array([begins[0] if begins else None], "Int64"), "n_kept": [min(n, first) + kept], "kept_bytes": [fixed + sum(sizes)], "n_turns": [n]})

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    if time_column:
        turns = turns.withWatermark(time_column, idle)
    at = [time_column, F.unix_millis(time_column).alias("_time")] if time_column else []
    rows = turns.select(conv, *at, F.col(turn).cast("bigint").alias("_turn"), F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint").alias("_size"))
    timeout = GroupStateTimeout.EventTimeTimeout if time_column else GroupStateTimeout.NoTimeout
    held = "n bigint, last bigint, fixed bigint, begins array<bigint>, sizes array<bigint>, gone_at bigint"
    return rows.groupBy(conv).applyInPandasWithState(update, f"{conv} {kind}, {TRIMMED}", held, "update", timeout)


def ranked_batches(results: DataFrame, query: str, path: str, config: ScoringConfig = ScoringConfig(), as_of=None, top: int = 50) -> DataStreamWriter:  # noqa: B008
    """Writes the best rows of each micro-batch under ``path``, in a folder of the batch's number, so a repeated batch replaces
    itself."""

    def write(batch: DataFrame, number: int) -> None:
        score.score_results(batch, query, config, as_of=as_of, limit=top).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write)
