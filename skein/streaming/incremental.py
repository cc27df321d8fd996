"""Incremental matching and streaming score statistics.

Beyond the batch pipeline: a stream of newly delivered entities is matched
against a static knowledge base per micro-batch, and a stream of candidate
scores is reduced to windowed counts and sums with a watermark for late arrivals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.config import DEFAULT, EngineConfig
from skein.operators import blocking
from skein.operators.kb import normalized
from skein.plans.scratch import Scratch


def match_new_entities(stream: DataFrame, target: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: EngineConfig = DEFAULT):
    """Start a query that hands ``sink`` the exact alias matches of every micro-batch with ``target``.

    A replayed batch gives the same rows under the same id, so an idempotent
    sink is exactly-once.
    """
    known = Scratch(target.sparkSession, "incremental").save(blocking.alias_keys(normalized(target)), "keys")  # once, not per batch

    def run(batch: DataFrame, epoch: int) -> None:
        sink(blocking.key_matches(blocking.alias_keys(normalized(batch)), known, F.lit(True)), epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def score_windows(scores: DataFrame, time: str = "scored_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Per window of ``time``: rows, valid rows and the sum of their scores; works on streams and on tables."""
    valid = F.col("score").between(0, 1) & ~F.isnan("score")
    t = scores.withColumn("_t", F.col(time).cast("timestamp"))
    t = t.withWatermark("_t", late) if scores.isStreaming else t
    out = t.groupBy(F.window("_t", window).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"), F.round(F.sum(F.when(valid, F.col("score"))), 6).alias("sum_score"))
    return out.select(F.col("w.start").alias("window_start"), "n_rows", "n_valid", "sum_score")
