"""Posterior parameters of each node's announce rate from its recent announces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.functions.survival import PRIOR_ALPHA, PRIOR_BETA
from moorgrid.operators.relational import live

LOOKBACK_DAYS = 14


def window_seconds(announces: DataFrame, as_of: float, lookback_days: float = LOOKBACK_DAYS) -> DataFrame:
    """(window_s): one row, the time since the earliest announce of all, at most the look-back."""
    most = max(1, int(lookback_days)) * 86400
    age = F.floor(F.lit(float(as_of)) - F.min("ts"))
    return announces.agg(F.coalesce(F.least(F.greatest(age, F.lit(0)), F.lit(most)), F.lit(0)).cast("double").alias("window_s"))


def node_parameters(nodes: DataFrame, announces: DataFrame, as_of: float, lookback_days: float = LOOKBACK_DAYS) -> DataFrame:
    """(dst, announce_alpha, announce_beta, announce_window_seconds, announce_k_events) of every live node.

    alpha = 1 + events, beta = 1800 s + window; a node without announces keeps k = 0."""
    since = as_of - max(1, int(lookback_days)) * 86400
    k = announces.where(F.col("ts") >= since).groupBy("dst").agg(F.count(F.lit(1)).alias("k"))
    w = window_seconds(announces, as_of, lookback_days).withColumn("_one", F.lit(1))
    rows = live(nodes).select("dst").join(k, "dst", "left").join(F.broadcast(w), F.lit(1) == F.col("_one"))
    k = F.coalesce("k", F.lit(0))
    return rows.select("dst", (PRIOR_ALPHA + k).cast("double").alias("announce_alpha"), (PRIOR_BETA + F.col("window_s")).alias("announce_beta"), F.col("window_s").alias("announce_window_seconds"), k.cast("int").alias("announce_k_events"))
