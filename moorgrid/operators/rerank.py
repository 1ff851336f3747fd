"""Ranking of retrieved documents: duplicates, a cap per address, and the blend with rank and liveness.

Order of steps: first hit per url, first MAX_SAME_ADDRESS hits per address (both by retrieval
order), node features by address (a miss has rank 0 and is alive), normalisation over what is left,
blend, and the sort with the confidently dead last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorgrid.functions.survival import dead_interval
from moorgrid.functions.timefmt import since
from moorgrid.operators.relational import live
from moorgrid.operators.search import numbered
from moorgrid.session import checkpoint

W_TEXT, W_RANK, W_ALIVE = 0.65, 0.25, 0.10
DEAD_ABOVE, MAX_SAME_ADDRESS = 0.9, 2


def first_per_url(hits: DataFrame) -> DataFrame:
    """The first hit of each url in retrieval order."""
    w = Window.partitionBy("url").orderBy(F.desc("score"))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_address(hits: DataFrame, most: int = MAX_SAME_ADDRESS) -> DataFrame:
    """The first hits of each address. A window group limit keeps only that many rows of a hot address before the shuffle."""
    w = Window.partitionBy("address").orderBy(F.desc("score"), F.asc("url"))
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def node_features(nodes: DataFrame, as_of: float) -> DataFrame:
    """(address, rank, p_dead_low, p_dead_high, last_seen) of live nodes."""
    low, high = dead_interval(F.col("announce_alpha"), F.col("announce_beta"), since(as_of, F.col("time")))
    return live(nodes).select(F.col("dst").alias("address"), F.col("rank").cast("double").alias("rank"), low.alias("p_dead_low"), high.alias("p_dead_high"), F.col("time").alias("last_seen"))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """x between low and high as a share; 0 where they are equal."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))


def place_order() -> list[Column]:
    return [F.asc("dead"), F.desc("score"), F.desc("found"), F.asc("url")]


def rerank(hits: DataFrame, nodes: DataFrame, as_of: float, cap: int = MAX_SAME_ADDRESS, weights: tuple[float, float, float] = (W_TEXT, W_RANK, W_ALIVE)) -> DataFrame:
    """hits (url, owner, address, name, score) with the blend as score; dead, found (the score before) and place_order give the order.

    weights: of the text score, the rank and the liveness."""
    kept = cap_per_address(first_per_url(hits), cap)
    # only the hits' addresses need features, so the quantiles are solved for few nodes
    own = live(nodes).join(kept.select(F.col("address").alias("dst")).distinct(), "dst", "left_semi")
    rows = kept.join(node_features(own, as_of), "address", "left").fillna(0.0, ["rank", "p_dead_low", "p_dead_high", "last_seen"])
    rows = checkpoint(rows.withColumn("_r", F.log1p(F.greatest("rank", F.lit(0.0)))))
    span = rows.agg(F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("_r").alias("r0"), F.max("_r").alias("r1"), F.lit(1).alias("_one"))
    both = rows.join(F.broadcast(span), F.lit(1) == F.col("_one"))  # one row
    alive = 1 - (F.col("p_dead_low") + F.col("p_dead_high")) / 2
    text, rank, life = weights
    blend = text * minmax(F.col("score"), F.col("s0"), F.col("s1")) + rank * minmax(F.col("_r"), F.col("r0"), F.col("r1")) + life * F.greatest(F.lit(0.0), F.least(F.lit(1.0), alive))
    return both.select("url", "owner", "address", "name", F.round(blend, 9).alias("score"), "p_dead_low", "p_dead_high", F.col("last_seen").alias("time"), (F.col("p_dead_low") > DEAD_ABOVE).alias("dead"), F.col("score").alias("found"))


def ranked(rows: DataFrame) -> DataFrame:
    """All rows with their place order_no."""
    return numbered(rows, place_order(), "order_no")


def top(rows: DataFrame, page: int = 0, size: int = 20) -> DataFrame:
    """One page of the order with order_no: a top-k, so no sort of all rows and no text of other pages."""
    got = rows.orderBy(*place_order()).offset(page * size).limit(size)
    return got.withColumn("order_no", (F.row_number().over(Window.orderBy(*place_order())) + page * size).cast("bigint"))  # the page's rows only
