"""PageRank over citations by power iteration of joins and aggregates.

Edges are distinct; edges to unknown vertices are dropped before degrees are counted; the mass of
vertices without out-edges and the teleport go to the teleport weights. The result is scaled to
mean 1. Ranks are checkpointed to shared storage, so a lost executor costs no earlier round.

Every graph takes the same plan whatever its size. Rounds between two tests of convergence are one job;
a test reads the norm and the change of the last round from one aggregate, so it costs one action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.session import checkpoint


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, alpha: float = 0.15, max_iters: int = 100, tol: float = 1e-10, personalize: DataFrame | None = None, every: int = 3) -> DataFrame:
    """(v, score) from edges (src, dst), vertices (v) and optional teleport weights (v, weight).

    every: rounds in one job. Each round is tested; ranks of the first round whose change falls below tol
    are the result, so its number does not depend on every."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    if max_iters < 1 or every < 1:
        raise ValueError("max_iters must be at least 1")
    if tol <= 0:
        raise ValueError("tol must be positive")
    if vertices is None:
        vertices = edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v")))
    base = vertices.where("v IS NOT NULL").distinct()
    if personalize is not None:
        w = personalize.where("weight > 0").groupBy("v").agg(F.sum("weight").alias("weight"))
        base = base.join(w, "v", "left").select("v", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        base = base.select("v", F.lit(0.0).alias("weight"))
    base = checkpoint(base)
    n, total = base.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if not n:
        return base.select("v", F.lit(0.0).alias("score"))
    share = F.col("weight") / F.lit(float(total)) if total and total > 0 else F.lit(1.0 / n)
    known = base.select("v")
    e = edges.select("src", "dst").distinct()
    e = e.join(known.withColumnRenamed("v", "src"), "src", "left_semi").join(known.withColumnRenamed("v", "dst"), "dst", "left_semi")
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    e = checkpoint(e.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("part")).repartition("src"))
    state = base.select("v", share.alias("t")).join(degree.select(F.col("src").alias("v"), F.lit(False).alias("dangling")), "v", "left")
    state = checkpoint(state.select("v", "t", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("r")))
    done = 0
    while done < max_iters:
        rounds = min(every, max_iters - done)
        # r0, r1, ...: the ranks after each round of this job; a round's mass is kept at one by its sum
        step = state.withColumnRenamed("r", "r0")
        for i in range(rounds):
            now, new = f"r{i}", f"r{i + 1}"
            sent = e.join(step.select(F.col("v").alias("src"), now), "src").groupBy("dst").agg(F.sum(F.col(now) * F.col("part")).alias("got")).withColumnRenamed("dst", "v")
            lost = step.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col(now))), F.lit(0.0)).alias("lost"), F.sum(now).alias("mass"), F.sum("t").alias("teleport"), F.lit(1).alias("_one"))
            joined = step.join(sent, "v", "left").join(F.broadcast(lost), F.lit(1) == F.col("_one"))  # one row
            raw = (1 - alpha) * F.coalesce("got", F.lit(0.0)) + (F.lit(alpha) + (1 - alpha) * F.col("lost")) * F.col("t")
            # the sum of all raw ranks: what the edges carry, what dangling vertices lose, and the teleport
            total = (1 - alpha) * (F.col("mass") - F.col("lost")) + (F.lit(alpha) + (1 - alpha) * F.col("lost")) * F.col("teleport")
            step = joined.select("v", "t", "dangling", *[f"r{j}" for j in range(i + 1)], F.when(total > 0, raw / total).otherwise(raw).alias(new))
        step = checkpoint(step)
        change = step.agg(*[F.sum(F.abs(F.col(f"r{i + 1}") - F.col(f"r{i}"))) for i in range(rounds)]).first()
        below = [i for i in range(rounds) if change[i] < tol]
        last = below[0] + 1 if below else rounds
        state = step.select("v", "t", "dangling", F.col(f"r{last}").alias("r"))
        if below:
            break
        done += rounds
    return state.select("v", (F.col("r") * n).alias("score"))


def live_graph(citations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of live citations and live nodes."""
    from moorgrid.operators.relational import live

    return live(citations).select(F.col("src_address").alias("src"), F.col("target_address").alias("dst")), live(nodes).select(F.col("dst").alias("v"))
