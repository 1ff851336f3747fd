"""Keyed writes as pure functions from tables to the next version of the table.

Parquet tables have no MERGE, so each write is one join of the existing rows with the latest row
per key of the batch; the caller overwrites a versioned folder. Arrival order decides, not time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.functions.text import address_from_url


def last_arrival(batch: DataFrame, key: str = "dst", seq: str = "seq") -> DataFrame:
    cols = [c for c in batch.columns if c != key]
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("b")).select(key, "b.*")


def upsert_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """nodes (dst, identity, name, time, created_at, updated_at, rank, removed) after a batch (dst, identity, name, ts, seq).

    A known address is updated and lives again, with its rank and created_at kept; others are inserted."""
    b = last_arrival(batch).select("dst", F.col("identity").alias("_i"), F.col("name").alias("_n"), F.col("ts").alias("_t"))
    new = F.col("_t").isNotNull()
    return nodes.join(b, "dst", "full").select(
        "dst",
        F.when(new, F.col("_i")).otherwise(F.col("identity")).alias("identity"),
        F.when(new, F.col("_n")).otherwise(F.col("name")).alias("name"),
        F.coalesce("_t", "time").alias("time"),
        F.coalesce("created_at", "_t").alias("created_at"),
        F.coalesce("_t", "updated_at").alias("updated_at"),
        F.coalesce("rank", F.lit(0.0)).alias("rank"),
        F.when(new, False).otherwise(F.col("removed")).alias("removed"),
    )


def upsert_peers(peers: DataFrame, batch: DataFrame) -> DataFrame:
    """As upsert_nodes, without rank and removal."""
    same = peers.withColumns({"rank": F.lit(0.0), "removed": F.lit(False)})
    return upsert_nodes(same, batch).drop("rank", "removed")


def links_to_citations(pages: DataFrame, url: str = "url", links: str = "links") -> DataFrame:
    """(src, target) of the crawled pages' links: 32-character addresses other than the page's own.

    A crawled source without any such link stays as one row with a null target."""
    src = address_from_url(F.col(url))
    rows = pages.select(src.alias("src"), F.explode_outer(links).alias("l")).select("src", address_from_url(F.col("l")).alias("t"))
    return rows.select("src", F.when((F.length("t") == 32) & (F.col("t") != F.col("src")), F.col("t")).alias("target")).distinct()


def merge_citations(citations: DataFrame, found: DataFrame, now: float) -> DataFrame:
    """citations (target_address, src_address, created_at, removed) after a crawl that found (src, target).

    Of crawled sources, links found again live, links no longer found are removed, new ones are inserted."""
    crawled = found.select(F.col("src").alias("src_address"), F.lit(True).alias("_crawled")).distinct()
    new = found.where("target IS NOT NULL").select(F.col("src").alias("src_address"), F.col("target").alias("target_address"), F.lit(True).alias("_found")).distinct()
    joined = citations.select("src_address", "target_address", "created_at", "removed").join(crawled, "src_address", "left").join(new, ["src_address", "target_address"], "full")
    removed = F.when(F.col("_found"), False).when(F.col("_crawled"), True).otherwise(F.col("removed"))
    return joined.select("target_address", "src_address", F.coalesce("created_at", F.lit(float(now))).alias("created_at"), removed.alias("removed"))


def stale_nodes(nodes: DataFrame, as_of: float, days: float = 14) -> DataFrame:
    """Live nodes not heard of for that long."""
    limit = as_of - max(1, int(days * 86400))
    return nodes.where(~F.coalesce("removed", F.lit(False)) & (F.col("time") < limit)).select("dst")


def remove_stale(nodes: DataFrame, citations: DataFrame, as_of: float, days: float = 14) -> tuple[DataFrame, DataFrame]:
    """Both tables with stale nodes, and the citations from or to one, marked as removed.

    Two equi-joins instead of one with OR, which would compare all rows with all."""
    gone = stale_nodes(nodes, as_of, days).distinct()
    n = nodes.join(gone.withColumn("_gone", F.lit(True)), "dst", "left").withColumn("removed", F.coalesce("_gone", "removed")).drop("_gone")
    a = gone.select(F.col("dst").alias("src_address"), F.lit(True).alias("_a"))
    b = gone.select(F.col("dst").alias("target_address"), F.lit(True).alias("_b"))
    c = citations.join(a, "src_address", "left").join(b, "target_address", "left").withColumn("removed", F.coalesce("_a", "_b", "removed")).drop("_a", "_b")
    return n, c


def add_query(queries: DataFrame, query: str, now: float) -> DataFrame:
    """One more logged query; ids go on from the largest."""
    new = queries.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(query.strip()).alias("query"), F.lit(float(now)).alias("created_at"))
    return queries.select("id", "query", "created_at").unionByName(new)


def add_history(history: DataFrame, identity: str, query: str, now: float, time: float | None = None) -> DataFrame:
    """One more history row; nothing for an empty identity or query."""
    identity, query = (identity or "").strip(), (query or "").strip()
    if not identity or not query:
        return history
    new = history.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(identity).alias("remote_identity"), F.lit(query).alias("query"), F.lit(float(now if time is None else time)).alias("time"), F.lit(float(now)).alias("created_at"))
    return history.select(*new.columns).unionByName(new)


def rebuild_without(df: DataFrame, legacy: list[str], key: str = "dst") -> DataFrame:
    """A table without legacy columns, the latest row of each key kept."""
    from moorgrid.operators.relational import latest_per_key

    return latest_per_key(df.drop(*legacy), key, "updated_at", "id")


def add_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """A table with missing columns added under their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def write_back(table: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Computed columns written to rows of the same key; the others keep theirs."""
    if not columns:
        raise ValueError("no column to write")
    v = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(v, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) if c in table.columns else F.col(f"_new_{c}") for c in columns}).drop(*[f"_new_{c}" for c in columns])
