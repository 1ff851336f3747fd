"""Scans, filters, joins, counts and pages over the store's tables.

Pages are numbered from 0; a negative page is the first, page sizes are clamped to 1..1000. Every
order ends with the key, so pages never overlap. A null removed flag counts as not removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorgrid.functions.survival import dead_interval
from moorgrid.functions.text import contains_pattern, plain_hex
from moorgrid.functions.timefmt import format_timedelta, since, strftime

PAGE_MAX = 1000


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the largest order columns of each key; an aggregate, so no key's rows meet in one sort."""
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("_r")).select("_r.*")


def current_nodes(nodes: DataFrame) -> DataFrame:
    return latest_per_key(nodes.where("dst IS NOT NULL"), "dst", "updated_at", "id", "time")


def current_peers(peers: DataFrame) -> DataFrame:
    return latest_per_key(peers.where("dst IS NOT NULL"), "dst", "updated_at", "id", "time")


def normal_address(c: Column) -> Column:
    """Lower case without surrounding white space of any script and angle brackets; null when nothing is left."""
    x = F.lower(F.regexp_replace(c, r"(?U)^[\s<>]+|[\s<>]+$", ""))
    return F.when(x != "", x)


def current_citations(citations: DataFrame) -> DataFrame:
    """One row per (target, source) in normal form: the row with the latest created_at, then id."""
    n = citations.select("id", normal_address(F.col("target_address")).alias("target_address"), normal_address(F.col("src_address")).alias("src_address"), "created_at", F.coalesce("removed", F.lit(False)).alias("removed"))
    n = n.where("target_address IS NOT NULL AND src_address IS NOT NULL")
    rank = F.struct("created_at", "id", "removed")
    return n.groupBy("target_address", "src_address").agg(F.max_by(F.struct("id", "created_at", "removed"), rank).alias("r")).select("r.id", "target_address", "src_address", "r.created_at", "r.removed")


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("removed", F.lit(False)))


def matching(df: DataFrame, query: str) -> DataFrame:
    """Name or address contains the text, in any case."""
    if not query:
        return df
    p = contains_pattern(query)
    return df.where(F.col("name").ilike(p) | F.col("dst").ilike(p))


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    page, size = max(0, int(page)), min(PAGE_MAX, max(1, int(size)))
    return df.orderBy(*order).offset(page * size).limit(size)


def pages_total(n: int, size: int) -> int:
    return max(1, -(-int(n) // max(1, int(size))))


def pages_total_column(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(max(1, int(size))))).cast("bigint")



def node_order() -> list[Column]:
    return [F.col("rank").desc_nulls_last(), F.col("time").desc_nulls_last(), F.col("dst").asc()]


def peer_order() -> list[Column]:
    return [F.col("time").desc_nulls_last(), F.col("dst").asc()]


def nodes_page(nodes: DataFrame, page: int = 0, size: int = 100, query: str = "") -> DataFrame:
    return page_of(matching(live(nodes), query), node_order(), page, size)


def peers_page(peers: DataFrame, page: int = 0, size: int = 100, query: str = "") -> DataFrame:
    return page_of(matching(peers, query), peer_order(), page, size)


def keyed(df: DataFrame) -> DataFrame:
    """Rows under their bracketed address."""
    return df.select(F.concat(F.lit("<"), "dst", F.lit(">")).alias("destination"), "identity", "name", "time")


def with_survival(nodes: DataFrame, as_of: float, ci: float = 0.90) -> DataFrame:
    low, high = dead_interval(F.col("announce_alpha"), F.col("announce_beta"), since(as_of, F.col("time")), ci)
    return nodes.withColumns({"p_dead_low": low, "p_dead_high": high})


def find_node(nodes: DataFrame, address: str, as_of: float) -> DataFrame:
    return with_survival(live(nodes).where(F.col("dst") == address).limit(1), as_of)


def owners(peers: DataFrame) -> DataFrame:
    """(identity, owner_name, owner_dst): the peer with the lowest id of each identity."""
    first = F.min(F.struct("id", "name", "dst"))
    return peers.where("identity IS NOT NULL").groupBy("identity").agg(first.alias("o")).select("identity", F.col("o.name").alias("owner_name"), F.col("o.dst").alias("owner_dst"))


def citation_counts(citations: DataFrame) -> DataFrame:
    """(target_address, citations): distinct live sources of each target."""
    return live(citations).groupBy("target_address").agg(F.countDistinct("src_address").alias("citations"))


def citation_sources(citations: DataFrame, target: str) -> DataFrame:
    return live(citations).where(F.col("target_address") == target).select("src_address").distinct()


def mentions_for(nodes: DataFrame, citations: DataFrame, target: str) -> DataFrame:
    """Live nodes that cite a target, best first."""
    return live(nodes).join(citation_sources(citations, target), F.col("dst") == F.col("src_address"), "left_semi").orderBy(*node_order())


def listing(nodes: DataFrame, peers: DataFrame, citations: DataFrame, as_of: float, page: int = 0, size: int = 20, query: str = "", mentions: str = "") -> DataFrame:
    """The nodes page: one page of nodes with owner, citation count and times; at most one search."""
    if query and mentions:
        raise ValueError("query and mentions_for exclude each other")
    base = mentions_for(nodes, citations, mentions) if mentions else matching(live(nodes), query)
    rows = page_of(base, node_order(), page, size)
    # the page has at most PAGE_MAX rows, so it is the side that is sent
    counts = live(citations).join(F.broadcast(rows.select(F.col("dst").alias("target_address"))), "target_address", "left_semi")
    out = rows.join(owners(peers), "identity", "left").join(citation_counts(counts), F.col("dst") == F.col("target_address"), "left")
    return out.select(
        "dst", "name", "identity", "rank", "time",
        F.coalesce("owner_name", F.lit("Unknown")).alias("owner_name"),
        F.coalesce("owner_dst", F.lit("Unknown")).alias("owner_dst"),
        F.coalesce("citations", F.lit(0)).cast("bigint").alias("citations"),
        strftime(F.col("time")).alias("last_announce"),
        format_timedelta(since(as_of, F.col("time"))).alias("since_announce"),
    )


def recent_nodes(nodes: DataFrame, as_of: float, within_seconds: float = 86400) -> DataFrame:
    """Addresses of live nodes heard of lately, newest first: the crawler's seeds."""
    return live(nodes).where(F.col("time") >= as_of - max(1.0, within_seconds)).orderBy(*peer_order()).select("dst", "time")


def recent_unique_queries(queries: DataFrame, limit: int = 200) -> DataFrame:
    g = queries.where("query IS NOT NULL").groupBy("query").agg(F.max("created_at").alias("created_at"), F.max("id").alias("id"))
    return g.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(limit)


def history_page(history: DataFrame, identity: str, page: int = 0, size: int = 20) -> DataFrame:
    own = history.where(F.col("remote_identity") == identity) if identity else history.limit(0)
    return page_of(own.distinct(), [F.col("time").desc_nulls_last(), F.col("id").desc()], page, size).select("id", F.col("query").alias("q"), "time")


def bracketed(c: Column) -> Column:
    return F.concat(F.lit("<"), plain_hex(c), F.lit(">"))
