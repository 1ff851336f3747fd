"""The five pages as requests: their rows as DataFrames, their totals, and the writes that a search leaves.

A Site holds the tables of the store as DataFrames and the stored index. A search logs its query (first
page only) and, for an identified caller, a history row; both replace the table by its next version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.api import App, NotIdentified, Request
from moorgrid.config import Settings
from moorgrid.functions.text import format_text, path_from_url
from moorgrid.functions.timefmt import format_timedelta, java_pattern, since, strftime
from moorgrid.operators import graph, posterior, rerank
from moorgrid.operators import relational as R
from moorgrid.operators import upsert as U
from moorgrid.operators.search import Index

PAGE_SIZE = 20


@dataclass
class Site:
    nodes: DataFrame
    peers: DataFrame
    citations: DataFrame
    queries: DataFrame
    history: DataFrame
    index: Index
    as_of: float
    time_format: str = Settings.TIME_FORMAT

    def now(self) -> str:
        one = self.nodes.sparkSession.range(1).select(strftime(F.lit(float(self.as_of)), java_pattern(self.time_format)))
        return one.first()[0]


def _bounds(page: int, size: int) -> tuple[int, int]:
    return max(0, page), min(R.PAGE_MAX, max(1, size))


def home(site: Site) -> dict:
    n = site.index.totals()["n_docs"]
    return {"pages": n, "nodes": R.live(site.nodes).count(), "queries": R.recent_unique_queries(site.queries, 10), "now": site.now()}


def nodes(site: Site, query: str = "", mentions_for: str = "", page: int = 0, page_size: int = PAGE_SIZE) -> dict:
    """One of three lists: nodes that cite an address, nodes that match, or all."""
    if query and mentions_for:
        raise ValueError("query and mentions_for exclude each other")
    page, size = _bounds(page, page_size)
    base = R.mentions_for(site.nodes, site.citations, mentions_for) if mentions_for else R.matching(R.live(site.nodes), query)
    rows = R.listing(site.nodes, site.peers, site.citations, site.as_of, page, size, query, mentions_for)
    cited = R.live(site.nodes).where(F.col("dst") == mentions_for).select("name").first() if mentions_for else None
    return {"nodes": rows, "pages_total": R.pages_total(base.count(), size), "mentions_for": cited[0] if cited else "", "query": query, "page": page, "page_size": size, "now": site.now()}


def peers(site: Site, query: str = "", page: int = 0, page_size: int = PAGE_SIZE) -> dict:
    page, size = _bounds(page, page_size)
    rows = R.peers_page(site.peers, page, size, query)
    shown = rows.select("dst", "name", strftime(F.col("time")).alias("last_announce"), format_timedelta(since(site.as_of, F.col("time"))).alias("since_announce"))
    return {"peers": shown.orderBy(F.desc("last_announce"), "dst"), "pages_total": R.pages_total(R.matching(site.peers, query).count(), size), "query": query, "page": page, "page_size": size, "now": site.now()}


def search(site: Site, request: Request, query: str, page: int = 0, page_size: int = PAGE_SIZE) -> dict:
    """A page of ranked results; the text as typed is searched, the cleaned one is logged."""
    page, size = _bounds(page, page_size)
    clean = " ".join(query.split())
    if page == 0:
        site.queries = U.add_query(site.queries, clean, site.as_of)
    made = site.index.cached(query, lambda: rerank.rerank(site.index.search(query), site.nodes, site.as_of), site.as_of)
    if request.identity:
        site.history = U.add_history(site.history, request.identity, clean, site.as_of)
    total = made.count()
    return {"entries": entries(site, rerank.top(made, page, size)), "total": total, "pages_total": R.pages_total(total, size), "query": clean, "page": page, "page_size": size}


def entries(site: Site, page: DataFrame) -> DataFrame:
    """Rows of a page of results with texts and the names of their nodes; the page is a top-k, so it is what is sent."""
    node = R.live(site.nodes).select(F.col("dst").alias("address"), F.col("name").alias("node_name"))
    ago = F.when(F.col("time") != 0, format_timedelta(since(site.as_of, F.col("time"))))
    name = F.when(F.col("node_name").isNotNull(), F.concat("node_name", F.lit(" "), path_from_url(F.col("url")))).otherwise(F.col("url"))
    shown = node.join(F.broadcast(page), "address", "right").select(*page.columns, "node_name")
    texts = site.index.docs().select("url", "text")
    return texts.join(F.broadcast(shown), "url").select("url", format_text(F.col("text")).alias("text"), "owner", "address", name.alias("name"), "score", "p_dead_low", "p_dead_high", "time", ago.alias("since_announce"), "order_no")


def history(site: Site, request: Request, page: int = 0, page_size: int = PAGE_SIZE) -> dict:
    page, size = _bounds(page, page_size)
    rows = R.history_page(site.history, request.identity or "", page, size)
    total = site.history.where(F.col("remote_identity") == (request.identity or "")).distinct().count()
    return {"history": rows, "total": total, "pages_total": R.pages_total(total, size), "page": page, "page_size": size}


def result_maps(rows: DataFrame) -> DataFrame:
    """(result): each row as a map from names to texts without the nulls."""
    pairs = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return rows.select(F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("result"))


def app(site: Site) -> App:
    """The pages under their paths; an unidentified caller of a page that needs an identity gets a note instead."""
    a = App.with_defaults()
    a.request("/page/index.mu")(lambda: home(site))

    @a.request("/page/nodes.mu")
    def _nodes(query: str = "", mentions_for: str = "", page: int = 0, page_size: int = PAGE_SIZE):
        return nodes(site, query, mentions_for, page, page_size)

    @a.request("/page/peers.mu")
    def _peers(query: str = "", page: int = 0, page_size: int = PAGE_SIZE):
        return peers(site, query, page, page_size)

    @a.request("/page/search.mu")
    def _search(r: Request, query: str, page: int = 0, page_size: int = PAGE_SIZE):
        return search(site, r, query, page, page_size)

    @a.request("/page/history.mu", identifying_required=True)
    def _history(r: Request, page: int = 0, page_size: int = PAGE_SIZE):
        return history(site, r, page, page_size)

    a.exception(NotIdentified)(lambda e: {"not_identified": True})
    return a


def rank_job(site: Site) -> None:
    """Ranks of live nodes written back."""
    edges, vertices = graph.live_graph(site.citations, site.nodes)
    site.nodes = U.write_back(site.nodes, graph.pagerank(edges, vertices).select(F.col("v").alias("dst"), F.col("score").alias("rank")), "dst", ["rank"])


def survival_job(site: Site, announces: DataFrame) -> None:
    """Posterior fields of live nodes written back."""
    p = posterior.node_parameters(site.nodes, announces, site.as_of)
    site.nodes = U.write_back(site.nodes, p, "dst", [c for c in p.columns if c != "dst"])


def stale_job(site: Site, days: float = 14) -> None:
    """Stale nodes and their citations are marked as removed, their documents leave the index."""
    gone = U.stale_nodes(site.nodes, site.as_of, days)
    site.index.delete_by_address(gone)
    site.nodes, site.citations = U.remove_stale(site.nodes, site.citations, site.as_of, days)


# Seconds between two runs of each job.
JOBS = {"rank": (6 * 3600, rank_job), "survival": (6 * 3600, survival_job), "stale": (86400, stale_job)}


def due(last: dict[str, float], now: float) -> list[str]:
    """Names of the jobs whose time has come; a job that never ran is due."""
    return [n for n, (period, _) in JOBS.items() if now - last.get(n, float("-inf")) >= period]
