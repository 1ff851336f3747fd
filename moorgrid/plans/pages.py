"""Queries of the pages as requests, with their totals and what a search leaves behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from moorgrid import pages as P
from moorgrid.api import Request
from moorgrid.operators import relational as R
from moorgrid.plans import ranking as K
from moorgrid.plans import sql as Q
from moorgrid.plans import store as S
from moorgrid.plans.sql import AS_OF
from moorgrid.sources.tables import read

_NODE = ["dst", "name", "identity", "rank", "time", "owner_name", "owner_dst", "citations", "last_announce", "since_announce"]


def _site(spark, d, index=False):
    return P.Site(
        R.current_nodes(read(spark, d, "nodes")), R.current_peers(read(spark, d, "peers")), R.current_citations(read(spark, d, "citations")),
        read(spark, d, "search_queries"), read(spark, d, "user_search_history"), K._index(spark, d) if index else None, AS_OF,
    )


def _call(site, path, identity=None, **data):
    return P.app(site).call(Request(path, {k: str(v) for k, v in data.items()}, identity))


def _nodes(spark, d, **data):
    got = _call(_site(spark, d), "/page/nodes.mu", **data)
    return got["nodes"].select(*_NODE, F.lit(got["pages_total"]).cast("bigint").alias("pages_total"), F.lit(got["mentions_for"]).alias("mentions_for"))


def page_nodes(spark, d):
    return _nodes(spark, d, page=1)


def page_nodes_query(spark, d):
    return _nodes(spark, d, query=S.FIND)


def page_nodes_mentions(spark, d):
    return _nodes(spark, d, mentions_for=S.ADDRESS)


def page_peers(spark, d):
    got = _call(_site(spark, d), "/page/peers.mu", query=S.FIND)
    return got["peers"].select("dst", "name", "last_announce", "since_announce", F.lit(got["pages_total"]).cast("bigint").alias("pages_total"))


def page_home(spark, d):
    got = _call(_site(spark, d, True), "/page/index.mu")
    return got["queries"].select("query", F.lit(got["pages"]).cast("bigint").alias("pages"), F.lit(got["nodes"]).cast("bigint").alias("nodes"), F.lit(got["now"]).alias("now"))


def page_search(spark, d):
    got = _call(_site(spark, d, True), "/page/search.mu", query=K.QUERY)
    return got["entries"].select("url", "text", "owner", "address", "name", F.round("score", 6).alias("score"), F.lit(got["total"]).cast("bigint").alias("total"), F.lit(got["pages_total"]).cast("bigint").alias("pages_total"), "order_no")


def page_search_log(spark, d):
    """The query log after an identified caller's search."""
    site = _site(spark, d, True)
    _call(site, "/page/search.mu", S.IDENTITY, query=" " + K.QUERY)
    return site.queries


def page_history(spark, d):
    """The caller's history after one more search."""
    site = _site(spark, d, True)
    _call(site, "/page/search.mu", S.IDENTITY, query=K.QUERY)
    got = _call(site, "/page/history.mu", S.IDENTITY)
    return got["history"].select("q", "time", F.lit(got["total"]).cast("bigint").alias("total"), F.lit(got["pages_total"]).cast("bigint").alias("pages_total"))


QUERIES = {f.__name__: f for f in (page_nodes, page_nodes_query, page_nodes_mentions, page_peers, page_home, page_search, page_search_log, page_history)}


def _listing(where: str, offset: int = 0, mentions: str = "''") -> str:
    return f"""WITH {Q.NODES}, {Q.PEERS}, {Q.CITES}, {S._OWN}, {S._CC}, ba AS (SELECT * FROM ln WHERE {where}) SELECT dst, name, pg.identity, rank, "time", coalesce(owner_name, 'Unknown') AS owner_name, coalesce(owner_dst, 'Unknown') AS owner_dst,
coalesce(citations, 0) AS citations, {Q.strftime('time')} AS last_announce, {Q.timedelta(f'({AS_OF}::DOUBLE - time)')} AS since_announce, (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) FROM ba) AS pages_total, {mentions} AS mentions_for
FROM (SELECT * FROM ba ORDER BY {Q.NODE_ORDER} LIMIT 20 OFFSET {offset}) pg LEFT JOIN ow USING (identity) LEFT JOIN cc ON target_address = dst"""


_OWN_ROWS = f"SELECT DISTINCT id, query, \"time\" FROM user_search_history WHERE remote_identity = '{S.IDENTITY}' UNION ALL SELECT (SELECT max(id) + 1 FROM user_search_history), '{K.QUERY}', {AS_OF}::DOUBLE"

ORACLES = {
    "page_nodes": _listing("true", 20),
    "page_nodes_query": _listing(S._FIND),
    "page_nodes_mentions": _listing(f"dst IN (SELECT src_address FROM lc WHERE target_address = '{S.ADDRESS}')", 0, f"(SELECT coalesce(max(name), '') FROM ln WHERE dst = '{S.ADDRESS}')"),
    "page_peers": f"WITH {Q.PEERS}, ba AS (SELECT * FROM p0 WHERE {S._FIND}) SELECT dst, name, {Q.strftime('time')} AS last_announce, {Q.timedelta(f'({AS_OF}::DOUBLE - time)')} AS since_announce, (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) FROM ba) AS pages_total FROM (SELECT * FROM ba ORDER BY {Q.PEER_ORDER} LIMIT 20)",
    "page_home": f"WITH {Q.NODES} SELECT query, (SELECT count(DISTINCT url) FROM search_documents) AS pages, (SELECT count(*) FROM ln) AS nodes, strftime(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)), '%d.%m.%Y, %H:%M:%S') AS now FROM ({S._RECENT} 10)",
    "page_search": f"""{K._RANK} SELECT url, replace(regexp_replace(text, '[{Q.SPACE}]+', ' ', 'g'), '``', '') AS text, owner, rk.address, CASE WHEN ln.name IS NOT NULL THEN ln.name || ' ' || split_part(url, ':', 2) ELSE url END AS name, round(rk.score, 6) AS score,
(SELECT count(*) FROM rk) AS total, (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) FROM rk) AS pages_total, order_no FROM rk LEFT JOIN ln ON ln.dst = rk.address WHERE order_no <= 20""",
    "page_search_log": f"SELECT id, query, created_at FROM search_queries UNION ALL SELECT (SELECT max(id) + 1 FROM search_queries), '{K.QUERY}', {AS_OF}::DOUBLE",
    "page_history": f"WITH own AS ({_OWN_ROWS}) SELECT query AS q, \"time\", (SELECT count(*) FROM own) AS total, (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) FROM own) AS pages_total FROM (SELECT * FROM own ORDER BY \"time\" DESC NULLS LAST, id DESC LIMIT 20)",
}
