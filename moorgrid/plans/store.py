"""Queries of the store: listings, pages, counts, keyed writes, imports and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from moorgrid.functions import text as X
from moorgrid.functions import timefmt as D
from moorgrid.functions.survival import status_icon
from moorgrid.operators import relational as R
from moorgrid.operators import upsert as U
from moorgrid.plans import sql as Q
from moorgrid.plans.sql import AS_OF
from moorgrid.sources import announces as A
from moorgrid.sources import legacy as L
from moorgrid.sources.tables import read

ADDRESS = "0deafc8fec30eee86936ccaff729d592"
IDENTITY = "02ff4e7f5aeee8a3e36e666972ed900e"
FIND = "ol"
DAYS = 14
_PAGE = ["dst", "identity", "name", "time", "rank"]
_PEER = ["dst", "identity", "name", "time"]


def _nodes(spark, d):
    return R.current_nodes(read(spark, d, "nodes"))


def _peers(spark, d):
    return R.current_peers(read(spark, d, "peers"))


def _cites(spark, d):
    return R.current_citations(read(spark, d, "citations"))


def nodes_all(spark, d):
    return R.keyed(R.live(_nodes(spark, d)))


def peers_all(spark, d):
    return R.keyed(_peers(spark, d))


def node_lookup(spark, d):
    return R.find_node(_nodes(spark, d), ADDRESS, AS_OF).select("dst", "name", "identity", "rank", "time", F.round("p_dead_low", 6).alias("p_dead_low"), F.round("p_dead_high", 6).alias("p_dead_high"))


def owner_lookup(spark, d):
    return R.owners(_peers(spark, d))


def nodes_count(spark, d):
    return R.live(_nodes(spark, d)).agg(F.count(F.lit(1)).alias("n"))


def peers_count(spark, d):
    return _peers(spark, d).agg(F.count(F.lit(1)).alias("n"))


def nodes_count_filtered(spark, d):
    return R.matching(R.live(_nodes(spark, d)), FIND).agg(F.count(F.lit(1)).alias("n"))


def peers_count_filtered(spark, d):
    return R.matching(_peers(spark, d), FIND).agg(F.count(F.lit(1)).alias("n"))


def nodes_page(spark, d):
    return R.nodes_page(_nodes(spark, d), 0, 100).select(*_PAGE)


def nodes_page_filtered(spark, d):
    return R.nodes_page(_nodes(spark, d), 1, 20, FIND).select(*_PAGE)


def peers_page(spark, d):
    return R.peers_page(_peers(spark, d), 0, 100).select(*_PEER)


def peers_page_filtered(spark, d):
    return R.peers_page(_peers(spark, d), 1, 5, FIND).select(*_PEER)


def peers_page_daytext(spark, d):
    """One page of peers with display times, ordered by the text of the day."""
    rows = R.peers_page(_peers(spark, d), 0, 20)
    return rows.select("dst", "name", D.strftime(F.col("time")).alias("last_announce"), D.format_timedelta(D.since(AS_OF, F.col("time"))).alias("since_announce")).orderBy(F.col("last_announce").desc(), "dst")


def nodes_listing(spark, d):
    return R.listing(_nodes(spark, d), _peers(spark, d), _cites(spark, d), AS_OF, 0, 50)


def nodes_mentions(spark, d):
    return R.mentions_for(_nodes(spark, d), _cites(spark, d), ADDRESS).select(*_PAGE)


def nodes_survival(spark, d):
    """Every live node with its interval of P(dead) and its status."""
    n = R.with_survival(R.live(_nodes(spark, d)), AS_OF)
    return n.select("dst", F.round("p_dead_low", 6).alias("p_dead_low"), F.round("p_dead_high", 6).alias("p_dead_high"), status_icon(F.col("p_dead_low"), F.col("p_dead_high")).alias("status"))


def pages_total(spark, d):
    return R.live(_nodes(spark, d)).agg(R.pages_total_column(F.count(F.lit(1)), 20).alias("pages_total"))


def crawl_seeds(spark, d):
    return R.recent_nodes(_nodes(spark, d), AS_OF, DAYS * 86400)


def recent_queries_unique(spark, d):
    return R.recent_unique_queries(read(spark, d, "search_queries"), 200)


def home_recent(spark, d):
    return R.recent_unique_queries(read(spark, d, "search_queries"), 10)


def home_summary(spark, d):
    docs = read(spark, d, "search_documents").where("url IS NOT NULL").agg(F.countDistinct("url").alias("index_size"))
    nodes = R.live(_nodes(spark, d)).agg(F.count(F.lit(1)).alias("n_nodes"))
    return docs.withColumn("_k", F.lit(1)).join(nodes.withColumn("_k", F.lit(1)), "_k").drop("_k")


def history_page(spark, d):
    return R.history_page(read(spark, d, "user_search_history"), IDENTITY, 1, 50)


def history_count(spark, d):
    return read(spark, d, "user_search_history").where(F.col("remote_identity") == IDENTITY).distinct().agg(F.count(F.lit(1)).alias("n"))


def citation_sources(spark, d):
    return R.citation_sources(_cites(spark, d), ADDRESS)


def citation_counts(spark, d):
    return R.citation_counts(_cites(spark, d))


def latest_per_key(spark, d):
    return R.latest_per_key(read(spark, d, "nodes"), "dst", "updated_at", "id").select("dst", "id", "updated_at", "removed")


def _batch(spark, d):
    """Announces of every address that a citation names."""
    c = read(spark, d, "citations").distinct()
    return c.select(R.normal_address(F.col("target_address")).alias("dst"), R.normal_address(F.col("src_address")).alias("identity"), F.concat(F.lit("seen "), F.col("id").cast("string")).alias("name"), F.col("created_at").alias("ts"), F.col("id").alias("seq"))


_UPSERTED = ["dst", "identity", "name", "time", "created_at", "updated_at"]


def node_upsert(spark, d):
    return U.upsert_nodes(_nodes(spark, d), _batch(spark, d)).select(*_UPSERTED, "rank", "removed")


def peer_upsert(spark, d):
    return U.upsert_peers(_peers(spark, d), _batch(spark, d)).select(*_UPSERTED)


def _crawled(spark, d):
    docs = read(spark, d, "documents").where("url IS NOT NULL AND text IS NOT NULL")
    inside, outside = X.resolve_links(X.address_from_url(F.col("url")), F.col("text"))
    return docs.select("url", F.concat(inside, outside).alias("links"))


def citations_merge(spark, d):
    return U.merge_citations(_cites(spark, d), U.links_to_citations(_crawled(spark, d)), AS_OF)


def stale_nodes(spark, d):
    return U.stale_nodes(_nodes(spark, d), AS_OF, DAYS)


def stale_citations(spark, d):
    return U.remove_stale(_nodes(spark, d), _cites(spark, d), AS_OF, DAYS)[1].select("target_address", "src_address", "removed")


def legacy_explode(spark, d):
    """Citations written as one old JSON map and read back."""
    c = read(spark, d, "citations").where("target_address IS NOT NULL AND src_address IS NOT NULL")
    per = c.groupBy("target_address").agg(F.collect_list("src_address").alias("s"))
    text = per.select(F.to_json(F.struct(F.create_map("target_address", "s").alias("for_search"))).alias("value"))
    return L.citations(L.parse(text, "citations"))


def legacy_announces(spark, d):
    """Nodes written as old JSON maps by address and read back."""
    v = F.struct("dst", "identity", "name", "time")
    per = _nodes(spark, d).groupBy(F.substring("dst", 1, 2)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("dst"), v))).alias("nodes"))
    return L.announces(L.parse(per.select(F.to_json(F.struct("nodes")).alias("value")), "announces"), "nodes")


def legacy_queries(spark, d):
    """Queries written as old JSON lists and read back."""
    per = read(spark, d, "search_queries").groupBy(F.floor(F.col("id") / 1000)).agg(F.collect_list("query").alias("queries"))
    return L.queries(L.parse(per.select(F.to_json(F.struct("queries")).alias("value")), "queries"))


def legacy_user_data(spark, d):
    """History written as old JSON maps by identity and read back; one identity's rows lie in many files."""
    h = read(spark, d, "user_search_history").where("remote_identity IS NOT NULL")
    per = h.groupBy("remote_identity", F.floor(F.col("id") / 1000)).agg(F.collect_list(F.struct(F.col("query").alias("q"), "time")).alias("items"))
    return L.user_data(L.parse(per.select(F.to_json(F.create_map("remote_identity", "items")).alias("value")), "user_data"))


def _log_lines(spark, d):
    """Events as announce lines, with the kinds of broken lines that a log has."""
    e = read(spark, d, "events")
    good = F.concat(F.lit('{"datetime": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('", "dst": "'), F.md5(F.concat(F.lit("src"), F.col("user_id").cast("string"))), F.lit('"}'))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), good)).when(F.col("event_type") == "signup", F.lit("")).when(F.col("event_type") == "purchase", F.lit('{"datetime": "yesterday", "dst": "x"}'))
    return e.select(F.coalesce(line, good).alias("value"))


def announce_log_scan(spark, d):
    got = A.recent(A.parse_lines(_log_lines(spark, d)), 1706659200.0, DAYS)
    return got.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("ts"), 6).alias("first_ts"), F.round(F.max("ts"), 6).alias("last_ts"))


def strip_markup(spark, d):
    return read(spark, d, "documents").select("doc_id", X.strip_markup(F.col("text")).alias("plain"))


def extract_links(spark, d):
    return _crawled(spark, d).select("url", F.explode("links").alias("link")).distinct()


def link_classes(spark, d):
    docs = read(spark, d, "documents").where("url IS NOT NULL AND text IS NOT NULL")
    raw = docs.select("url", F.explode(F.array_distinct(X.extract_links(F.col("text")))).alias("raw"))
    return raw.distinct().groupBy(X.is_external(F.col("raw")).alias("external")).agg(F.count(F.lit(1)).alias("n"))


def address_from_url(spark, d):
    u = F.col("url")
    return read(spark, d, "search_documents").where("url IS NOT NULL").select("url", X.address_from_url(u).alias("address"), X.path_from_url(u).alias("path")).distinct()


def format_text(spark, d):
    return read(spark, d, "documents").select("doc_id", X.format_text(F.col("text")).alias("line"))


def replace_malformed(spark, d):
    return read(spark, d, "documents").select("doc_id", X.replace_malformed(F.col("text")).alias("clean"))


def clean_queries(spark, d):
    return read(spark, d, "search_queries").distinct().select("id", X.clean_query(F.col("query")).alias("query"))


def since_text(spark, d):
    n = _nodes(spark, d)
    return n.select("dst", D.strftime(F.col("time")).alias("shown"), D.format_timedelta(D.since(AS_OF, F.col("time"))).alias("since"))


QUERIES = {f.__name__: f for f in (
    nodes_all, peers_all, node_lookup, owner_lookup, nodes_count, peers_count, nodes_count_filtered, peers_count_filtered, nodes_page, nodes_page_filtered,
    peers_page, peers_page_filtered, peers_page_daytext, nodes_listing, nodes_mentions, nodes_survival, pages_total, crawl_seeds, recent_queries_unique, home_recent, home_summary,
    history_page, history_count, citation_sources, citation_counts, latest_per_key, node_upsert, peer_upsert, citations_merge, stale_nodes, stale_citations, legacy_explode, legacy_announces, legacy_queries, legacy_user_data,
    announce_log_scan, strip_markup, extract_links, link_classes, address_from_url, format_text, replace_malformed, clean_queries, since_text,
)}

_W, _P = f"WITH {Q.NODES}", f"WITH {Q.PEERS}"
_FIND = f"(name ILIKE '%{FIND}%' OR dst ILIKE '%{FIND}%')"
_RECENT = "SELECT query, max(created_at) AS created_at, max(id) AS id FROM search_queries WHERE query IS NOT NULL GROUP BY query ORDER BY created_at DESC, id DESC LIMIT"
_KEYED = "'<' || dst || '>' AS destination, identity, name, \"time\""
_OWN = "ow AS (SELECT identity, first(name ORDER BY id) AS owner_name, first(dst ORDER BY id) AS owner_dst FROM p0 WHERE identity IS NOT NULL GROUP BY identity)"
_CC = "cc AS (SELECT target_address, count(DISTINCT src_address) AS citations FROM lc GROUP BY 1)"
_BATCH = f"""ba AS (SELECT * FROM (SELECT {Q.address('target_address')} AS dst, {Q.address('src_address')} AS bi, 'seen ' || id AS bn, created_at AS bt, id FROM (SELECT DISTINCT * FROM citations)) WHERE dst IS NOT NULL),
lb AS (SELECT dst, arg_max(bi, id) AS bi0, first(bi ORDER BY id DESC) AS bi, first(bn ORDER BY id DESC) AS bn, first(bt ORDER BY id DESC) AS bt FROM ba GROUP BY dst)"""
_UP = """coalesce(o.dst, lb.dst) AS dst, CASE WHEN bt IS NOT NULL THEN bi ELSE identity END AS identity, CASE WHEN bt IS NOT NULL THEN bn ELSE name END AS name,
coalesce(bt, "time") AS "time", coalesce(created_at, bt) AS created_at, coalesce(bt, updated_at) AS updated_at"""
_GONE = f"go AS (SELECT dst FROM ln WHERE \"time\" < {AS_OF - DAYS * 86400}::DOUBLE)"

ORACLES = {
    "nodes_all": f"{_W} SELECT {_KEYED} FROM ln",
    "peers_all": f"{_P} SELECT {_KEYED} FROM p0",
    "node_lookup": f"WITH RECURSIVE {Q.NODES}, {Q.features()} SELECT dst, ln.name, identity, ln.rank, ln.\"time\", round(p_dead_low, 6) AS p_dead_low, round(p_dead_high, 6) AS p_dead_high FROM ln JOIN ns USING (dst) WHERE dst = '{ADDRESS}'",
    "owner_lookup": f"{_P}, {_OWN} SELECT identity, owner_name, owner_dst FROM ow",
    "nodes_count": f"{_W} SELECT count(*) AS n FROM ln",
    "peers_count": f"{_P} SELECT count(*) AS n FROM p0",
    "nodes_count_filtered": f"{_W} SELECT count(*) AS n FROM ln WHERE {_FIND}",
    "peers_count_filtered": f"{_P} SELECT count(*) AS n FROM p0 WHERE {_FIND}",
    "nodes_page": f"{_W} SELECT {', '.join(_PAGE)} FROM ln ORDER BY {Q.NODE_ORDER} LIMIT 100",
    "nodes_page_filtered": f"{_W} SELECT {', '.join(_PAGE)} FROM ln WHERE {_FIND} ORDER BY {Q.NODE_ORDER} LIMIT 20 OFFSET 20",
    "peers_page": f"{_P} SELECT {', '.join(_PEER)} FROM p0 ORDER BY {Q.PEER_ORDER} LIMIT 100",
    "peers_page_filtered": f"{_P} SELECT {', '.join(_PEER)} FROM p0 WHERE {_FIND} ORDER BY {Q.PEER_ORDER} LIMIT 5 OFFSET 5",
    "peers_page_daytext": f"{_P} SELECT dst, name, {Q.strftime('time')} AS last_announce, {Q.timedelta(f'({AS_OF}::DOUBLE - time)')} AS since_announce FROM (SELECT * FROM p0 ORDER BY {Q.PEER_ORDER} LIMIT 20)",
    "nodes_listing": f"""{_W}, {Q.PEERS}, {Q.CITES}, {_OWN}, {_CC} SELECT dst, name, pg.identity, rank, "time", coalesce(owner_name, 'Unknown') AS owner_name, coalesce(owner_dst, 'Unknown') AS owner_dst, coalesce(citations, 0) AS citations,
      {Q.strftime('time')} AS last_announce, {Q.timedelta(f'({AS_OF}::DOUBLE - time)')} AS since_announce FROM (SELECT * FROM ln ORDER BY {Q.NODE_ORDER} LIMIT 50) pg LEFT JOIN ow USING (identity) LEFT JOIN cc ON target_address = dst""",
    "nodes_mentions": f"{_W}, {Q.CITES} SELECT {', '.join(_PAGE)} FROM ln WHERE dst IN (SELECT src_address FROM lc WHERE target_address = '{ADDRESS}')",
    "nodes_survival": f"WITH RECURSIVE {Q.NODES}, {Q.features()} SELECT dst, round(p_dead_low, 6) AS p_dead_low, round(p_dead_high, 6) AS p_dead_high, CASE WHEN p_dead_low >= 0.9 THEN 'dead' WHEN p_dead_high <= 0.1 THEN 'alive' ELSE 'unknown' END AS status FROM ns",
    "pages_total": f"{_W} SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages_total FROM ln",
    "crawl_seeds": f"{_W} SELECT dst, \"time\" FROM ln WHERE \"time\" >= {AS_OF - DAYS * 86400}::DOUBLE",
    "recent_queries_unique": f"{_RECENT} 200",
    "home_recent": f"{_RECENT} 10",
    "home_summary": f"{_W} SELECT (SELECT count(DISTINCT url) FROM search_documents) AS index_size, (SELECT count(*) FROM ln) AS n_nodes",
    "history_page": f"SELECT id, query AS q, \"time\" FROM (SELECT DISTINCT * FROM user_search_history WHERE remote_identity = '{IDENTITY}') ORDER BY \"time\" DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50",
    "history_count": f"SELECT count(*) AS n FROM (SELECT DISTINCT * FROM user_search_history WHERE remote_identity = '{IDENTITY}')",
    "citation_sources": f"WITH {Q.CITES} SELECT DISTINCT src_address FROM lc WHERE target_address = '{ADDRESS}'",
    "citation_counts": f"WITH {Q.CITES}, {_CC} SELECT target_address, citations FROM cc",
    "latest_per_key": f"{_W} SELECT dst, id, updated_at, removed FROM n0",
    "node_upsert": f"{_W}, {_BATCH} SELECT {_UP}, coalesce(rank, 0) AS rank, CASE WHEN bt IS NOT NULL THEN false ELSE removed END AS removed FROM n0 o FULL JOIN lb ON o.dst = lb.dst",
    "peer_upsert": f"{_P}, {_BATCH} SELECT {_UP} FROM p0 o FULL JOIN lb ON o.dst = lb.dst",
    "citations_merge": f"""WITH {Q.CITES}, {Q.LINKS},
pg AS (SELECT DISTINCT split_part(url, ':', 1) AS src FROM documents WHERE url IS NOT NULL AND text IS NOT NULL),
nw AS (SELECT DISTINCT split_part(url, ':', 1) AS src, split_part(link, ':', 1) AS tgt FROM lr),
nt AS (SELECT * FROM nw WHERE length(tgt) = 32 AND tgt <> src)
SELECT coalesce(c0.target_address, nt.tgt) AS target_address, coalesce(c0.src_address, nt.src) AS src_address, coalesce(created_at, {AS_OF}::DOUBLE) AS created_at,
  CASE WHEN nt.src IS NOT NULL THEN false WHEN pg.src IS NOT NULL THEN true ELSE removed END AS removed
FROM c0 FULL JOIN nt ON c0.target_address = nt.tgt AND c0.src_address = nt.src LEFT JOIN pg ON pg.src = c0.src_address""",
    "stale_nodes": f"{_W}, {_GONE} SELECT dst FROM go",
    "stale_citations": f"{_W}, {_GONE}, {Q.CITES} SELECT target_address, src_address, removed OR src_address IN (SELECT dst FROM go) OR target_address IN (SELECT dst FROM go) AS removed FROM c0",
    "legacy_explode": "SELECT DISTINCT target_address, src_address FROM citations WHERE length(target_address) = 32 AND length(src_address) = 32",
    "legacy_announces": f"{_W} SELECT dst, identity, name, \"time\" FROM n0",
    "legacy_queries": "SELECT query FROM search_queries WHERE query IS NOT NULL AND query <> ''",
    "legacy_user_data": "SELECT remote_identity, query, \"time\" FROM user_search_history WHERE remote_identity IS NOT NULL AND query IS NOT NULL AND \"time\" IS NOT NULL",
    "announce_log_scan": f"""SELECT md5('src' || user_id) AS dst, count(*) AS n, round(min(epoch(ts)), 6) AS first_ts, round(max(epoch(ts)), 6) AS last_ts FROM events
WHERE event_type NOT IN ('error', 'signup', 'purchase') AND epoch(ts) >= {1706659200.0 - DAYS * 86400} GROUP BY 1""",
    "strip_markup": f"SELECT doc_id, {Q.strip('text')} AS plain FROM documents",
    "extract_links": f"WITH {Q.LINKS} SELECT DISTINCT url, link FROM lr",
    "link_classes": f"WITH {Q.LINKS} SELECT NOT starts_with(raw, ':') AS external, count(*) AS n FROM (SELECT DISTINCT url, raw FROM lr) GROUP BY 1",
    "address_from_url": "SELECT DISTINCT url, split_part(url, ':', 1) AS address, split_part(url, ':', 2) AS path FROM search_documents WHERE url IS NOT NULL",
    "format_text": f"SELECT doc_id, replace(regexp_replace(text, '[{Q.SPACE}]+', ' ', 'g'), '``', '') AS line FROM documents",
    "replace_malformed": "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{FFFD}]+', '', 'g') AS clean FROM documents",
    "clean_queries": f"SELECT id, regexp_replace(coalesce(query, ''), '^[{Q.SPACE}]+|[{Q.SPACE}]+$', '', 'g') AS query FROM (SELECT DISTINCT * FROM search_queries)",
    "since_text": f"{_W} SELECT dst, {Q.strftime('time')} AS shown, {Q.timedelta(f'({AS_OF}::DOUBLE - time)')} AS since FROM n0",
}
