"""Queries of search, ranking, the graph, the survival model, the crawl and the streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from moorgrid.functions.survival import PRIOR_BETA, dead_given_rate, prior_quantile
from moorgrid.functions.text import format_text, path_from_url
from moorgrid.functions.timefmt import format_timedelta, since
from moorgrid.operators import crawl as C
from moorgrid.operators import graph as G
from moorgrid.operators import posterior as P
from moorgrid.operators import relational as R
from moorgrid.operators import rerank as K
from moorgrid.operators import search as S
from moorgrid.operators.upsert import write_back
from moorgrid.plans import sql as Q
from moorgrid.plans.sql import AS_OF
from moorgrid.plans.store import ADDRESS
from moorgrid.session import scratch
from moorgrid.sources.tables import read
from moorgrid.streaming import announces as SA
from moorgrid.streaming import index as SI

QUERY = "emergency weather radio Moro bridge"
QUERY_2 = "weather harbour station"
EVENTS_AS_OF = 1706659200.0


def _docs(spark, d):
    return S.documents(read(spark, d, "search_documents"))


_INDEXES: dict[tuple, S.Index] = {}


def _index(spark, d, stemmed=False):
    """The stored index of the search documents; built once in a session and read by every query after that."""
    key = (spark.sparkContext.applicationId, d, stemmed)
    if key not in _INDEXES:
        _INDEXES[key] = S.write_index(read(spark, d, "search_documents"), _streamed(spark, "stored-index"), stemmed)
    return _INDEXES[key]


def _found(spark, d, stemmed=False, query=QUERY):
    return _index(spark, d, stemmed).search(query)


def _nodes(spark, d):
    return R.current_nodes(read(spark, d, "nodes"))


def _raw(spark, d):
    raw = read(spark, d, "documents").where("url IS NOT NULL")
    return raw.select("url", "text", F.lit(None).cast("string").alias("owner"), F.col("source").alias("address"), F.lit(None).cast("string").alias("nodeName"))


def index_postings_text(spark, d):
    return S.term_statistics(S.postings(_docs(spark, d))).where("field = 'text'")


def index_postings_name(spark, d):
    return S.term_statistics(S.postings(_docs(spark, d))).where("field = 'nodeName'")


def index_upsert(spark, d):
    """The index after the raw documents came in as pages of their own urls."""
    docs = _docs(spark, d)
    return S.upsert_documents(docs, _raw(spark, d)).select("url", "address", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), (F.col("raw").eqNullSafe(F.col("text"))).alias("same"))


def index_delete_by_address(spark, d):
    return S.delete_by_address(_docs(spark, d), ADDRESS).select("url", "address")


def index_size(spark, d):
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("n"))


def index_build(spark, d):
    """A new stored index of all documents, its postings counted by field."""
    i = S.write_index(read(spark, d, "search_documents"), _streamed(spark, "build"))
    return spark.read.parquet(f"{i.path}/postings").groupBy("field").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").cast("bigint").alias("n_terms"))


def index_after_changes(spark, d):
    """Scores after documents of one address were deleted and the raw documents came in, without a rebuild."""
    i = S.write_index(read(spark, d, "search_documents"), _streamed(spark, "changes"))
    i.delete_by_address(ADDRESS)
    i.upsert(_raw(spark, d))
    return i.search(QUERY).select("url", F.round("score", 6).alias("score"))


def search_bm25(spark, d):
    """Scores through the postings of the stored index."""
    return _found(spark, d).select("url", F.round("score", 6).alias("score"))


def search_scan(spark, d):
    """Scores straight from the documents, without an index."""
    return S.search_rows(read(spark, d, "search_documents"), QUERY).select("url", F.round("score", 6).alias("score"))


def search_dedupe_url(spark, d):
    """Hits of two queries together, of which many repeat a url; the better one of each stays."""
    both = _found(spark, d).unionByName(_found(spark, d, query=QUERY_2))
    return K.first_per_url(both).select("url", F.round("score", 6).alias("score"))


def search_cap_address(spark, d):
    kept = K.cap_per_address(K.first_per_url(_found(spark, d)).withColumns({"s": F.col("score")}))
    return kept.select("url", "address", F.round("score", 6).alias("score"))


def search_positions(spark, d):
    """Every hit with its place in the retrieval order."""
    return S.numbered(_found(spark, d), S.retrieval_order(), "pos").select("url", "pos")


def _ranked(spark, d, stemmed=False):
    return K.rerank(_found(spark, d, stemmed), _nodes(spark, d), AS_OF)


def search_ranked(spark, d):
    return K.ranked(_ranked(spark, d)).select("url", "address", "name", F.round("score", 6).alias("score"), F.round("p_dead_low", 6).alias("p_dead_low"), F.round("p_dead_high", 6).alias("p_dead_high"), "time", "order_no")


def search_page(spark, d):
    """One page of results with the name of the live node and the time since its announce."""
    page = K.top(_ranked(spark, d))
    node = R.live(_nodes(spark, d)).select(F.col("dst").alias("address"), F.col("name").alias("node_name"))
    texts = _index(spark, d).docs().select("url", "text")
    name = F.when(F.col("node_name").isNotNull(), F.concat("node_name", F.lit(" "), path_from_url(F.col("url")))).otherwise(F.col("url"))
    ago = F.when(F.col("time") != 0, format_timedelta(since(AS_OF, F.col("time"))))
    # the page has 20 rows
    shown = node.join(F.broadcast(page), "address", "right").select(*page.columns, "node_name")
    return texts.join(F.broadcast(shown), "url").select("url", name.alias("name"), format_text(F.substring("text", 1, 200)).alias("snippet"), ago.alias("since_announce"), "order_no")


def search_stemmed(spark, d):
    return K.ranked(_ranked(spark, d, True)).select("url", "order_no", F.round("score", 6).alias("score"))


def search_highlighted(spark, d):
    """One page of hits with all their fragments."""
    page = K.top(_ranked(spark, d), size=50).select("url", "order_no")
    texts = _index(spark, d).docs().select("url", "text")
    return texts.join(F.broadcast(page), "url").select("url", "order_no", S.highlight(F.col("text"), QUERY).alias("fragment"))


def search_operators(spark, d):
    """Phrases, fields and excluded words."""
    return _found(spark, d, query='"weather probe" AND radio NOT bridge').select("url")


def _announces(spark, d):
    e = read(spark, d, "events").where("event_type = 'view'")
    return e.select(F.md5(F.concat(F.lit("src"), F.col("user_id").cast("string"))).alias("dst"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


def _event_nodes(spark, d):
    n = _announces(spark, d).groupBy("dst").agg(F.max("ts").alias("time"))
    return n.withColumn("removed", F.lit(False)).unionByName(_nodes(spark, d).select("dst", "time", "removed"))


def survival_params(spark, d):
    p = P.node_parameters(_event_nodes(spark, d), _announces(spark, d), EVENTS_AS_OF)
    return p.select("dst", "announce_alpha", "announce_beta", "announce_window_seconds", F.col("announce_k_events").cast("bigint").alias("announce_k_events"))


def survival_prior(spark, d):
    """The interval under the prior alone, in closed form."""
    n = R.live(_nodes(spark, d))
    dt = F.greatest(since(AS_OF, F.col("time")), F.lit(0.0))
    low, high = (dead_given_rate(prior_quantile(p, F.lit(PRIOR_BETA)), dt) for p in (0.05, 0.95))
    return n.select("dst", F.round(low, 6).alias("p_dead_low"), F.round(high, 6).alias("p_dead_high"))


def survival_ci(spark, d):
    """The interval under the posterior of all events."""
    p = P.node_parameters(_event_nodes(spark, d), _announces(spark, d), EVENTS_AS_OF)
    n = _event_nodes(spark, d).where("NOT coalesce(removed, false)").groupBy("dst").agg(F.max("time").alias("time"))
    rows = R.with_survival(n.join(p, "dst"), EVENTS_AS_OF)
    return rows.select("dst", F.round("p_dead_low", 6).alias("p_dead_low"), F.round("p_dead_high", 6).alias("p_dead_high"))


def _graph(spark, d):
    return G.live_graph(R.current_citations(read(spark, d, "citations")), _nodes(spark, d))


def pagerank_fixed(spark, d):
    e, v = _graph(spark, d)
    return G.pagerank(e, v, max_iters=5, tol=1e-300).select("v", F.round("score", 6).alias("score"))


def pagerank_dangling(spark, d):
    """Parts, suppliers and nations, the last without out-edges."""
    l = read(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return G.pagerank(l.unionByName(s), None, max_iters=3, tol=1e-300).select("v", F.round("score", 6).alias("score"))


def pagerank_personalized(spark, d):
    e, v = _graph(spark, d)
    w = R.live(_nodes(spark, d)).select(F.col("dst").alias("v"), F.col("rank").alias("weight"))
    return G.pagerank(e, v, max_iters=4, tol=1e-300, personalize=w).select("v", F.round("score", 6).alias("score"))


def pagerank_converged(spark, d):
    e, v = _graph(spark, d)
    return G.pagerank(e, v).select("v", F.round("score", 6).alias("score"))


def rank_writeback(spark, d):
    e, v = _graph(spark, d)
    r = G.pagerank(e, v, max_iters=5, tol=1e-300).select(F.col("v").alias("dst"), F.col("score").alias("rank"))
    return write_back(_nodes(spark, d), r, "dst", ["rank"]).select("dst", F.round("rank", 6).alias("rank"), "removed")


def crawl_admission(spark, d):
    e = read(spark, d, "events")
    url = F.concat(F.md5(F.concat(F.lit("src"), F.col("user_id").cast("string"))), F.lit(":/page/"), "event_type", F.lit(".mu"))
    return C.admissions(e.select(url.alias("url"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")))


def crawl_bfs(spark, d):
    pages = read(spark, d, "documents").where("url IS NOT NULL").select("url", "text")
    start = C.seeds(R.live(_nodes(spark, d))).unionByName(pages.select("url"))
    return C.crawl(start, C.link_table_loader(pages), lambda rows: rows).select("url")


def _streamed(spark, name):
    return scratch(spark, name)


def stream_announce_upsert(spark, d):
    """All citations as a stream of announces; the result is the last version of the node table."""
    base = _streamed(spark, "announces")
    c = read(spark, d, "citations").distinct()
    rows = c.select(F.lit("node").alias("aspect"), R.normal_address(F.col("target_address")).alias("dst"), R.normal_address(F.col("src_address")).alias("identity"), F.concat(F.lit("seen "), F.col("id").cast("string")).alias("name"), F.col("created_at").alias("ts"), F.col("id").alias("seq"), F.lit(1).alias("size"))
    rows.write.parquet(f"{base}/in")
    SA.ingest(spark.readStream.schema(SA.ANNOUNCE).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return SA.VersionedTable(spark, f"{base}/out", SA.STATE).read().select("dst", "identity", "name", "time", "created_at", "updated_at", "rank", "removed")


def stream_announce_aspects(spark, d):
    """All peers and nodes as one stream of both aspects, read by one ingest for each."""
    base = _streamed(spark, "aspects")
    rows = [read(spark, d, t).distinct().select(F.lit(a).alias("aspect"), "dst", "identity", "name", F.col("time").alias("ts"), F.col("id").alias("seq"), F.lit(1).alias("size")) for a, t in (("node", "nodes"), ("peer", "peers"))]
    rows[0].unionByName(rows[1]).write.parquet(f"{base}/in")
    out = []
    for a in ("node", "peer"):
        SA.ingest(spark.readStream.schema(SA.ANNOUNCE).parquet(f"{base}/in"), f"{base}/{a}", f"{base}/{a}-state", a).awaitTermination()
        out.append(SA.VersionedTable(spark, f"{base}/{a}", SA.STATE).read().select(F.lit(a).alias("aspect"), "dst"))
    return out[0].unionByName(out[1])


def stream_index_batches(spark, d):
    """All search documents as a stream in several batches; the result is the last version of the index."""
    base = _streamed(spark, "index")
    read(spark, d, "search_documents").repartition(4, "url").write.parquet(f"{base}/in")
    src = spark.readStream.schema(SI.DOCUMENT.rsplit(",", 1)[0]).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    SI.index_stream(src, f"{base}/out", f"{base}/state").awaitTermination()
    return SI.index_table(spark, f"{base}/out").read().select("url", "address", "owner", "nodeName", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    index_postings_text, index_postings_name, index_upsert, index_delete_by_address, index_size, index_build, index_after_changes, search_bm25, search_scan, search_dedupe_url, search_cap_address, search_positions, search_ranked, search_page,
    search_stemmed, search_highlighted, search_operators, survival_params, survival_prior, survival_ci, pagerank_fixed, pagerank_dangling, pagerank_personalized, pagerank_converged, rank_writeback,
    crawl_admission, crawl_bfs, stream_announce_upsert, stream_announce_aspects, stream_index_batches,
)}


def _query_terms(query: str) -> list[tuple[str, str, int]]:
    rows: dict[tuple[str, str], int] = {}
    for clause in S.parse(query)["any"]:
        for f, terms, _ in clause:
            for t in terms:
                rows[f, t] = rows.get((f, t), 0) + 1
    return [(f, t, n) for (f, t), n in sorted(rows.items())]


_B2 = Q.bm25(_query_terms(QUERY_2))
for _name in ("qt", "po", "le", "al", "hi", "dn", "sc", "re"):
    _B2 = re.sub(rf"\b{_name}\b", f"{_name}2", _B2)
_I, _B = f"WITH RECURSIVE {Q.INDEX}", Q.bm25(_query_terms(QUERY))
_RANK = f"WITH RECURSIVE {Q.NODES}, {Q.INDEX}, {_B}, {Q.ranked()}"
_EDGES = "SELECT src_address AS src, target_address AS dst FROM lc"
_GRAPH = f"WITH RECURSIVE {Q.NODES}, {Q.CITES}, "
_STATS = "SELECT field, term, count(DISTINCT url) AS df, count(*) AS tf FROM occ WHERE field = '{}' GROUP BY 1, 2"
_VIEWS = "an AS (SELECT md5('src' || user_id) AS dst, epoch(ts) AS ts FROM events WHERE event_type = 'view')"
_SURV = f"""{Q.NODES}, {_VIEWS}, en AS (SELECT dst, max(ts) AS "time", false AS removed FROM an GROUP BY dst UNION ALL SELECT dst, "time", removed FROM n0),
el AS (SELECT dst, max("time") AS "time", count(*) AS copies FROM en WHERE NOT coalesce(removed, false) GROUP BY dst),
wi AS (SELECT CAST(least(greatest(floor({EVENTS_AS_OF}::DOUBLE - min(ts)), 0), {14 * 86400}) AS DOUBLE) AS w FROM an),
kk AS (SELECT dst, count(*) AS k FROM an WHERE ts >= {EVENTS_AS_OF - 14 * 86400}::DOUBLE GROUP BY dst),
sp AS (SELECT el.dst, el."time", CAST(1 + coalesce(k, 0) AS DOUBLE) AS announce_alpha, 1800.0::DOUBLE + w AS announce_beta, w AS announce_window_seconds, coalesce(k, 0) AS announce_k_events FROM el LEFT JOIN kk USING (dst), wi)"""

_CHANGED = f"""WITH RECURSIVE {Q.INDEX.replace("d AS (", "d0 AS (", 1).replace("GROUP BY url)", "GROUP BY url), d AS (SELECT * FROM d0 WHERE address IS DISTINCT FROM '" + ADDRESS + "' AND url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL) UNION ALL SELECT url, any_value(text), NULL, any_value(source), NULL FROM documents WHERE url IS NOT NULL GROUP BY url)", 1)}"""

ORACLES = {
    "index_after_changes": f"{_CHANGED}, {_B} SELECT url, round(score, 6) AS score FROM re",
    "pagerank_converged": f"{_GRAPH}{Q.pagerank(_EDGES, 'SELECT dst AS v FROM ln', 60)} SELECT v, round(score, 6) AS score FROM pr",
    "index_postings_text": f"{_I} {_STATS.format('text')}",
    "index_postings_name": f"{_I} {_STATS.format('nodeName')}",
    "index_upsert": f"""{_I}, b AS (SELECT url, any_value(text) AS text, any_value(source) AS address FROM documents WHERE url IS NOT NULL GROUP BY url)
SELECT url, address, coalesce(length(text), 0) AS n_chars, true AS same FROM d WHERE url NOT IN (SELECT url FROM b) UNION ALL SELECT url, address, coalesce(length(text), 0), true FROM b""",
    "index_delete_by_address": f"{_I} SELECT url, address FROM d WHERE address IS DISTINCT FROM '{ADDRESS}'",
    "index_size": f"{_I} SELECT count(*) AS n FROM d",
    "search_bm25": f"{_I}, {_B} SELECT url, round(score, 6) AS score FROM re",
    "search_scan": f"{_I}, {_B} SELECT url, round(score, 6) AS score FROM re",
    "index_build": f"{_I} SELECT field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_terms FROM (SELECT field, term, url, count(*) AS tf FROM occ GROUP BY 1, 2, 3) GROUP BY field",
    "search_dedupe_url": f"{_I}, {_B}, {_B2} SELECT url, round(max(score), 6) AS score FROM (SELECT url, score FROM re UNION ALL SELECT url, score FROM re2) GROUP BY url",
    "search_cap_address": f"{_I}, {_B} SELECT url, address, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY pos) AS k FROM re) WHERE k <= 2",
    "search_positions": f"{_I}, {_B} SELECT url, pos FROM re",
    "search_ranked": f"{_RANK} SELECT url, address, name, round(score, 6) AS score, round(p_dead_low, 6) AS p_dead_low, round(p_dead_high, 6) AS p_dead_high, \"time\", order_no FROM rk",
    "search_page": f"""{_RANK} SELECT url, CASE WHEN ln.name IS NOT NULL THEN ln.name || ' ' || split_part(url, ':', 2) ELSE url END AS name, replace(regexp_replace(substring(text, 1, 200), '[{Q.SPACE}]+', ' ', 'g'), '``', '') AS snippet,
CASE WHEN rk."time" <> 0 THEN {Q.timedelta(f'({AS_OF}::DOUBLE - rk.time)')} END AS since_announce, order_no FROM rk LEFT JOIN ln ON ln.dst = rk.address WHERE order_no <= 20""",
    "search_operators": f"{_I}, tk AS (SELECT url, ' ' || array_to_string(regexp_extract_all(lower(text), '{Q.TOKEN}'), ' ') || ' ' AS t FROM d) SELECT url FROM tk WHERE contains(t, ' weather probe ') AND contains(t, ' radio ') AND NOT contains(t, ' bridge ')",
    "survival_params": f"WITH {_SURV} SELECT dst, announce_alpha, announce_beta, announce_window_seconds, announce_k_events FROM sp",
    "survival_prior": f"""WITH {Q.NODES} SELECT dst, round({Q.dead('-ln(0.95) / 1800', f'greatest({AS_OF}::DOUBLE - time, 0.0)')}, 6) AS p_dead_low, round({Q.dead('-ln(0.05) / 1800', f'greatest({AS_OF}::DOUBLE - time, 0.0)')}, 6) AS p_dead_high FROM ln""",
    "survival_ci": f"""WITH RECURSIVE {_SURV}, {Q.quantiles('SELECT announce_alpha AS a FROM sp')},
x AS (SELECT dst, {Q.dead('q_lo / announce_beta', f'greatest({EVENTS_AS_OF}::DOUBLE - sp.time, 0.0)')} AS lo, {Q.dead('q_hi / announce_beta', f'greatest({EVENTS_AS_OF}::DOUBLE - sp.time, 0.0)')} AS hi FROM sp JOIN q ON q.a = announce_alpha)
SELECT dst, round(least(lo, hi), 6) AS p_dead_low, round(greatest(lo, hi), 6) AS p_dead_high FROM x""",
    "pagerank_fixed": f"{_GRAPH}{Q.pagerank(_EDGES, 'SELECT dst AS v FROM ln', 5)} SELECT v, round(score, 6) AS score FROM pr",
    "pagerank_dangling": f"""WITH RECURSIVE {Q.pagerank("SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier", None, 3)} SELECT v, round(score, 6) AS score FROM pr""",
    "pagerank_personalized": f"{_GRAPH}{Q.pagerank(_EDGES, 'SELECT dst AS v FROM ln', 4, 'SELECT dst AS v, rank AS weight FROM ln')} SELECT v, round(score, 6) AS score FROM pr",
    "rank_writeback": f"{_GRAPH}{Q.pagerank(_EDGES, 'SELECT dst AS v FROM ln', 5)} SELECT dst, round(coalesce(score, rank), 6) AS rank, removed FROM n0 LEFT JOIN pr ON v = dst",
    "crawl_admission": f"""WITH RECURSIVE tries AS (SELECT DISTINCT md5('src' || user_id) || ':/page/' || event_type || '.mu' AS url, epoch(ts) AS ts FROM events),
ad AS (SELECT url, min(ts) AS ts FROM tries GROUP BY url UNION ALL SELECT url, ts FROM (SELECT ad.url, min(tries.ts) AS ts FROM ad JOIN tries ON tries.url = ad.url AND tries.ts - ad.ts >= {C.TTL} GROUP BY ad.url, ad.ts))
SELECT url, ts FROM ad""",
    "crawl_bfs": f"""WITH RECURSIVE {Q.NODES}, {Q.LINKS}, fr AS (SELECT url FROM (SELECT dst || ':/page/index.mu' AS url FROM ln UNION SELECT url FROM documents WHERE url IS NOT NULL) UNION SELECT lr.link AS url FROM fr JOIN lr ON lr.url = fr.url WHERE contains(fr.url, '.mu')) SELECT url FROM fr""",
    "stream_announce_upsert": f"""WITH ba AS (SELECT {Q.address('target_address')} AS dst, {Q.address('src_address')} AS bi, 'seen ' || id AS bn, created_at AS bt, id FROM (SELECT DISTINCT * FROM citations))
SELECT dst, first(bi ORDER BY id DESC) AS identity, first(bn ORDER BY id DESC) AS name, first(bt ORDER BY id DESC) AS "time", first(bt ORDER BY id DESC) AS created_at, first(bt ORDER BY id DESC) AS updated_at, 0.0::DOUBLE AS rank, false AS removed FROM ba WHERE dst IS NOT NULL GROUP BY dst""",
    "stream_announce_aspects": "SELECT DISTINCT 'node' AS aspect, dst FROM nodes WHERE dst IS NOT NULL AND time IS NOT NULL UNION ALL SELECT DISTINCT 'peer', dst FROM peers WHERE dst IS NOT NULL AND time IS NOT NULL",
    "stream_index_batches": f"{_I} SELECT url, address, owner, nodeName, coalesce(length(text), 0) AS n_chars FROM d",
}
