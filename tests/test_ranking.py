import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorgrid.operators import crawl as C
from moorgrid.operators import graph as G
from moorgrid.operators import posterior as P
from moorgrid.operators import rerank as K
from moorgrid.operators import search as S

DOC = "url string, text string, owner string, address string, nodeName string"
DOCS = [
    ("a:/1", "The weather probe sends weather to the bridge", "o1", "a", "Morogate"),
    ("a:/2", "radio bridge", "o1", "a", "Morogate"),
    ("a:/3", "weather", "o1", "a", None),
    ("b:/1", "Nothing here", "weather o2", "b", "x"),
    ("b:/2", None, None, None, None),
    ("c:/1", "", "o3", "c", "weathering"),
    ("a:/2", "radio bridge", "o1", "a", "Morogate"),
    (None, "weather", "o", "z", "n"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, DOC)


def test_index_and_scan_agree(spark):
    d = S.documents(docs(spark))
    p = S.postings(d).cache()
    for q in ("weather radio", "morog weather", "a:/2", "o1 zzz", ""):
        a, b = ({r["url"]: r["score"] for r in x.collect()} for x in (S.bm25(p, d, q), S.scan_scores(docs(spark), q)))
        assert a == pytest.approx(b)
    one = {r["url"]: r["score"] for r in S.bm25(p, d, "text:radio").collect()}
    n, mean = 6, (8 + 2 + 1 + 2) / 6
    assert one == pytest.approx({"a:/2": math.log(1 + (n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean))}, abs=1e-6)


def test_query_language(spark):
    found = lambda q, st=False: {r["url"] for r in S.search_rows(docs(spark), q, st).collect()}
    assert found('"weather probe"') == {"a:/1"} and found("weather AND bridge") == {"a:/1"} and found("weather NOT bridge") == {"a:/3", "b:/1", "c:/1"}
    assert found("weather -bridge") == found("weather NOT bridge") and found("owner:o2") == {"b:/1"} and found("weathered", True) >= {"a:/1", "a:/3"}
    d = S.documents(docs(spark))
    assert {r["url"] for r in S.search(S.postings(d), d, "weath*").collect()} >= {"a:/1", "a:/3", "b:/1", "c:/1"}


def test_patterns_ranges_groups_and_boosts(spark):
    d = S.documents(docs(spark))
    p = S.postings(d).cache()
    found = lambda q: {r["url"] for r in S.search(p, d, q).collect()}
    assert found("text:w?ath*r") == {"a:/1", "a:/3"} and found("text:br*ge") == {"a:/1", "a:/2"} and found("text:[pa TO rb]") == {"a:/1", "a:/2"}
    assert found("(text:probe OR text:nothing) AND text:the") == {"a:/1"} and found("(text:radio text:nothing)") == {"a:/2", "b:/1"} and found("text:bridge NOT (text:probe)") == {"a:/2"}
    assert found("-text:probe text:bridge") == {"a:/2"} and found("(") == set()
    one, two = ({r["url"]: r["score"] for r in S.search(p, d, q).collect()} for q in ("text:radio", "text:radio^2.5"))
    assert two == pytest.approx({u: 2.5 * x for u, x in one.items()})


def test_upsert_and_delete(spark):
    d = S.documents(docs(spark))
    new = S.upsert_documents(d, spark.createDataFrame([("a:/1", "new", "o", "a", None)], DOC))
    assert new.where("url = 'a:/1'").first()["raw"] == "new" and new.count() == d.count() == 6
    assert S.delete_by_address(d, ["a", ""]).count() == 3 and S.delete_by_address(d, "").count() == 6


def test_highlight(spark):
    got = {r["url"]: r["h"] for r in docs(spark).where("url is not null").select("url", S.highlight(F.col("text"), "weather").alias("h")).collect()}
    assert "`!`_weather`_`!" in got["a:/1"] and got["b:/1"] == "Nothing here" and got["b:/2"] is None


def test_cache():
    class Fake:
        def persist(self):
            return self

        def unpersist(self):
            self.gone = True

    now = [0.0]
    c = S.ResultCache(seconds=10, entries=2, clock=lambda: now[0])
    a = c.get(("q", True), Fake)
    assert c.get((" q ", True), Fake) is a and c.get(("q", False), Fake) is not a and c.get(("", True), Fake) is not c.get(("", True), Fake)
    now[0] = 11
    assert c.get(("q", True), Fake) is not a and a.gone and len(c) == 2
    c.clear()
    assert not len(c)


def test_rerank(spark):
    hits = spark.createDataFrame([("u1", "A", 9.0, 1), ("u2", "A", 8.0, 2), ("u3", "A", 7.0, 3), ("u4", "B", 6.0, 4), ("u5", None, 5.0, 5), ("u1", "A", 4.0, 6)], "url string, address string, score double, pos int").selectExpr("url", "'t' text", "'o' owner", "address", "url name", "score", "pos")
    nodes = spark.createDataFrame([("A", 3.0, 0.0, False, None, None), ("B", 50.0, 1e6, True, None, None)], "dst string, rank double, time double, removed boolean, announce_alpha double, announce_beta double")
    got = K.ranked(K.rerank(hits, nodes, 1e6)).orderBy("order_no").collect()
    assert [(r["url"], r["order_no"]) for r in K.top(K.rerank(hits, nodes, 1e6), 1, 3).collect()] == [("u2", 4)]
    assert [r["url"] for r in got] == ["u4", "u5", "u1", "u2"]  # A's node is surely dead; B's is removed, so unknown
    assert got[0]["p_dead_low"] == 0.0 and got[2]["p_dead_low"] > 0.9
    assert K.rerank(hits.limit(0), nodes, 1e6).count() == 0
    assert K.rerank(hits.limit(1), nodes.limit(0), 1e6).first()["score"] == pytest.approx(0.1)


def reference_rank(edges, vertices, alpha, rounds, weights=None):
    v = sorted(vertices)
    at = {x: i for i, x in enumerate(v)}
    e = {(at[a], at[b]) for a, b in edges if a in at and b in at}
    deg = np.bincount([a for a, _ in e], minlength=len(v))
    t = np.array([weights.get(x, 0.0) for x in v]) if weights else np.ones(len(v))
    t = t / t.sum()
    r = np.full(len(v), 1 / len(v))
    for _ in range(rounds):
        new = (alpha + (1 - alpha) * r[deg == 0].sum()) * t
        for a, b in e:
            new[b] += (1 - alpha) * r[a] / deg[a]
        r = new / new.sum()
    return dict(zip(v, r * len(v)))


@pytest.mark.parametrize("every", [1, 3])
def test_pagerank(spark, every):
    r = random.Random(2)
    v = [f"v{i}" for i in range(12)]
    edges = [(r.choice(v), r.choice(v + ["unknown"])) for _ in range(40)]
    e, vs = spark.createDataFrame(edges + edges[:5], "src string, dst string"), spark.createDataFrame([(x,) for x in v], "v string")
    got = {x["v"]: x["score"] for x in G.pagerank(e, vs, max_iters=4, tol=1e-300, every=every).collect()}
    assert got == pytest.approx(reference_rank(edges, v, 0.15, 4)) and sum(got.values()) == pytest.approx(len(v))
    w = spark.createDataFrame([("v0", 2.0), ("v1", 1.0), ("nobody", 5.0), ("v2", -1.0)], "v string, weight double")
    got = {x["v"]: x["score"] for x in G.pagerank(e, vs, max_iters=3, tol=1e-300, personalize=w, every=every).collect()}
    assert got == pytest.approx(reference_rank(edges, v, 0.15, 3, {"v0": 2.0, "v1": 1.0}))
    lone = {x["v"]: x["score"] for x in G.pagerank(e.limit(0), vs, every=every).collect()}
    assert lone == pytest.approx(dict.fromkeys(v, 1.0))
    assert G.pagerank(e, vs.limit(0), every=every).count() == 0


def test_pagerank_arguments(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    for bad in ({"alpha": 2}, {"max_iters": 0}, {"tol": 0}):
        with pytest.raises(ValueError):
            G.pagerank(e, **bad)


def test_posterior(spark):
    n = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "dst string, removed boolean")
    an = spark.createDataFrame([("a", 1000.0), ("a", 2000.0)], "dst string, ts double")
    got = {r["dst"]: tuple(r)[1:] for r in P.node_parameters(n, an, 5000.5).collect()}
    assert got == {"a": (3.0, 5800.0, 4000.0, 2), "b": (1.0, 5800.0, 4000.0, 0)}
    assert P.node_parameters(n, an.limit(0), 5000.0).first()["announce_window_seconds"] == 0.0


def test_admission(spark):
    rows = [("u", float(t), i) for i, t in enumerate([0, 50, 100, 149, 200, 200])] + [("w", None, 9), (None, 1.0, 10)]
    got = C.admissions(spark.createDataFrame(rows, "url string, ts double, seq long"), 100)
    assert sorted(tuple(r) for r in got.collect()) == [("u", 0.0), ("u", 100.0), ("u", 200.0)]
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "a", "b"]), r.choice([float(r.randint(0, 5000)), r.random() * 5000]), i) for i in range(30000)]
    want = []
    for u in {x[0] for x in rows}:
        last = None
        for t in sorted({x[1] for x in rows if x[0] == u}):
            if last is None or t - last >= 7.3:
                want.append((u, t))
                last = t
    got = C.admissions(spark.createDataFrame(rows, "url string, ts double, seq long").repartition(5), 7.3)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_crawl(spark):
    pages = spark.createDataFrame([("a:/page/index.mu", "`[x`:/page/1.mu] `[y`b:/page/index.mu]"), ("a:/page/1.mu", "`[x`:/page/index.mu]"), ("b:/page/index.mu", "`[f`:/file/x.bin]"), ("c:/page/index.mu", "x")], "url string, text string")
    start = spark.createDataFrame([("a:/page/index.mu",)], "url string")
    got = {r["url"]: r["depth"] for r in C.crawl(start, C.page_table_loader(pages), queue=None).collect()}
    assert got == {"a:/page/index.mu": 0, "a:/page/1.mu": 1, "b:/page/index.mu": 1, "b:/file/x.bin": 2}
    assert {r["url"]: r["depth"] for r in C.crawl(start, C.link_table_loader(pages), lambda x: x).collect()} == got
    # a queue of one keeps the url found first, though another is smaller
    one = C.crawl(spark.createDataFrame([("q",)], "url string"), C.link_table_loader(spark.createDataFrame([("a:/page/index.mu", "`[x`z:/page/index.mu] `[y`b:/page/index.mu]")], "url string, text string")), lambda x: x, queue=1)
    assert {r["url"] for r in one.collect()} == {"q"}
    one = C.crawl(start, C.link_table_loader(spark.createDataFrame([("a:/page/index.mu", "`[x`:/page/z.mu] `[y`:/page/b.mu]")], "url string, text string")), lambda x: x, queue=1)
    assert {r["url"] for r in one.collect()} == {"a:/page/index.mu", "a:/page/z.mu"}
    with pytest.raises(RuntimeError, match="deeper"):
        C.crawl(start, C.page_table_loader(pages), max_rounds=1)
    assert C.crawl(start, C.page_table_loader(pages), max_rounds=2).count() == 4
