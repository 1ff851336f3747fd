import pytest
from pyspark.sql import functions as F

from moorgrid import pages as P
from moorgrid.api import Request
from moorgrid.functions import timefmt
from moorgrid.operators import search as S

NODE = "id long, dst string, identity string, name string, time double, created_at double, updated_at double, rank double, removed boolean, announce_alpha double, announce_beta double"
DOC = "url string, text string, owner string, address string, nodeName string"


@pytest.fixture
def site(spark, tmp_path):
    a, b, c = "a" * 32, "b" * 32, "c" * 32
    nodes = spark.createDataFrame([(1, a, "i", "Alpha", 1000.0, 0.0, 0.0, 2.0, False, None, None), (2, b, "j", "Beta", 900.0, 0.0, 0.0, 1.0, False, None, None), (3, c, "k", "Gone", 0.0, 0.0, 0.0, 0.0, True, None, None)], NODE)
    peers = spark.createDataFrame([(1, "p1", "i", "Ann", 5.0), (2, "p2", "x", "Bob", 86400.0)], "id long, dst string, identity string, name string, time double")
    cites = spark.createDataFrame([(a, b, 1.0, False), (a, c, 1.0, False)], "target_address string, src_address string, created_at double, removed boolean")
    queries = spark.createDataFrame([(1, "old", 1.0)], "id long, query string, created_at double")
    history = spark.createDataFrame([(1, "me", "old", 1.0, 1.0)], "id long, remote_identity string, query string, time double, created_at double")
    docs = spark.createDataFrame([(f"{a}:/page/{i}.mu", f"weather\nreport {i}", "o", a, "Alpha") for i in range(3)] + [(f"{b}:/page/x.mu", "weather radio", "o", b, None), ("z:/page/y.mu", "radio", "o", "z", None)], DOC)
    return P.Site(nodes, peers, cites, queries, history, S.write_index(docs, str(tmp_path / "index")), 2000.0)


def test_pages(site):
    app = P.app(site)
    home = app.call(Request("/page/index.mu"))
    assert (home["pages"], home["nodes"], home["now"]) == (5, 2, "01.01.1970, 00:33:20") and [r["query"] for r in home["queries"].collect()] == ["old"]
    got = app.call(Request("/page/nodes.mu", {"page_size": "1"}))
    assert got["pages_total"] == 2 and [(r["name"], r["owner_name"], r["citations"]) for r in got["nodes"].collect()] == [("Alpha", "Ann", 2)]
    got = app.call(Request("/page/nodes.mu", {"query": "bet"}))
    assert got["pages_total"] == 1 and [r["name"] for r in got["nodes"].collect()] == ["Beta"]
    got = app.call(Request("/page/nodes.mu", {"mentions_for": "a" * 32}))
    assert got["mentions_for"] == "Alpha" and [r["name"] for r in got["nodes"].collect()] == ["Beta"]
    assert app.call(Request("/page/nodes.mu", {"mentions_for": "a", "query": "b"})).startswith("error: ")
    got = app.call(Request("/page/peers.mu"))
    assert [r["name"] for r in got["peers"].collect()] == ["Bob", "Ann"] and got["pages_total"] == 1
    assert app.call(Request("/page/history.mu")) == {"not_identified": True}


def test_search_page_and_what_it_writes(site):
    app = P.app(site)
    got = app.call(Request("/page/search.mu", {"query": " weather \n radio", "page_size": "2"}))
    rows = got["entries"].orderBy("order_no").collect()
    assert got["total"] == 4 and got["pages_total"] == 2 and len(rows) == 2 and got["query"] == "weather radio"
    assert rows[0]["name"] == "Beta /page/x.mu" and rows[0]["since_announce"] == "18m 20s" and "\n" not in rows[1]["text"]
    assert {r["query"] for r in site.queries.collect()} == {"old", "weather radio"} and site.history.count() == 1
    app.call(Request("/page/search.mu", {"query": "radio", "page": "1"}, identity="me"))
    assert site.queries.count() == 2
    got = app.call(Request("/page/history.mu", identity="me"))
    assert got["total"] == 2 and [r["q"] for r in got["history"].collect()] == ["radio", "old"]
    maps = [r["result"] for r in P.result_maps(site.nodes.where("id = 1")).collect()]
    assert maps[0]["name"] == "Alpha" and "announce_alpha" not in maps[0]
    assert len(site.index.cache) == 2
    P.stale_job(site, 1 / 86400 * 1050)  # Beta was heard of 1,100 s ago
    assert not len(site.index.cache) and {r["address"] for r in site.index.search("weather").collect()} == {"a" * 32}
    assert P.due({}, 0.0) == ["rank", "survival", "stale"] and P.due({"rank": 0.0, "stale": 0.0, "survival": 9e9}, 21600.0) == ["rank"]


def test_stored_index_changes_without_a_rebuild(spark, tmp_path):
    rows = [(f"h{i % 4}:/{i}", f"weather {'radio ' * (i % 3)} bridge w{i % 7}", f"o{i % 2}", f"h{i % 4}", f"Name{i % 5}") for i in range(60)] + [(None, "x", "o", "a", None), ("e:/", None, None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    index = S.write_index(df, str(tmp_path / "i"))
    change = spark.createDataFrame([("h1:/1", "radio radio only", "o", "h1", None), ("n:/1", "weather new", "o", "n", "Name9")], DOC)
    index.upsert(change)
    index.delete_by_address(["h2", ""])
    now = S.delete_by_address(S.upsert_documents(S.documents(df), change), "h2")
    index2 = S.read_index(spark, str(tmp_path / "i"))
    score = lambda f: {r["url"]: r["score"] for r in f.collect()}
    for q in ("weather radio", "name9 radio", "h1:/1", "nothing", "weath*"):
        want = score(S.bm25(S.postings(now), now, q))
        assert score(index2.search(q)) == pytest.approx(want), q
    before = index2.totals()
    assert before["outdated"] == 16 and before["n_docs"] == now.count()
    index2.compact()
    assert index2.totals() == {**before, "outdated": 0} and score(index2.search("weather radio")) == pytest.approx(score(S.bm25(S.postings(now), now, "weather radio")))
    got = S.numbered(index2.search("weather radio"), S.retrieval_order(), "pos").collect()
    assert [r["pos"] for r in sorted(got, key=lambda r: (-r["score"], r["url"]))] == list(range(1, len(got) + 1))
    index2.delete_by_address(["h0", "h1", "h3", "n"])
    assert index2.docs().count() == 1 and index2.search("weather").count() == 0


def test_sql_functions(spark):
    timefmt.register(spark)
    df = spark.createDataFrame([(0.0,), (86700.0,), (-5.0,), (3661.9,), (None,)], "s double")
    got = df.select("s", timefmt.format_timedelta(F.col("s")).alias("a"), F.expr("format_timedelta(s)").alias("b"), timefmt.strftime(F.col("s")).alias("c"), F.expr("show_time(s)").alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)
