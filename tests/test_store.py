import pytest
from pyspark.sql import functions as F

from moorgrid import api, config
from moorgrid.operators import relational as R
from moorgrid.operators import upsert as U
from moorgrid.sources import announces as A
from moorgrid.sources import legacy as L
from moorgrid.sources import store as KV

NODE = "id long, dst string, identity string, name string, time double, created_at double, updated_at double, rank double, removed boolean, announce_alpha double, announce_beta double"


def node(i, dst, rank=0.0, t=0.0, removed=False, name="n", identity="o"):
    return (i, dst, identity, name, t, 0.0, t, rank, removed, None, None)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pages_clamp_and_never_overlap(spark):
    df = spark.createDataFrame([node(i, f"d{i:02}", 1.0, 5.0) for i in range(7)] + [node(9, "gone", 9.0, removed=True), node(10, "nul", None, None, None)], NODE)
    a, b = R.nodes_page(df, -3, 4), R.nodes_page(df, 1, 4)
    assert [r["dst"] for r in a.collect()] == ["d00", "d01", "d02", "d03"] and [r["dst"] for r in b.collect()] == ["d04", "d05", "d06", "nul"]
    assert R.nodes_page(df, 0, 0).count() == 1 and R.pages_total(0, 20) == 1 and R.pages_total(41, 20) == 3


def test_filter_wildcards_and_backslash(spark):
    df = spark.createDataFrame([node(1, "abc", name="A\\B"), node(2, "xyz", name=None)], NODE)
    assert [r["id"] for r in R.matching(df, "a\\b").collect()] == [1] and R.matching(df, "A%C").count() == 1 and R.matching(df, "").count() == 2


def test_listing(spark):
    n = spark.createDataFrame([node(1, "a", 2.0, 100.0), node(2, "b", 1.0, 100.0, identity="zz")], NODE)
    p = spark.createDataFrame([(5, "p5", "o", "late"), (2, "p2", "o", "first")], "id long, dst string, identity string, name string")
    c = spark.createDataFrame([("a", "b", False), ("a", "c", False), ("a", "d", True)], "target_address string, src_address string, removed boolean")
    got = {r["dst"]: r for r in R.listing(n, p, c, 160.0).collect()}
    assert got["a"]["owner_name"] == "first" and got["a"]["citations"] == 2 and got["a"]["since_announce"] == "1m"
    assert got["b"]["owner_name"] == "Unknown" and got["b"]["citations"] == 0
    assert [r["dst"] for r in R.listing(n, p, c, 160.0, mentions="a").collect()] == ["b"]
    with pytest.raises(ValueError):
        R.listing(n, p, c, 0.0, query="x", mentions="y")


def test_empty_tables(spark):
    n, c = spark.createDataFrame([], NODE), spark.createDataFrame([], "id long, target_address string, src_address string, created_at double, removed boolean")
    assert R.current_nodes(n).count() == 0 and R.current_citations(c).count() == 0 and R.nodes_page(n).count() == 0


def test_upsert_revives_and_keeps(spark):
    old = spark.createDataFrame([("a", "i", "n", 1.0, 1.0, 1.0, 7.0, True), ("b", "i", "n", 1.0, 1.0, 1.0, 3.0, False)], "dst string, identity string, name string, time double, created_at double, updated_at double, rank double, removed boolean")
    batch = spark.createDataFrame([("a", "j", "m", 5.0, 1), ("a", "k", "l", 4.0, 2), ("c", None, None, 6.0, 3), (None, "x", "x", 1.0, 4)], "dst string, identity string, name string, ts double, seq long")
    got = {r["dst"]: tuple(r) for r in U.upsert_nodes(old, batch).collect()}
    assert got["a"] == ("a", "k", "l", 4.0, 1.0, 4.0, 7.0, False) and got["b"][6:] == (3.0, False) and got["c"] == ("c", None, None, 6.0, 6.0, 6.0, 0.0, False)


def test_merge_citations(spark):
    a, b, c, s = "a" * 32, "b" * 32, "c" * 32, "s" * 32
    old = spark.createDataFrame([(a, s, 1.0, False), (b, s, 1.0, True), (a, c, 1.0, False)], "target_address string, src_address string, created_at double, removed boolean")
    found = spark.createDataFrame([(s, b), (s, c)], "src string, target string")
    step = U.merge_citations(old, found, 9.0)
    want = {(a, s, 1.0, True), (b, s, 1.0, False), (c, s, 9.0, False), (a, c, 1.0, False)}
    assert set(rows(step)) == want and set(rows(U.merge_citations(step, found, 99.0))) == want
    links = spark.createDataFrame([(s + ":/p", [b + ":/x", s + ":/y", "short:/z"]), (a + ":/p", [])], "url string, links array<string>")
    assert set(rows(U.links_to_citations(links))) == {(s, b), (s, None), (a, None)}


def test_stale(spark):
    n = spark.createDataFrame([node(1, "a", t=0.0), node(2, "b", t=100 * 86400.0)], NODE)
    c = spark.createDataFrame([("b", "a", False), ("a", "b", False), ("b", "b", False)], "target_address string, src_address string, removed boolean")
    n2, c2 = U.remove_stale(n, c, 100 * 86400.0)
    assert {r["dst"]: r["removed"] for r in n2.collect()} == {"a": True, "b": False}
    assert sorted((r["target_address"], r["src_address"], r["removed"]) for r in c2.collect()) == [("a", "b", True), ("b", "a", True), ("b", "b", False)]


def test_appends_and_migrations(spark):
    q = spark.createDataFrame([(3, "x", 1.0)], "id long, query string, created_at double")
    assert rows(U.add_query(q, " y ", 2.0)) == [(3, "x", 1.0), (4, "y", 2.0)]
    h = spark.createDataFrame([], "id long, remote_identity string, query string, time double, created_at double")
    assert U.add_history(h, " ", "q", 1.0).count() == 0 and rows(U.add_history(h, "i", " q ", 1.0)) == [(1, "i", "q", 1.0, 1.0)]
    assert U.add_missing(q, {"flag": False, "query": "z"}).columns == ["id", "query", "created_at", "flag"]
    w = U.write_back(q.withColumn("rank", F.lit(1.0)), spark.createDataFrame([(3, 5.0)], "id long, rank double"), "id", ["rank"])
    assert w.first()["rank"] == 5.0


def test_announce_log(spark, tmp_path):
    lines = ["", "{bad", '{"datetime": "2024-01-02T00:00:00", "dst": "a"}', '{"datetime": "x", "dst": "b"}', '{"datetime": "2024-01-02T00:00:00"}', '{"datetime": "2024-01-03T00:00:00.5", "dst": "a"}', "5"]
    df = A.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(rows(df)) == [("a", 1704153600.0), ("a", 1704240000.5)]
    path = str(tmp_path / "log")
    A.write_log(df, path)
    assert sorted(rows(A.parse_lines(spark.read.text(path).select("value")))) == sorted(rows(df))
    assert A.drop_old_days(spark, path, 1) == ["2024-01-02"]
    assert A.recent(df, 1704153600.0 + 14 * 86400).count() == 2


def test_legacy(spark, tmp_path):
    t, s = "t" * 32, "s" * 32
    p = tmp_path / "c.json"
    p.write_text('{"for_search": {"%s": ["%s", "%s", "x"]}}' % (t, s, s))
    assert rows(L.citations(L.load(spark, str(p), "citations"))) == [(t, s)]
    assert L.queries(L.load(spark, str(tmp_path / "none.json"), "queries")).count() == 0
    j = L.parse(spark.createDataFrame([('{"i": [{"q": "a", "time": 1.5}, {"q": null}]}',)], "value string"), "user_data")
    assert rows(L.user_data(j)) == [("i", "a", 1.5)]


def test_store(spark):
    s = KV.put(KV.put(spark.createDataFrame([], "key string, value string"), "k", {"a": 1}), "e", [])
    assert KV.get_user(KV.put_user(s, "i", [1]), "i") == [1] and KV.get_user(s, "i", []) == []
    assert KV.get(s, "k") == {"a": 1} and KV.get(s, "e", 7) == 7 and KV.get(s, "none") is None


def test_requests():
    app = api.App()

    @app.request("/p", "/q")
    def f(r: api.Request, a: str, n: int = 5):
        return (r.path, a, n)

    @app.request("/mine", identifying_required=True)
    def g():
        return "mine"

    assert app.call(api.Request("/p", {"var_a": "x"})) == ("/p", "x", 5) and app.call(api.Request("/q", {"field_a": "x", "n": "7"})) == ("/q", "x", 7)
    with pytest.raises(api.BadRequest) as e:
        app.call(api.Request("/p", {"n": "z"}))
    assert e.value.missing == ["a"] and e.value.mistyped == ["n"]
    with pytest.raises(api.NotIdentified):
        app.call(api.Request("/mine"))
    with pytest.raises(ValueError):
        app.request("/p")(g)
    app.exception(LookupError)(lambda e: "no page")
    assert app.call(api.Request("/none")) == "no page" and app.call(api.Request("/mine", identity="i")) == "mine"
    assert api.pager(5, 20) == [0, None, 3, 4, 5, 6, 7, None, 19] and api.pager(0, 1) == [0]


def test_settings():
    need = dict.fromkeys(("STORAGE_PATH", "RNS_CONFIGDIR", "NODE_IDENTITY_PATH", "TEMPLATES_DIR", "LOG_LEVEL"), "x")
    got = config.from_env(env={**need, "NODE_REMOVE_AFTER_DAYS": "3"})
    assert got.NODE_REMOVE_AFTER_DAYS == 3 and got.CRAWLER_QUEUE_MAXSIZE == 5000 and got.announce_log() == "logs/announces"
    with pytest.raises(ValueError, match="STORAGE_PATH, RNS_CONFIGDIR"):
        config.from_env(env={})
    from dataclasses import dataclass

    @dataclass
    class Need:
        A: int
        B: str

    with pytest.raises(ValueError, match="A, B"):
        config.from_env(Need, {})
