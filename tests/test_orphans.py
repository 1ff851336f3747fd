import random

from moorgrid.operators import orphans as O

NODE = "id long, dst string, created_at double, updated_at double, removed boolean, key string, kind string"
CITE = "id long, target_address string, src_address string, created_at double, removed boolean, key string, field string"


def brute(cites, nodes):
    state, out, seen = {}, set(), set()
    for n in nodes:
        if n[1] and n[1].strip().lower() not in state or n[1] and (n[3], n[0]) > (state[n[1].strip().lower()][3], state[n[1].strip().lower()][0]):
            state[n[1].strip().lower()] = n
    for c in cites:
        if c[0] in seen:
            continue
        seen.add(c[0])
        for field, a in (("target_address", c[1]), ("src_address", c[2])):
            a = (a or "").strip(" \t\n<>").lower()
            if not a:
                continue
            n = state.get(a)
            kind = "missing" if n is None else "deleted" if n[4] else "late" if n[2] is not None and c[3] is not None and n[2] > c[3] else None
            if kind:
                out.add((c[0], field, kind))
    return out


def test_kinds_with_hot_keys(spark):
    r = random.Random(4)
    nodes = [(i, f"d{r.randint(0, 40)}", r.choice([None, r.random() * 100]), r.random(), r.random() < 0.3, "k", "x") for i in range(80)]
    addr = lambda: r.choice([None, " ", f"<D{r.randint(0, 60)}>", f" d{r.randint(0, 60)}\t", "d1", "d1", "d1", "zz"])
    cites = [(i, addr(), addr(), r.choice([None, r.random() * 100]), False, "k", "x") for i in range(600)]
    cites += cites[:40]
    got = O.orphans(spark.createDataFrame(cites, CITE), spark.createDataFrame(nodes, NODE))
    assert {(x["id"], x["field"], x["kind"]) for x in got.collect()} == brute(cites, nodes) and got.count() == len(brute(cites, nodes))
    assert O.by_period(got).groupBy().sum("n_refs").first()[0] == got.count()


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], NODE), spark.createDataFrame([(1, "a", None, 1.0, False, "k", "f")], CITE)
    assert [tuple(x) for x in O.orphans(some, none).select("id", "kind").collect()] == [(1, "missing")]
    assert O.orphans(spark.createDataFrame([], CITE), none).count() == 0


def test_rows_with_a_null_id_stay_apart(spark):
    import duckdb

    from moorgrid.plans import problems as P

    nodes = [(1, "a", 5.0, 1.0, True, "k", "x"), (2, "b", 5.0, 1.0, False, "k", "x")]
    cites = [(None, "a", "gone", 1.0, False, "k", "f"), (None, " <A>", "b", 1.0, False, "k", "f"), (None, "gone", None, 2.0, False, "k", "f"), (None, "gone", None, 2.0, False, "k", "f"), (None, None, "zz", None, False, "k", "f"), (7, "a", "b", 1.0, False, "k", "f"), (7, "a", "b", 1.0, False, "k", "f")]
    got = O.orphans(spark.createDataFrame(cites, CITE), spark.createDataFrame(nodes, NODE))
    con = duckdb.connect()
    con.execute("CREATE TABLE nodes (id BIGINT, dst VARCHAR, created_at DOUBLE, updated_at DOUBLE, removed BOOLEAN, key VARCHAR, kind VARCHAR)")
    con.execute("CREATE TABLE citations (id BIGINT, target_address VARCHAR, src_address VARCHAR, created_at DOUBLE, removed BOOLEAN, key VARCHAR, field VARCHAR)")
    con.executemany("INSERT INTO nodes VALUES (?, ?, ?, ?, ?, ?, ?)", nodes)
    con.executemany("INSERT INTO citations VALUES (?, ?, ?, ?, ?, ?, ?)", cites)
    want = con.execute(P.ORACLES["p5_found"]).fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.select("id", "field", "kind").collect()) == order(want) and len(want) == 7
    assert order(O.by_period(got).select("field", "kind", "period_start", "n_refs", "n_keys").collect()) == order(con.execute(P.ORACLES["p5_by_period"]).fetchall())


def test_filter_never_drops_a_parent(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) AS k")
    f = O.bloom(keys, "k", 1)
    assert O.probe(keys, "k", f, 1).where("NOT maybe").count() == 0
    other = spark.range(10000, 20000).selectExpr("cast(id as string) AS k")
    assert O.probe(other, "k", f, 1).where("maybe").count() < 500
    assert O.bloom_blocks(10**12) == O.MAX_BLOCKS
