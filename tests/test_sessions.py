import random
from collections import defaultdict

import pytest

from moorgrid.operators import sessions as S

SCHEMA = "id long, remote_identity string, query string, time double, entity string, n long"


def brute(rows, gap):
    by, seen = defaultdict(list), set()
    for i, who, q, t, *_ in rows:
        if who and who.strip() and q and q.strip() and t is not None and i not in seen:
            seen.add(i)
            by[who.strip().lower()].append(t)
    out = []
    for who, ts in by.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:]:
            if t - run[-1] > gap:
                out.append((who, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((who, run[0], run[-1], len(run)))
    return sorted(out)


def run(spark, rows, gaps, parts=4):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    tree = S.gap_tree(S.points(spark.createDataFrame(rows, SCHEMA), "remote_identity", "time", "query", "id")).cache()
    got = {g: sorted((r["entity"], r["start_time"], r["end_time"], r["n_events"]) for r in S.cut(tree, g).collect()) for g in gaps}
    many = {(r["threshold"], r["entity"], r["start_time"]) for r in S.cut_many(tree, gaps).collect()}
    assert many == {(float(g), e, s) for g in gaps for e, s, *_ in got[g]}
    return got


@pytest.mark.parametrize("seed", range(3))
def test_any_threshold(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["A", " a ", "b", "c\t", None, " "]), r.choice(["q", "", None, "x"]), r.choice([None, float(r.randint(0, 400)), r.random() * 5000]), "clash", 7) for i in range(900)]
    rows += rows[:60]
    gaps = [0, 1, 5, 20, 1800]
    got = run(spark, rows, gaps)
    for g in gaps:
        assert got[g] == brute(rows, g)


def test_one_hot_entity_over_many_tasks(spark):
    r = random.Random(9)
    rows = [(i, "hot", "q", r.random() * 1e6, None, None) for i in range(4000)] + [(5000 + i, f"u{i}", "q", 1.0 * i, None, None) for i in range(50)]
    got = run(spark, rows, [50, 300, 2000], parts=8)
    for g in got:
        assert got[g] == brute(rows, g)


@pytest.mark.parametrize("times", [[2.0**i for i in range(40)], [2.0**40 - 2.0 ** (40 - i) for i in range(40)], [5.0] * 30, [float(i) for i in range(100)]])
def test_growing_shrinking_and_equal_gaps(spark, times):
    rows = [(i, "e", "q", t, None, None) for i, t in enumerate(times)]
    got = run(spark, rows, [0, 1, 64, 1e6], parts=6)
    for g in got:
        assert got[g] == brute(rows, g)


def test_empty(spark):
    assert run(spark, [], [10]) == {10: []}


def test_a_clock_makes_no_long_spine(spark):
    from moorgrid.operators import sessions as S

    times = [60.0 * i for i in range(20000)] + [2e6 + 60.0 * i for i in range(5000)] + [4e6 + 7.0 * i for i in range(3000)]
    df = spark.createDataFrame([("bot", t, "q", i) for i, t in enumerate(times)], "e string, t double, q string, id long").repartition(4)
    pts = S.points(df, "e", "t", "q", "id")
    ordered = pts.repartitionByRange(7, "entity", "t").sortWithinPartitions("entity", "t")
    assert ordered.mapInArrow(S._piece, S.TREE + ", is_open BOOLEAN").where("is_open").count() < 60
    tree = S.gap_tree(pts).cache()
    for threshold, want in ((5, [1] * 28000), (7, [1] * 25000 + [3000]), (60, [3000, 5000, 20000]), (1e9, [28000])):
        assert sorted(r["n_events"] for r in S.cut(tree, threshold).collect()) == want
