from pyspark.sql import functions as F

from moorgrid.operators.upsert import upsert_nodes
from moorgrid.streaming import admission as M
from moorgrid.streaming import announces as A
from moorgrid.streaming import index as I


def test_announces_in_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = spark.createDataFrame([("node", "a", "i", "n1", 5.0, 1, 9), ("peer", "p", "i", "x", 5.0, 2, 9), ("node", "b", "i", "n", 1.0, 3, 0)], A.ANNOUNCE)
    later = spark.createDataFrame([("node", "a", "i", "n2", 3.0, 4, 9), ("node", "c", "i", "n", 7.0, 5, 9)], A.ANNOUNCE)
    for part in (first, later):
        part.write.mode("append").parquet(src)
        A.ingest(spark.readStream.schema(A.ANNOUNCE).parquet(src), out, state).awaitTermination()
    got = {r["dst"]: r for r in A.VersionedTable(spark, out, A.STATE).read().collect()}
    assert set(got) == {"a", "c"} and got["a"]["name"] == "n2" and got["a"]["time"] == 3.0 and got["a"]["created_at"] == 5.0
    rows = first.unionByName(later).where("aspect = 'node' AND size > 0").select("dst", "identity", "name", "ts", "seq")
    batch = upsert_nodes(spark.createDataFrame([], A.STATE), rows)
    assert {r["dst"]: r["name"] for r in batch.collect()} == {k: v["name"] for k, v in got.items()}


def test_index_in_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "url string, text string, owner string, address string, nodeName string"
    for text in ("one", "two"):
        spark.createDataFrame([("u", text, "o", "a", None), (text, "t", "o", "a", None)], schema).write.mode("append").parquet(src)
        I.index_stream(spark.readStream.schema(schema).parquet(src), out, state, compact_every=2).awaitTermination()
    got = {r["url"]: r["raw"] for r in I.index_table(spark, out).read().collect()}
    assert got == {"u": "two", "one": "t", "two": "t"}


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    table = I.index_table(spark, str(tmp_path / "t"), 16)
    docs = spark.createDataFrame([(f"u{i}", "t", "o", "a", None, "t") for i in range(300)], I.DOCUMENT)
    table.write(docs, 0)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([(f"u{i}", "new", "o", "a", None, "new") for i in range(3)], I.DOCUMENT)
    hit = table.touched(batch)
    assert 0 < len(hit) < 4
    table.write(I.upsert_documents(table.read(1, hit), batch), 1)
    after = files()
    assert all(after[p] == t for p, t in before.items()) and {p.parent.name for p in set(after) - set(before)} == {f"b={b}" for b in hit}
    got = {r["url"]: r["text"] for r in table.read().collect()}
    assert len(got) == 300 and [u for u, t in got.items() if t == "new"] and sum(t == "new" for t in got.values()) == 3
    table.write(I.upsert_documents(table.read(1, hit), batch), 1)  # the batch once more
    assert table.read().count() == 300
    table.compact(2)
    assert {v[-1] for v in table.held().values()} == {2} and table.read().count() == 300


def test_admission_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", float(t)) for t in (0, 50, 100, 149, 200)], "url string, ts double").coalesce(1).write.parquet(src)
    q = M.admit_stream(spark.readStream.schema("url string, ts double").parquet(src), 100).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["ts"] for r in spark.table("admitted").select(F.col("ts")).collect()) == [0.0, 100.0, 200.0]
