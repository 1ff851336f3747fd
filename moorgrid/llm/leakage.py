"""Evaluation items whose text occurs, whole or in part, in corpus documents.

A prefix-filtered set join. A passage of WINDOW consecutive words of an item is a set of
WINDOW - SHINGLE + 1 shingles, all of which a leaking document must contain; for full containment
the necessary prefix under the order by rarity is one shingle, the rarest of the window. Steps:

1. The items' shingles make a Bloom filter of a bounded size (MAX_WORDS, 8 MiB), whatever their number.
2. One scan of the corpus keeps of each document the passages that could hold a window: the words under
   WINDOW - SHINGLE + 1 or more consecutive shingles that pass the filter. No other text leaves the scan,
   and equal passages of any number of documents are one row from there on.
3. Frequencies of the shingles over all documents give the order by rarity. The rarest shingle of every
   item window is joined with the passages' shingles; positional and length bounds place the window in
   the passage, and the words of both are compared there. Passages lead back to their documents.

Defined cases: null or empty texts and items with fewer words than the window match nothing; rows with
a null key are left out; several texts under one item key are all searched for; a repeated row gives its
pair once; texts of any length are scanned whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorgrid.llm.bits import filter_of, passes
from moorgrid.llm.words import shingles, word_hashes, words
from moorgrid.session import checkpoint

WINDOW, SHINGLE = 12, 5
SPAN = WINDOW - SHINGLE + 1
TEXT = "tid BIGINT, words ARRAY<STRING>, hashes ARRAY<BIGINT>"


def _item_rows(batches):
    """(item, text id, words, shingles) of the item texts that have a window."""
    for b in batches:
        keys, ids, ws, hs = [], [], [], []
        for k, tid, t in zip(*(c.to_pylist() for c in b.columns)):
            w = words(t)
            if len(w) >= WINDOW:
                keys.append(k)
                ids.append(tid)
                ws.append(w)
                hs.append(shingles(word_hashes(w), SHINGLE).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(ws, pa.list_(pa.string())), pa.array(hs, pa.list_(pa.int64()))], names=["item", "tid", "words", "hashes"])


def _passages(sent):
    """(doc, words): the passages whose shingles all pass the filter, where a window fits in."""

    def run(batches):
        filt = sent.value
        for b in batches:
            doc, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                if len(ws) < WINDOW:
                    continue
                ok = passes(filt, shingles(word_hashes(ws), SHINGLE))
                if not ok.any():
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
                for a, z in zip(edge[::2], edge[1::2]):
                    if z - a >= SPAN:
                        doc.append(k)
                        out.append(ws[a : z + SHINGLE - 1])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["doc", "words"])

    return run


def _with_shingles(batches):
    for b in batches:
        hs = [shingles(word_hashes(w), SHINGLE).view(np.int64) for w in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hs, pa.list_(pa.int64()))], names=["pid", "n_docs", "hashes"])


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, bits_per_key: int = 32) -> DataFrame:
    """(doc, item): the document and the item have WINDOW or more consecutive words in common."""
    spark = docs.sparkSession
    it = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    it = it.select("item", F.xxhash64("item", "t").alias("tid"), "t").mapInArrow(_item_rows, f"item BIGINT, {TEXT}")
    it = checkpoint(it)
    filt = filter_of(it.select(F.explode("hashes").alias("h")).distinct(), bits_per_key)
    own = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    found = own.mapInArrow(_passages(spark.sparkContext.broadcast(filt)), "doc BIGINT, words ARRAY<STRING>")
    found = checkpoint(found.select("doc", F.xxhash64("words").alias("pid"), "words").distinct())
    # equal passages are one row; the pair of a hash and the number of words tells them apart
    once = found.groupBy("pid", "words").agg(F.count(F.lit(1)).alias("n_docs"))
    once = checkpoint(once.select("pid", "n_docs", "words"))
    at = once.mapInArrow(_with_shingles, "pid BIGINT, n_docs BIGINT, hashes ARRAY<BIGINT>").select("pid", "n_docs", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    df = at.groupBy("h").agg(F.sum("n_docs").alias("df"))
    each = it.select("tid", F.posexplode("hashes").alias("w", "h")).join(df, "h")
    # the rarest of the SPAN shingles from each position on; one that no document has leaves a hole
    ahead = Window.partitionBy("tid").orderBy("w").rangeBetween(0, SPAN - 1)
    rarest = each.select("tid", "w", F.count(F.lit(1)).over(ahead).alias("m"), F.min(F.struct("df", "w", "h")).over(ahead).alias("r")).where(F.col("m") == SPAN)
    prefix = rarest.select("tid", "w", F.col("r.h").alias("h"), (F.col("r.w") - F.col("w")).alias("off"))
    placed = at.select("pid", "n", "pos", "h").join(prefix, "h").select("pid", "tid", "w", (F.col("pos") - F.col("off")).alias("d"), "n")
    placed = placed.where(f"d >= 0 AND d + {SPAN} <= n").select("pid", "tid", "w", "d")
    same = placed.join(once.select("pid", F.col("words").alias("x")), "pid").join(it.select("tid", "item", F.col("words").alias("y")), "tid")
    same = same.where(F.slice("x", F.col("d") + 1, WINDOW) == F.slice("y", F.col("w") + 1, WINDOW)).select("pid", "item").distinct()
    return found.select("doc", "pid").distinct().join(same, "pid").select("doc", "item").distinct()
