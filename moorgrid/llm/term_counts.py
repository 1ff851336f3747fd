"""Frequency of every distinct term from compressed record-identifier bitmaps.

Vertical layout: for every term the identifiers of its records are kept as containers of 65,536
identifiers each (identifier >> 16 names the container): sorted 16-bit values while there are fewer
than 4,096, a bitmap of 8,192 bytes otherwise. Parallel to each container runs a counter of
occurrences. Tasks build containers over their own rows, containers of one (term, number) merge by
union, and the document frequency is the sum of cardinalities. A term in a third of all records is
split over its containers, so no task holds all of its identifiers.

Defined cases: rows with null text are no records; texts without words are records without terms;
a repeated identifier is one record (the smallest text counts); rows with a null identifier are
left out, as they name no record; an empty table gives no terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.llm.words import words

ARRAY_MAX, CHUNK = 4096, 1 << 16
SCHEMA = "term STRING, chunk BIGINT, ids BINARY, n_records BIGINT, n_occurrences BIGINT"


def encode(low: np.ndarray) -> bytes:
    """A container from sorted distinct values below 65,536."""
    if len(low) < ARRAY_MAX:
        return low.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def decode(container: bytes) -> np.ndarray:
    if len(container) < CHUNK // 8:
        return np.frombuffer(container, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8), bitorder="little"))


def union(containers: list[bytes]) -> bytes:
    if len(containers) == 1:
        return containers[0]
    bits = np.zeros(CHUNK, dtype=bool)
    for c in containers:
        bits[decode(c)] = True
    return encode(np.flatnonzero(bits))


def _flush(terms: list[str], ids: list[np.ndarray]):
    code, names = pd.factorize(np.array(terms, dtype=object))
    rec = np.concatenate(ids)
    order = np.lexsort((rec, code))
    code, rec = code[order], rec[order]
    new_group = np.r_[True, (code[1:] != code[:-1]) | (rec[1:] >> 16 != rec[:-1] >> 16)]
    at = np.flatnonzero(new_group)
    end = np.r_[at[1:], len(code)]
    low = rec & (CHUNK - 1)
    fresh = new_group | np.r_[True, rec[1:] != rec[:-1]]
    packed = [encode(low[a:b][fresh[a:b]]) for a, b in zip(at, end)]
    count = np.add.reduceat(fresh.astype(np.int64), at)
    return pa.RecordBatch.from_arrays(
        [pa.array(names[code[at]], pa.string()), pa.array(rec[at] >> 16), pa.array(packed, pa.binary()), pa.array(count), pa.array(end - at)],
        names=["term", "chunk", "ids", "n_records", "n_occurrences"],
    )


def _vertical(flush_at: int):
    def run(batches):
        terms, ids = [], []
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                if ws:
                    terms.extend(ws)
                    ids.append(np.full(len(ws), i, dtype=np.int64))
            if len(terms) >= flush_at:
                yield _flush(terms, ids)
                terms, ids = [], []
        if terms:
            yield _flush(terms, ids)

    return run


def _merge(batches):
    """Union of neighbouring rows of one (term, chunk); the input is sorted by them."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        term = t["term"].to_pandas().to_numpy()
        chunk = t["chunk"].to_numpy()
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])])
        held = t.slice(int(at[-1]))
        if at[-1]:
            yield from _united(t.slice(0, int(at[-1])), at[:-1], int(at[-1]))
    if held is not None and held.num_rows:
        yield from _united(held, np.array([0]), held.num_rows)


def _united(t: pa.Table, at: np.ndarray, n: int):
    ids, end = t["ids"].to_pylist(), np.r_[at[1:], n]
    single = end - at == 1
    out = [ids[a] if s else union(ids[a:b]) for a, b, s in zip(at, end, single)]
    records = t["n_records"].to_numpy()[at].copy()
    for k in np.flatnonzero(~single):
        records[k] = len(decode(out[k]))
    occ = np.add.reduceat(t["n_occurrences"].to_numpy(), at)
    yield from pa.table({"term": t["term"].take(pa.array(at)), "chunk": t["chunk"].take(pa.array(at)), "ids": pa.array(out, pa.binary()), "n_records": records, "n_occurrences": occ}).to_batches()


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text): distinct records with non-null text."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.groupBy("id").agg(F.min("text").alias("text"))


def postings(recs: DataFrame, flush_at: int = 1_000_000) -> DataFrame:
    """(term, chunk, ids, n_records, n_occurrences): merged containers of every term, from records()."""
    built = recs.mapInArrow(_vertical(flush_at), SCHEMA)
    return built.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(_merge, SCHEMA)


def term_table(df: DataFrame, key: str, text: str, rare_max: int = 2, common_share: float = 0.01) -> DataFrame:
    """(term, n_records, n_occurrences, mark): mark is 'rare', 'common' or null; rare wins."""
    recs = records(df, key, text)
    total = recs.count()
    each = postings(recs).groupBy("term").agg(F.sum("n_records").alias("n_records"), F.sum("n_occurrences").alias("n_occurrences"))
    mark = F.when(F.col("n_records") <= rare_max, "rare").when(F.col("n_records") >= common_share * total, "common")
    return each.withColumn("mark", mark)
