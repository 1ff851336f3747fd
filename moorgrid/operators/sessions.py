"""Sessions of each entity from one reusable gap tree.

The consecutive gaps of an entity's events form a Cartesian tree with the largest gap at the root.
A threshold cuts the tree: the subtrees whose own largest gap is at most the threshold while the
gap above them is larger are the sessions. The tree is stored as rows (entity, start_time, end_time,
n_events, gap, parent_gap), so sessions for any threshold are one filter on that table.

Chunks: events are first counted per (entity, time), then range-partitioned by (entity, time), so
one entity with a third of all rows is spread over many tasks. Each task builds the tree of its
piece. What a neighbouring piece could still change is the outer spine alone; its blocks (start,
end, count, inner gap) are passed on and the same algorithm joins them per entity. For gaps in
random order a spine has about ln(n) blocks. Equal gaps, as a clock makes them, do not lengthen it: the blocks
between two of them are finished and pass on as one. So a spine has at most two blocks for each
different gap of a run of gaps that only grows or only shrinks; n such gaps, a microsecond apart,
take n * n / 2 microseconds, so 45 days hold at most 2.8 million of them (some 5 seconds in one task).

Defined cases: rows with null time, or null or blank entity, are left out; a repeated id counts
once; rows with a null id count once per distinct content; equal times are one point with several
events; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = "entity STRING, start_time DOUBLE, end_time DOUBLE, n_events BIGINT, gap DOUBLE, parent_gap DOUBLE"
_COLS = ["entity", "start_time", "end_time", "n_events", "gap", "parent_gap"]


def normal_identity(c: Column) -> Column:
    """Lower case without surrounding white space; null when nothing is left."""
    x = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(x != "", x)


def points(events: DataFrame, entity: str, time: str, value: str | None = None, key: str | None = None) -> DataFrame:
    """(entity, t, n): events per entity and instant; value, when given, must be neither null nor blank."""
    rows = events.select(
        normal_identity(F.col(entity)).alias("entity"),
        F.col(time).cast("double").alias("t"),
        (F.col(value) if value else F.lit("x")).cast("string").alias("v"),
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("k"),
    ).where(F.col("entity").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t") & F.col("v").rlike(r"(?U)\S"))
    if key:
        own = F.coalesce(F.concat(F.lit("k"), "k"), F.concat(F.lit("r"), F.to_json(F.struct("entity", "t", "v"))))
        rows = rows.groupBy(own.alias("_k")).agg(F.min(F.struct("entity", "t")).alias("r")).select("r.entity", "r.t")
    return rows.groupBy("entity", "t").agg(F.count(F.lit(1)).alias("n"))


def _build(start, end, n, gap, left_open: bool, right_open: bool):
    """Tree rows of one run of blocks, and the blocks that a neighbour may still change."""
    m = len(start)
    g = np.empty(m + 1)
    g[0] = g[m] = np.inf
    g[1:m] = start[1:] - end[:-1]
    before, after, stack = np.zeros(m + 1, dtype=np.int64), np.full(m + 1, m, dtype=np.int64), []
    heights = g.tolist()
    for i in range(1, m):
        h = heights[i]
        while stack and heights[stack[-1]] <= h:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else 0
        stack.append(i)
    inner = np.arange(1, m)
    pg, ng = before[1:m], after[1:m]
    spine = np.zeros(m + 1, dtype=bool)
    spine[1:m] = (left_open & (pg == 0)) | (right_open & (ng == m))
    edge = spine.copy()
    edge[0], edge[m] = left_open, right_open
    cum = np.r_[0, np.cumsum(n)]
    out, rest = [], []
    for lo, hi, own in ((pg, ng, g[inner]), (np.arange(m), np.arange(1, m + 1), gap)):
        whole = (edge[lo] | (lo == 0)) & (edge[hi] | (hi == m)) & bool(left_open or right_open)
        if own is not gap:
            whole_row = whole & ~spine[inner]
            done = ~whole & ~spine[inner]
        else:
            whole_row, done = whole, ~whole
        row = (start[lo], end[hi - 1], cum[hi] - cum[lo], own, np.minimum(g[lo], g[hi]))
        out.append([x[done] for x in row])
        rest.append([x[whole_row] for x in row])
    return [np.concatenate(x) for x in zip(*out)], [np.concatenate(x) for x in zip(*rest)]


def _packed(rest: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(finished rows, open blocks) of a spine: runs of blocks between equal gaps are finished and become one block."""
    order = np.lexsort((rest[1], rest[0]))
    start, end, n, own, parent = (x[order] for x in rest)
    g = start[1:] - end[:-1]
    inner = np.zeros(len(start), dtype=bool)
    if len(g) > 1:
        inner[1:-1] = g[1:] == g[:-1]
    edge = np.diff(np.r_[False, inner, False].astype(np.int8))
    runs = [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if b - a > 1]
    if not runs:
        return [x[:0] for x in rest], [start, end, n, own, parent]
    gone, cum = np.zeros(len(start), dtype=bool), np.r_[0, np.cumsum(n)]
    made = []
    for a, b in runs:
        gone[a:b] = True
        made.append((start[a], end[b - 1], cum[b] - cum[a], g[a], g[a]))
    between = np.r_[g, np.inf]  # an inner block's parent is the gap on either side
    done = [start[gone], end[gone], n[gone], own[gone], between[gone]]
    return done, [np.concatenate([x[~gone], np.array(m, dtype=x.dtype)]) for x, m in zip((start, end, n, own, parent), zip(*made))]


def _piece(batches):
    """One range partition: complete entities are finished, the first and the last stay open outside."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    name = t["entity"].combine_chunks().to_pandas().to_numpy()
    time, n = t["t"].to_numpy(), t["n"].to_numpy()
    cut = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        done, rest = _build(time[a:b], time[a:b], n[a:b], np.zeros(b - a), k == 0, k == len(cut) - 2)
        if len(rest[0]) > 3:
            sure, rest = _packed(rest)
            done = [np.concatenate(x) for x in zip(done, sure)]
            done = [x[done[3] < done[4]] for x in done]  # no threshold lies between equal gaps
        for rows, is_open in ((done, False), (rest, True)):
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name[a]] * len(rows[0]), pa.string()), *(pa.array(x) for x in rows), pa.array([is_open] * len(rows[0]))],
                    names=[*_COLS, "is_open"],
                )


def _close(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["start_time", "end_time"])
    done, _ = _build(*(pdf[c].to_numpy() for c in ("start_time", "end_time", "n_events", "gap")), False, False)
    return pd.DataFrame(dict(zip(_COLS[1:], done))).assign(entity=pdf["entity"].iloc[0])[_COLS]


def gap_tree(pts: DataFrame) -> DataFrame:
    """The tree of every entity, from points(); reusable for many thresholds."""
    from moorgrid.session import checkpoint

    ordered = pts.repartitionByRange("entity", "t").sortWithinPartitions("entity", "t")
    pieces = checkpoint(ordered.mapInArrow(_piece, TREE + ", is_open BOOLEAN"))
    joined = pieces.where("is_open").drop("is_open", "parent_gap").groupBy("entity").applyInPandas(_close, TREE)
    return pieces.where("NOT is_open").drop("is_open").unionByName(joined)


def cut(tree: DataFrame, threshold: float) -> DataFrame:
    """Sessions at one threshold: a session goes on while the gap is at most the threshold."""
    return tree.where((F.col("gap") <= F.lit(float(threshold))) & (F.col("parent_gap") > F.lit(float(threshold)))).select(
        "entity", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_events"
    )


def cut_many(tree: DataFrame, thresholds: list[float]) -> DataFrame:
    """Sessions at several thresholds in one pass over the tree, with the column threshold."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(thresholds))])).alias("threshold")
    rows = tree.select("*", at).where((F.col("gap") <= F.col("threshold")) & (F.col("parent_gap") > F.col("threshold")))
    return rows.select("threshold", "entity", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_events")
