"""Announce ingest: a stream of announces keeps the latest state per node and peer.

Arrival order decides, not event time: within a batch by seq, across batches by the batch. The table
lies in buckets of its key. A batch reads and rewrites only the buckets that it has keys of, under a
folder of its own number, so its cost follows the batch and the buckets it touches, and a repeated
batch (after a failure) writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moorgrid.operators.upsert import upsert_nodes
from moorgrid.sources.versioned import VersionedTable

ANNOUNCE = "aspect STRING, dst STRING, identity STRING, name STRING, ts DOUBLE, seq BIGINT, size INT"
STATE = "dst STRING, identity STRING, name STRING, time DOUBLE, created_at DOUBLE, updated_at DOUBLE, rank DOUBLE, removed BOOLEAN"


def ingest(stream: DataFrame, path: str, checkpoint: str, aspect: str = "node", buckets: int = 32) -> StreamingQuery:
    """Starts the upsert of a stream of ANNOUNCE rows and ends when all available input is in."""
    table = VersionedTable(stream.sparkSession, path, STATE, "dst", buckets)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.where((F.col("aspect") == aspect) & (F.col("size") > 0)).select("dst", "identity", "name", "ts", "seq").persist()
        table.write(upsert_nodes(table.read(number, table.touched(rows)), rows), number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
