"""Index upserts in micro-batches with periodic compaction and a flush on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from moorgrid.operators.search import documents, upsert_documents
from moorgrid.sources.versioned import VersionedTable

DOCUMENT = "url STRING, text STRING, owner STRING, address STRING, nodeName STRING, raw STRING"
COMPACT_EVERY = 25


def index_table(spark: SparkSession, path: str, buckets: int = 32) -> VersionedTable:
    return VersionedTable(spark, path, DOCUMENT, "url", buckets)


def index_stream(stream: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY, buckets: int = 32) -> StreamingQuery:
    """Upserts a stream of search documents by url; a batch rewrites the buckets of its urls alone.

    Every so many batches all buckets are brought under one version."""
    table = index_table(stream.sparkSession, path, buckets)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if number % compact_every == compact_every - 1:
            table.write(upsert_documents(table.read(number), batch), number)
        else:
            table.write(upsert_documents(table.read(number, table.touched(batch)), batch), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(query: StreamingQuery, table: VersionedTable, compact: bool = True) -> None:
    """Waits until all input that has arrived is in the table, and compacts it now instead of at the next interval."""
    query.processAllAvailable()
    query.stop()
    done = table.versions()
    if compact and done:
        table.compact(done[-1] + 1 if len({v[-1] for v in table.held().values()}) > 1 else done[-1])
