"""Parquet tables of the mesh store and their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moorgrid.session import parallelism, ship

SCHEMAS = {
    "nodes": "id BIGINT, dst STRING, identity STRING, name STRING, time DOUBLE, created_at DOUBLE, updated_at DOUBLE, rank DOUBLE, removed BOOLEAN, announce_alpha DOUBLE, announce_beta DOUBLE, announce_window_seconds DOUBLE, announce_k_events INT",
    "peers": "id BIGINT, dst STRING, identity STRING, name STRING, time DOUBLE, created_at DOUBLE, updated_at DOUBLE",
    "citations": "id BIGINT, target_address STRING, src_address STRING, created_at DOUBLE, removed BOOLEAN",
    "search_queries": "id BIGINT, query STRING, created_at DOUBLE",
    "user_search_history": "id BIGINT, remote_identity STRING, query STRING, time DOUBLE, created_at DOUBLE",
    "crawl_visited_urls": "id BIGINT, url STRING, created_at DOUBLE, last_visited_at DOUBLE",
    "search_documents": "url STRING, text STRING, owner STRING, address STRING, nodeName STRING",
    "search_results": "url STRING, text STRING, owner STRING, address STRING, name STRING, score DOUBLE, p_dead_low DOUBLE, p_dead_high DOUBLE, time DOUBLE, since_announce STRING",
    "announce_log": "datetime STRING, dst STRING",
    "store": "key STRING, value STRING",
}


#: Tables of long texts, whose operators spend far more on a row than a shuffle does.
TEXTS = {"search_documents", "documents"}


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks can run; a table of many files stays as it is."""
    n = parallelism(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; column pruning and filters reach the Parquet scan."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def open_or_create(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, or an empty one of the declared schema where nothing is stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hadoop) else empty(spark, name)
