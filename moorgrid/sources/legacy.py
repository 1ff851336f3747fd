"""Readers of the older JSON files, which hold one map or array each; a missing file gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "STRUCT<dst: STRING, identity: STRING, name: STRING, time: DOUBLE>"
SCHEMAS = {
    "announces": f"nodes MAP<STRING, {ENTRY}>, peers MAP<STRING, {ENTRY}>",
    "citations": "for_search MAP<STRING, ARRAY<STRING>>",
    "queries": "queries ARRAY<STRING>",
    "user_data": "MAP<STRING, ARRAY<STRUCT<q: STRING, time: DOUBLE>>>",
}


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One column j with the parsed document of each file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "value STRING").select(F.from_json("value", SCHEMAS[kind]).alias("j"))
    return parse(spark.read.text(path, wholetext=True), kind)


def parse(text: DataFrame, kind: str, column: str = "value") -> DataFrame:
    return text.select(F.from_json(F.col(column), SCHEMAS[kind]).alias("j"))


def announces(j: DataFrame, aspect: str) -> DataFrame:
    """(dst, identity, name, time) of the nodes or peers."""
    return j.select(F.explode(f"j.{aspect}").alias("k", "v")).select("v.dst", "v.identity", "v.name", "v.time").where("dst IS NOT NULL")


def citations(j: DataFrame) -> DataFrame:
    """(target_address, src_address): distinct sources per target, both of 32 characters."""
    pairs = j.select(F.explode("j.for_search").alias("target_address", "s")).select("target_address", F.explode(F.array_distinct("s")).alias("src_address"))
    return pairs.where("length(target_address) = 32 AND length(src_address) = 32")


def queries(j: DataFrame) -> DataFrame:
    return j.select(F.explode("j.queries").alias("query")).where("query IS NOT NULL AND query <> ''")


def user_data(j: DataFrame) -> DataFrame:
    """(remote_identity, query, time); malformed items are dropped."""
    rows = j.select(F.explode("j").alias("remote_identity", "items")).select("remote_identity", F.explode("items").alias("i"))
    return rows.select("remote_identity", F.col("i.q").alias("query"), "i.time").where("query IS NOT NULL AND time IS NOT NULL")
