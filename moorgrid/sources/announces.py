"""The announce log: JSON lines {"datetime", "dst"}, one file or folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorgrid.functions.timefmt import iso_seconds, to_timestamp


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(dst, ts) of the valid lines: blank and malformed lines, and lines without dst or a good time, are skipped."""
    j = lines.select(F.from_json(F.col(column), "datetime STRING, dst STRING").alias("j"))
    return j.select("j.dst", iso_seconds(F.col("j.datetime")).alias("ts")).where("dst IS NOT NULL AND ts IS NOT NULL")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def read_configured(spark: SparkSession, settings) -> DataFrame:
    """The log under the settings' LOG_PATH."""
    return read_log(spark, settings.announce_log())


def drop_configured(spark: SparkSession, settings) -> list[str]:
    """Deletes the days beyond the settings' number of files to keep."""
    return drop_old_days(spark, settings.announce_log(), settings.NOMAD_NODE_ANNOUNCE_LOG_KEEP_DAYS)


def recent(announces: DataFrame, as_of: float, lookback_days: float = 14) -> DataFrame:
    """Announces of the look-back; one exactly at its start counts."""
    return announces.where(F.col("ts") >= as_of - max(1, int(lookback_days)) * 86400)


def write_log(announces: DataFrame, path: str) -> None:
    """Appends (dst, ts) as JSON lines in one folder per UTC day."""
    t = to_timestamp(F.col("ts"))
    rows = announces.select(F.date_format(t, "yyyy-MM-dd").alias("day"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"), "dst")
    rows.write.mode("append").partitionBy("day").json(path)


def drop_old_days(spark: SparkSession, path: str, keep: int = 14) -> list[str]:
    """Deletes all but the newest day folders; returns the deleted days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("day="))
    old = days[: -max(1, int(keep))]
    for d in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, d), True)
    return [d[4:] for d in old]
