"""Tables in buckets of a key, whose batches rewrite only the buckets that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Parquet buckets by a key: path/v=<batch>/b=<bucket>; of each bucket the largest finished batch holds."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "dst", buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, at, prefix: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, "/".join(parts))

    def versions(self) -> list[int]:
        """Batches that were written to their end."""
        return [v for v in self._names(self._root, "v=") if self._fs.exists(self._at(f"v={v}", "_SUCCESS"))]

    def held(self, before: int | None = None) -> dict[int, list[int]]:
        """The batches that wrote each bucket, oldest first."""
        out: dict[int, list[int]] = {}
        for v in self.versions():
            if before is None or v < before:
                for b in self._names(self._at(f"v={v}"), "b="):
                    out.setdefault(b, []).append(v)
        return out

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v={v[-1]}/b={b}" for b, v in self.held(before).items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys; at most as many as there are buckets."""
        return [r[0] for r in rows.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect()]

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        """Writes whole buckets as the batch's version; each bucket keeps its last versions."""
        df.withColumn("b", self.bucket()).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/v={version}")
        for b, v in self.held().items():
            for old in v[:-keep]:
                self._fs.delete(self._at(f"v={old}", f"b={b}"), True)

    def compact(self, version: int) -> None:
        """Every bucket under one version."""
        self.write(self.read(before=version + 1), version)
