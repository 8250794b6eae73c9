"""Response cache and stage artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, data string, cached_at timestamp"
#: Folders that keys are dealt to; a look-up reads those of its keys alone.
BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class ResponseCache:
    """A table of (key, data, cached_at); data is null for a known failure, the newest entry of a key counts, of equal times that with the greater data.

    A generation of the table is a folder ``gen=<n>`` of folders by bucket of the key.  Rows are appended to the newest generation that is complete;
    ``compact`` writes the entries that count into the next one and then marks it complete by one small file, so a crash before leaves the old
    generation in force, and one after it nothing but a folder to delete.  Writers and ``compact`` must not run at once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _hadoop(self, path: str) -> tuple:
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[tuple[int, bool]]:
        folder, files = self._hadoop(self.path)
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted((int(n.removeprefix("gen=")), f"complete={n.removeprefix('gen=')}" in names) for n in names if n.startswith("gen="))

    def generation(self) -> int:
        """The newest complete generation; 0, which needs no mark, before any compaction."""
        return max((n for n, complete in self._generations() if complete), default=0)

    def _write(self, rows: DataFrame, generation: int, mode: str) -> None:
        dealt = rows.withColumn("bucket", _bucket(F.col("key"), self.buckets))
        dealt.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/gen={generation}")

    def put(self, rows: DataFrame) -> None:
        self._write(rows.select("key", "data", F.coalesce("cached_at", F.current_timestamp()).alias("cached_at")), self.generation(), "append")

    def _entries(self) -> DataFrame:
        now = self.generation()
        if now not in [n for n, _ in self._generations()]:
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/gen={now}")

    def read(self) -> DataFrame:
        return self._newest(self._entries())

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        # The greatest (time, data) by key, in the map tasks first; a known failure is less than any data of its time.
        best = rows.groupBy("key").agg(F.max(F.struct("cached_at", "data")).alias("b"))
        return best.select("key", "b.data", "b.cached_at")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, data, cached_at, hit for each of the keys (column ``key``): only buckets that are asked for are read."""
        asked = keys.select("key").distinct().withColumn("bucket", _bucket(F.col("key"), self.buckets))
        wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are buckets
        rows = self._entries().filter(F.col("bucket").isin(wanted)).join(asked.select("key"), "key", "left_semi")
        return asked.select("key").join(self._newest(rows).withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def compact(self) -> None:
        now = self.generation()
        self._write(self.read(), now + 1, "overwrite")
        mark, files = self._hadoop(f"{self.path}/complete={now + 1}")
        files.create(mark, True).close()
        self._drop_before(now + 1)

    def _drop_before(self, generation: int) -> None:
        for n, _ in self._generations():
            if n < generation:
                for name in (f"gen={n}", f"complete={n}"):
                    path, files = self._hadoop(f"{self.path}/{name}")
                    files.delete(path, True)

    def clear(self) -> None:
        folder, files = self._hadoop(self.path)
        files.delete(folder, True)


class Stages:
    """Parquet artifacts of a run, by stage."""

    def __init__(self, spark: SparkSession, root: str, run_key: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{run_key}"

    def put(self, stage: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{stage}")
        return self.get(stage)

    def get(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{stage}")

    def has(self, stage: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{stage}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @staticmethod
    def runs(spark: SparkSession, root: str) -> list[str]:
        """Keys of the runs below ``root``, the one written last first."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(folder) if s.isDirectory()]
        return [name for _, name in sorted(found, reverse=True)]
