"""Tables that are kept between runs: Parquet in a folder of the cluster's store, a new version for each change.

A version is whole once its writer has said so (_SUCCESS), readers take the last whole one, and older ones go after it, so no table is
overwritten while it is read.  Changes to one table must come one after another; two writers at once would both start from the same
version, and the one that ends second fails as its folder exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        place = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(place):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(place)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{name}/{n}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def load(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def save(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as the table's new version; the version before it stays for who still reads it, older ones go."""
        versions = self._versions(name)
        place = f"{self.folder}/{name}/v{(versions[-1] if versions else 0) + 1}"
        rows.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(place)
        for old in versions[:-1]:
            self._fs.delete(self._path(f"{self.folder}/{name}/v{old}"), True)
        return self.spark.read.parquet(place)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Events and other rows that are only ever added."""
        return self.save(name, self.load(name).unionByName(rows, allowMissingColumns=True) if self.exists(name) else rows)

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        """rows in place of those of equal keys; of rows with equal keys among the new ones any one stays."""
        new = rows.dropDuplicates(key)
        if not self.exists(name):
            return self.save(name, new)
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key]
        kept = self.load(name).alias("old").join(new.select(*key).alias("new"), same, "left_anti")
        return self.save(name, kept.unionByName(new, allowMissingColumns=True))

    def count(self, name: str) -> int:
        return self.load(name).count() if self.exists(name) else 0

    def clear(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    # Runs, their documents, events and exports.

    def create_run(self, run_id: str, created_at: str, **facts: str) -> DataFrame:
        row = {"run_id": run_id, "created_at": created_at, "status": "created"} | facts
        made = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
        if self.exists("runs") and not self.load("runs").filter(F.col("run_id") == run_id).isEmpty():
            raise ValueError(f"run {run_id} exists")
        return self.append("runs", made)

    def documents(self, run_id: str, work_id: str | None = None) -> DataFrame:
        rows = self.load("documents").filter(F.col("run_id") == run_id)
        return rows if work_id is None else rows.filter(F.col("work_id") == work_id)

    def run(self, run_id: str) -> DataFrame:
        return self.load("runs").filter(F.col("run_id") == run_id)

    def review_events(self, run_id: str) -> DataFrame:
        return self.load("review_events").filter(F.col("run_id") == run_id)
