"""A stored index: Parquet tables in versions, each written whole before it counts; and an audit log."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables and their keys; findings have none and are replaced as a whole.
KEYS = {"artifacts": "rel_path", "embeddings": "rel_path", "parse_cache": "key"}


@dataclass
class Store:
    """Tables under a folder that all executors share. One writer at a time; readers see the last whole version."""

    spark: SparkSession
    path: str

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self, table: str) -> list[int]:
        """Numbers of the whole versions of a table, in order."""
        fs, top = self._files(f"{self.path}/{table}")
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(self._files(f"{p}/_SUCCESS")[1]))

    def read(self, table: str) -> DataFrame | None:
        """The last version; None where there is none."""
        known = self.versions(table)
        return self.spark.read.parquet(f"{self.path}/{table}/{known[-1]:08d}") if known else None

    def replace(self, table: str, rows: DataFrame, keep: int = 2) -> DataFrame:
        """A new version with these rows only; the last `keep` versions stay for those who read them."""
        known = self.versions(table)
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{known[-1] + 1 if known else 0:08d}")
        for old in known[: max(0, len(known) + 1 - keep)]:
            fs, target = self._files(f"{self.path}/{table}/{old:08d}")
            fs.delete(target, True)
        return self.read(table)

    def merge(self, table: str, rows: DataFrame) -> DataFrame:
        """A new version in which rows replace those of the same key; of several new rows of a key the greatest stays."""
        key = KEYS[table]
        order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rows.columns if c != key])
        new = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
        old = self.read(table)
        return self.replace(table, new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new))

    def record(self, event: str, **fields) -> None:
        """Append an event to the audit log, a line of JSON with its time in UTC."""
        line = json.dumps({"ts": datetime.now(timezone.utc).isoformat(), "event": event, **fields}, default=str)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/audit")

    def events(self) -> DataFrame:
        """ts, event and line of all events in order."""
        rows = self.spark.read.text(f"{self.path}/audit").withColumnRenamed("value", "line")
        return rows.select(F.get_json_object("line", "$.ts").alias("ts"), F.get_json_object("line", "$.event").alias("event"), "line").orderBy("ts")
