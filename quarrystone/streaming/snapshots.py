"""Incremental indexing as a stream: each batch of seen files is merged into the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import upserted
from ..sources.storage import materialise


def index_stream(seen: DataFrame, stored: list[DataFrame]):
    """A stream writer that upserts batches of (rel_path, sha256); stored[0] holds the current table.

    A batch names only what has changed, so paths it doesn't name keep their state.
    """

    def merge(batch: DataFrame, _: int) -> None:
        now = batch.groupBy("rel_path").agg(F.max("sha256").alias("sha256"))
        same = stored[0].filter("status = 'active'").join(now.select("rel_path"), "rel_path", "left_anti").select("rel_path", "sha256")
        stored[0] = materialise(upserted(stored[0], now.unionByName(same)), "index")

    return seen.writeStream.foreachBatch(merge).trigger(availableNow=True)
