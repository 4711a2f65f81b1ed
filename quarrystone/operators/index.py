"""The incremental index: snapshot differences, upserts, parse and embedding caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """rel_path, sha256, status and change: added, updated, unchanged or removed; what was removed before and isn't seen is kept.

    stored: rel_path, sha256, status; seen: rel_path, sha256. A path that comes back counts as updated.
    """
    a = stored.select("rel_path", F.col("sha256").alias("old"), F.col("status").alias("was"))
    b = seen.select("rel_path", F.col("sha256").alias("new"))
    change = (
        F.when(F.col("new").isNull(), F.when(F.col("was") == "active", "removed").otherwise("gone"))
        .when(F.col("old").isNull(), "added")
        .when((F.col("was") == "active") & (F.col("old") == F.col("new")), "unchanged")
        .otherwise("updated")
    )
    return a.join(b, "rel_path", "full_outer").select(
        "rel_path", F.coalesce("new", "old").alias("sha256"), F.when(F.col("new").isNull(), "removed").otherwise("active").alias("status"), change.alias("change")
    )


def upserted(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """The next stored table."""
    return compared(stored, seen).select("rel_path", "sha256", "status")


def stats(stored: DataFrame, seen: DataFrame) -> DataFrame:
    kinds = ("added", "updated", "unchanged", "removed")
    return compared(stored, seen).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def enabled_only(files: DataFrame, languages: list[str]) -> DataFrame:
    """Classified files of the enabled languages."""
    return files.filter(F.col("language").isin(*languages))


def skipped(files: DataFrame, languages: list[str]) -> DataFrame:
    """One row: files without a language, those of languages that aren't enabled, and those indexed."""
    on = F.col("language").isin(*languages)
    return files.agg(
        F.count_if(F.col("language").isNull()).alias("skipped_unknown"), F.count_if(~on).alias("skipped_disabled"), F.count_if(on).alias("indexed")
    )


def parse_key(text: Column, backend: str, kind: Column) -> Column:
    """The key of a parse: version, backend, kind and the text's hash."""
    return F.concat_ws(":", F.lit("1"), F.lit(backend), F.coalesce(kind, F.lit("")), F.sha2(text, 256))


def parse_cache(files: DataFrame, cache: DataFrame, backend: str = "regex") -> DataFrame:
    """One row: distinct keys to parse (misses) and files that need no parse of their own (hits)."""
    keyed = files.select(parse_key(F.col("text"), backend, F.col("kind")).alias("key"))
    per_key = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = cache.select("key").distinct().withColumn("_k", F.lit(True))
    met = per_key.join(known, "key", "left")
    return met.agg(
        F.count_if(F.col("_k").isNull()).alias("misses"), F.coalesce(F.sum(F.col("n") - F.when(F.col("_k").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("hits")
    )


def to_embed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose stored embedding is missing or of another text; snippet is what is embedded."""
    known = stored.select("rel_path", "sha256")
    now = files.withColumn("sha256", F.sha2(F.col("text"), 256))
    return now.join(known, ["rel_path", "sha256"], "left_anti").withColumn("snippet", F.substring("text", 1, 4000))
