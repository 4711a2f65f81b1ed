"""Cosine similarity, top-k search and related context over stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gateway import Gateway


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float] | Column, k: int = 5, key: str = "rel_path", vector: str = "vector") -> DataFrame:
    """The k rows nearest to a query, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    return vectors.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def has_embeddings(vectors: DataFrame | None) -> bool:
    return vectors is not None and not vectors.isEmpty()


def with_context(gateway: Gateway | None, vectors: DataFrame | None, off: bool = False) -> bool:
    """Whether prompts get related sources: a gateway with an embedder, embeddings built, and not switched off."""
    return not off and gateway is not None and gateway.embedder is not None and has_embeddings(vectors)


#: Rows and queries that one task scores at a time.
ROW_BLOCK, QUERY_BLOCK = 4096, 512


def all_pairs(vectors: DataFrame, queries: DataFrame, k: int | None = None, key: str = "rel_path", vector: str = "vector") -> DataFrame:
    """query, key, score of every query row against all other rows, as cosine() has it; with k, the k nearest and their rank.

    Each block of rows meets each block of queries once, so a task's memory doesn't grow with the tables.
    """
    n_rows, n_queries = (-(-d.count() // size) or 1 for d, size in ((vectors, ROW_BLOCK), (queries, QUERY_BLOCK)))
    # A null vector, or one with a null, is like an empty one.
    plain = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector).cast("array<double>"))
    vec = F.coalesce(plain, F.array().cast("array<double>")).alias("vec")
    block = lambda n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), vec, block(n_rows).alias("rb"), every(n_queries).alias("qb"))
    asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), vec, every(n_rows).alias("rb"), block(n_queries).alias("qb"))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, own = left["id"].to_numpy(), right["id"].to_numpy()
        lengths, wanted = left["vec"].str.len().to_numpy(int), right["vec"].str.len().to_numpy(int)
        width = max([1, *lengths, *wanted])

        def matrix(col: pd.Series) -> np.ndarray:
            out = np.zeros((len(col), width))
            for i, v in enumerate(col):
                out[i, : len(v)] = v
            return out

        x, q = matrix(left["vec"]), matrix(right["vec"])
        # Summed in one fixed order, so equal vectors score alike.
        norm = np.sqrt(np.einsum("id,id->i", q, q))[:, None] * np.sqrt(np.einsum("id,id->i", x, x))[None, :]
        fits = (wanted[:, None] == lengths[None, :]) & ~(norm == 0)
        score = np.divide(np.einsum("id,jd->ij", q, x), norm, out=np.zeros(norm.shape), where=fits)
        others = own[:, None] != ids[None, :]
        if k is None:
            i, j = np.nonzero(others)
        else:
            order = np.where(others, np.where(np.isnan(score), np.inf, score), -np.inf)
            picked = []
            for a, row in enumerate(order):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero((row >= least) & others[a])
                picked.append(at[np.lexsort((ids[at], -row[at]))[:k]])
            i, j = np.repeat(np.arange(len(own)), [len(p) for p in picked]), np.concatenate([*picked, np.zeros(0, int)]).astype(int)
        return pd.DataFrame({"query": own[i], key: ids[j], "score": score[i, j]})

    kind = vectors.schema[key].dataType.simpleString()
    pairs = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(scored, f"query {kind}, `{key}` {kind}, score double")
    if k is None:
        return pairs
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
