"""Nearest neighbours by multiprobe p-stable hashing.

A table's hash of a vector is the cell floor((a.x + b) / w) in each of m random Gaussian directions. A query
visits its own cell and those around it, by the squared distance to the cells' borders, which is the order of
their estimated success. Candidates of all tables are merged and ranked by their exact inner product. The largest
inner product is the least distance once each vector has one more component that brings all to the same norm; a
query's own norm doesn't change its order.

How far a query probes is fitted: for some queries of a bounded sample the k nearest of all rows are found, and the
distance is taken that reaches `recall` of them. Every row is indexed. A query that meets k rows or fewer in its
cells, though there are more, is sent to all of them.

Rows are dealt by their id over blocks, which each hold their rows' cells in all tables and see every query; a cell's
rows are scored at once for all queries that visit it. A row that scores below the k + 1 best of a quarter of
the rows or of a bounded sample of them can't be among k results and is dropped at once. Rows of equal vectors (by two
64-bit hashes) are searched for and indexed as one, that of the smallest id; its k + 1 smallest ids stand for it in results.

Defined cases: null, empty or zero vectors, those with null or non-finite components, those of another length
than most have, and rows with a null id take no part; of several rows with one id the least vector stands for all; ties
go to the smaller id; with fewer candidates than k all are returned; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_partitions, small_batches


@dataclass(frozen=True)
class Params:
    k: int = 20
    tables: int = 4
    directions: int = 10
    width: float = 3.0
    sample: int = 16_384
    sample_queries: int = 96
    recall: float = 0.96
    seed: int = 7
    #: Rows of a cell that are scored at once.
    cell_rows: int = 4096
    #: Rows of a block beyond which there are more blocks.
    block_rows: int = 131_072


class Tables:
    """Hash tables over unit vectors of dim + 1 components."""

    def __init__(self, dim: int, params: Params):
        rng = np.random.default_rng(params.seed)
        self.p = params
        self.a = rng.standard_normal((params.tables, dim + 1, params.directions))
        self.b = rng.uniform(0, params.width, (params.tables, params.directions))

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.p.width


def border_distance(place: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Squared distance, in one direction, from a place to a cell's nearer border, 0 inside; sums of them are exact in single precision."""
    apart = np.maximum(np.maximum(cell - place, place - cell - 1), 0.0)
    return np.round(apart * apart * 4096) / 4096


def unit(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows brought to norm 1 by one more component."""
    y = x / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))
    return np.hstack([y, rest[:, None]])


def unit_query(x: np.ndarray) -> np.ndarray:
    y = x / np.sqrt((x * x).sum(1))[:, None]
    return np.hstack([y, np.zeros((len(x), 1))])


def matrix(vec: pd.Series) -> np.ndarray:
    return np.stack(vec.to_numpy()).astype(np.float64)


def fit_reach(indexed: DataFrame, asked: np.ndarray, tables: Tables, norm: float) -> float | None:
    """The distance within which `recall` of the k nearest rows of the queries asked are met; None: there are too few rows."""
    k = tables.p.k

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, best = np.zeros((0, asked.shape[1])), np.zeros((len(asked), 0))
        at = np.zeros((len(asked), 0), int)
        for pdf in batches:
            x = matrix(pdf["vec"])
            best = np.hstack([best, asked @ x.T])
            at = np.hstack([at, np.broadcast_to(np.arange(len(held), len(held) + len(x)), (len(asked), len(x)))])
            held = np.vstack([held, x])
            if best.shape[1] > k + 1:
                top = np.argpartition(-best, k, axis=1)[:, : k + 1]
                best, at = np.take_along_axis(best, top, 1), np.take_along_axis(at, top, 1)
            used, at = np.unique(at, return_inverse=True)
            held, at = held[used], at.reshape(best.shape)
        for i in range(len(asked) if best.shape[1] else 0):
            yield pd.DataFrame({"q": i, "score": best[i], "vec": list(held[at[i]])})

    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "vec")
    got = indexed.select("vec").mapInPandas(near, "q int, score double, vec array<double>")
    got = got.withColumn("r", F.row_number().over(nearest)).filter(F.col("r").between(2, k + 1)).select("q", "vec").toPandas()  # the first is the query itself
    if not len(got):
        return None
    u, q = unit(matrix(got["vec"]), norm), unit_query(asked)[got["q"].to_numpy()]
    seen = np.full(len(got), np.inf)
    for t in range(tables.p.tables):
        seen = np.minimum(seen, border_distance(tables.places(q, t), np.floor(tables.places(u, t))).sum(1))
    return float(np.sort(seen)[int(np.ceil(tables.p.recall * len(seen))) - 1])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows that take part, as (id, vec array<double>), one per id, written to shared storage; and their length."""
    v = F.col("vec")
    fine = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull()
        & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    lengths = fine.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dim = lengths["d"] if lengths else 0
    # -0.0 and 0.0 are equal components.
    plain = F.transform("vec", lambda x: x + F.lit(0.0))
    return materialise(fine.filter(F.size("vec") == dim).select("id", plain.alias("vec")).groupBy("id").agg(F.min("vec").alias("vec")), "vectors"), dim


def search(rows: DataFrame, is_query: Column, params: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of every row where is_query (of the column `id`) holds."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    small_batches(spark)
    vectors, dim = usable(rows, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    same = ["h1", "h2"]
    hashed = vectors.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(params.seed), "vec").alias("h2"))
    copies = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    held = hashed.withColumn("copy", copies).filter(F.col("copy") <= params.k + 1)
    held = materialise(held.select("id", *same, "copy", F.when(F.col("copy") == 1, F.col("vec")).alias("vec")), "indexed")
    indexed = held.filter("copy = 1").select("id", "vec")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    facts = held.agg(F.max(squares).alias("top"), F.count("vec").alias("n"), F.count(F.lit(1)).alias("all")).first()
    norm, n = float(np.sqrt(facts["top"])) * (1 + 1e-12), facts["n"]
    queries = hashed.filter(is_query).select(F.col("id").alias("query_id"), *same)
    asking = held.filter("copy = 1").join(queries.select(*same).distinct(), same, "left_semi").select("id", "vec")
    drawn = matrix(indexed.orderBy(F.xxhash64("id"), "id").limit(params.sample).select("vec").toPandas()["vec"])
    tables = Tables(dim, params)
    picked = drawn[np.linspace(0, len(drawn) - 1, min(len(drawn), params.sample_queries)).astype(int)]
    reach = fit_reach(indexed, picked, tables, norm)
    # Single precision errs by less than this in products of vectors of norm 1 at most.
    slack = 1e-7 * (dim + 16)
    few = (drawn[: n // 4] / norm).astype(np.float32)
    del drawn, picked
    # Single precision holds what came in it.
    wire = "float" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-n // params.block_rows))

    def ranked(asking: DataFrame, reach: float | None) -> DataFrame:
        """The k + 1 nearest of each row of asking, itself included, among the cells within reach; None: among all rows."""

        def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """With the score below which no row can be among the results, of unit query and rows over the largest norm."""
            for pdf in batches:
                low = np.full(len(pdf), -np.inf)
                if len(few) > params.k:
                    q = unit_query(matrix(pdf["vec"]))[:, :-1].astype(np.float32)
                    for at in range(0, len(q), 256):
                        low[at : at + 256] = np.partition(q[at : at + 256] @ few.T, len(few) - params.k - 1, axis=1)[:, len(few) - params.k - 1]
                yield pdf.assign(low=low - 2 * slack)

        vec = F.col("vec").cast(f"array<{wire}>").alias("vec")
        own = indexed.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "id", vec, F.lit(0.0).alias("low"))
        asked = asking.mapInPandas(least, f"id {kind}, vec array<double>, low double")
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "id", vec, "low")
        met = own.unionByName(asked).repartition(n_partitions(spark), "block").sortWithinPartitions("block", "role")

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, parts, block = None, [], None
            for pdf in batches:
                for key, part in pdf.groupby("block", sort=False):
                    if key != now:
                        now, parts, block = key, [], None
                    mine = part[part["role"] == 0]
                    if len(mine):
                        parts.append((mine["id"].to_numpy(), np.stack(mine["vec"].to_numpy())))
                    ask = part[part["role"] == 1]
                    if len(ask) and (parts or block):
                        block = block or Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), tables, norm, reach)
                        parts = []
                        for at in range(0, len(ask), 4096):
                            yield block.nearest(ask.iloc[at : at + 4096], slack)

        best = met.mapInPandas(rank, f"a {kind}, b {kind}, score double")
        order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= params.k + 1).select("a", "b", "score")

    found = materialise(ranked(asking, reach), "nearest")
    if reach is not None:
        # Queries that met too few rows in their cells look at all rows.
        full = found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(params.k + 1, n)).select(F.col("a").alias("id"))
        short = materialise(asking.join(full, "id", "left_anti"), "short")
        if not short.isEmpty():
            found = found.join(short.select(F.col("id").alias("a")), "a", "left_anti").unionByName(ranked(short, None))
    firsts = held.filter("copy = 1").select(*same, F.col("id").alias("first"))
    if facts["all"] > n:
        members = held.select(*same, F.col("id").alias("b_id")).join(firsts, same).select(F.col("first").alias("b"), "b_id")
        order = Window.partitionBy("a").orderBy(F.desc("score"), "b_id")
        found = found.join(members, "b").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= params.k + 1).select("a", F.col("b_id").alias("b"), "score")
    lists = found.groupBy("a").agg(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("b").alias("vec_id"))).alias("near"))  # k + 1 at most
    own = queries.join(firsts, same).select("query_id", F.col("first").alias("a")).join(lists, "a")
    near = F.slice(F.array_sort(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))), 1, params.k)
    return own.select("query_id", F.posexplode(near).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.down")).alias("score"))


class Block:
    """Some rows, in each table in the order of their cells; no reach: all rows are one cell of one table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tables: Tables, norm: float, reach: float | None):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x, self.norm, self.reach, self.tables = ids[by], x[by], norm, reach, tables
        x = self.x.astype(np.float64)
        small = (x / norm).astype(np.float32)
        if reach is None:
            self.sides = [(np.arange(len(x)), small, np.array([0, len(x)]), None)]
            return
        self.sides = []
        u = unit(x, norm)
        for t in range(tables.p.tables):
            cell = np.floor(tables.places(u, t)).astype(np.int32)
            order = np.lexsort(cell.T)
            cell = cell[order]
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
            self.sides.append((order, small[order], np.r_[first, len(x)], cell[first]))

    def visits(self, q: np.ndarray, table: int, cells: np.ndarray) -> np.ndarray:
        """Whether each cell lies within reach of each query."""
        place = self.tables.places(q, table)
        total = np.zeros((len(cells), len(q)), np.float32)
        parts, hot = [], []
        for i in range(place.shape[1]):
            values, which = np.unique(cells[:, i], return_inverse=True)
            parts.append(border_distance(place[:, i], values[:, None]).astype(np.float32))
            hot.append((which[:, None] == np.arange(len(values))).astype(np.float32))
        np.matmul(np.hstack(hot), np.vstack(parts), out=total)
        return total <= self.reach

    def nearest(self, ask: pd.DataFrame, slack: float) -> pd.DataFrame:
        """The k + 1 nearest of each query among the cells it visits, ties to the smaller id."""
        p = self.tables.p
        q, low = matrix(ask["vec"]), ask["low"].to_numpy().copy()
        long = unit_query(q)
        short = np.ascontiguousarray(long[:, :-1], np.float32)
        size = np.sqrt((q * q).sum(1)) * self.norm
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
        n_kept = 0
        bound = 2_000_000
        for t, (order, rows, bounds, cells) in enumerate(self.sides):
            wants = None if cells is None else self.visits(long, t, cells)
            for c in range(len(bounds) - 1):
                sel = np.arange(len(q)) if wants is None else np.flatnonzero(wants[c])
                if not len(sel):
                    continue
                asks, least = short[sel], low[sel, None].astype(np.float32)
                for a in range(bounds[c], bounds[c + 1], p.cell_rows):
                    b = min(a + p.cell_rows, bounds[c + 1])
                    i, j = np.divmod(np.flatnonzero(asks @ rows[a:b].T >= least), b - a)
                    kept.append((sel[i], order[a + j]))
                    n_kept += len(i)
                    if n_kept > bound:
                        i, j, score, place = self.trim(q, kept)
                        last = place == p.k
                        low[i[last]] = np.maximum(low[i[last]], score[last] / size[i[last]] - 2 * slack)
                        kept, n_kept = [(i, j)], len(i)
                        bound = max(bound, 2 * n_kept)
        i, j, score, _ = self.trim(q, kept)
        return pd.DataFrame({"a": ask["id"].to_numpy()[i], "b": self.ids[j], "score": score})

    def trim(self, q: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k + 1 best pairs of each query; the score is summed in one fixed order, so equal vectors score alike."""
        pairs = np.unique(np.concatenate([i for i, _ in kept]) * len(self.ids) + np.concatenate([j for _, j in kept]))
        i, j = np.divmod(pairs, len(self.ids))
        score = np.concatenate([(q[i[s : s + 65_536]] * self.x[j[s : s + 65_536]]).sum(1) for s in range(0, len(i), 65_536)] or [np.zeros(0)])
        order = np.lexsort((self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])[: len(i)]
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        ok = place <= self.tables.p.k
        return i[ok], j[ok], score[ok], place[ok]
