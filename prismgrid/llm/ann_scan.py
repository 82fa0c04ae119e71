"""Approximate largest inner products by an adaptive dimension scan of probed lists.

Vectors are centred on nothing but lengthened by one coordinate so that the largest inner product
is the smallest distance. Lists are k-means cells fitted on a bounded sample; every row is listed.
Rotated by a random orthogonal matrix, any block of coordinates is a random sample of a distance:
after each block of columns a hypothesis test abandons a candidate whose partial distance, scaled
to all dimensions, exceeds the query's bound by more than chance allows (``doubt`` standard
errors over the root of the dimensions seen). Survivors get their inner product on the original
vectors in double precision.

Each query first scans its nearest lists in full; its k-th result there is the bound for the rest.
Which lists it then probes is a test too: by the list's centre and the spread of its members the
number of candidates above the bound is estimated, and lists are probed, most promising first, until
those left hold less than ``miss`` of the k in all. A query without a bound, as it has met fewer than
k candidates, probes all lists, so every query gets k results if there are as many candidates.

Lists are dealt in blocks of at most about ``block`` candidates and queries, each packed in one row, so a hot
list only makes more blocks; blocks meet where a query of one probes the list of the other, and a meeting
returns at most k rows per query.

Rows with a null, empty or zero vector, or with null or non-finite components, take no part, nor
do vectors of another length than the most frequent one. Ties go to the smaller id; a query's own
row (equal vec_id) is never its candidate. Repeated candidates are ranked as rows of their own;
repeated queries are searched once. Null ids take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.llm import shards as S
from prismgrid.llm.common import drop_staged, small_batches, staged
from prismgrid.llm.cover_tree import usable

SAMPLE, LISTS = 20_000, 1024
#: Share of its k results that a query may expect in the lists it leaves out.
MISS = 0.02
FIRST = 3
BLOCK = 4096
COLUMNS = 16
DOUBT = 2.1


def fit_lists(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centres of k-means cells."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centres of each row, nearest first."""
    far = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def rotation(size: int, seed: int = 13) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def lengthen(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """One more coordinate: inner products with queries become distances."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
    return np.column_stack([x, more])


def scan(q: np.ndarray, y: np.ndarray, bound: np.ndarray, columns: int = COLUMNS, doubt: float = DOUBT):
    """Pairs (query, candidate) whose distance may be within ``bound`` (squared) of the query.

    ``q`` and ``y`` are rotated. Pairs are dropped after each block of columns by the test.
    """
    size = q.shape[1]
    done = min(columns, size)
    qa, ya = q[:, :done], y[:, :done]
    part = (qa * qa).sum(axis=1)[:, None] + (ya * ya).sum(axis=1)[None, :] - 2 * qa @ ya.T
    allow = lambda d: bound * (1 + doubt / math.sqrt(d)) ** 2 * d / size if d < size else bound * (1 + 1e-9)
    i, j = np.nonzero(part <= allow(done)[:, None])
    part = part[i, j]
    while done < size and len(i):
        upto = min(done + columns, size)
        out = []
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            gap = q[a, done:upto] - y[b, done:upto]
            out.append(np.einsum("ij,ij->i", gap, gap))
        part = part + np.concatenate(out)
        done = upto
        near = part <= allow(done)[i]
        i, j, part = i[near], j[near], part[near]
    return i, j


def upper_tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z (to 1e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * np.exp(-x * x)
    return np.where(z >= 0, half, 1 - half)


@dataclass(frozen=True)
class Lists:
    """What is known of the lists: rows, mean and spread (per coordinate) of their members."""

    n: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def probes(self, q: np.ndarray, bound: np.ndarray, done: np.ndarray, k: int, miss: float) -> list[np.ndarray]:
        """The lists that each query has still to probe. ``bound`` nan: all."""
        norm = np.sqrt((q * q).sum(axis=1))
        gap = np.nan_to_num(bound, nan=-np.inf)[:, None] - q @ self.centre.T
        hits = self.n[None, :] * upper_tail(gap / np.maximum(norm[:, None] * self.spread[None, :], 1e-12))
        np.put_along_axis(hits, done, -1, axis=1)
        order = np.argsort(-hits, axis=1, kind="stable")
        ranked = np.maximum(np.take_along_axis(hits, order, axis=1), 0)
        left = ranked.sum(axis=1, keepdims=True) - np.cumsum(ranked, axis=1) + ranked  # from this list on
        left_out = (left <= miss * k) & ~np.isnan(bound)[:, None]
        visited = (~left_out) & (np.take_along_axis(hits, order, axis=1) >= 0)
        return [o[v].astype(np.int32) for o, v in zip(order, visited, strict=True)]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    miss: float = MISS,
    lists: int = LISTS,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best found for each row of ``queries``.

    Both tables have ``vec_id, embedding``.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    clean = lambda df: (
        df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
            F.col("vec_id").isNotNull() & usable(F.col("embedding"))
        )
    )
    rows, empty = clean(vectors), spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("largest"))
    common = facts.orderBy(F.desc("n"), "size").limit(1).collect()
    if not common:
        return empty
    size, total, largest = common[0]
    scale = math.sqrt(largest)
    rows = rows.filter(F.size("embedding") == size)
    asks = clean(queries).filter(F.size("embedding") == size).dropDuplicates(["vec_id"])
    some = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    sample = np.array(some["embedding"].tolist(), np.float64) / scale
    centres = fit_lists(lengthen(sample, 1.0, False), min(lists, max(1, int(math.sqrt(total) / 2))))
    count = len(centres)
    first = min(FIRST, count)
    turn = rotation(size + 1)
    vectors_of = lambda column: np.array(column.to_pylist(), np.float64) / scale

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = vectors_of(b.column(1))
                own = nearest(lengthen(x, 1.0, False), centres, 1)[:, 0]
                gap = x - centres[own, :size]
                columns = [b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(np.einsum("ij,ij->i", gap, gap))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "list", "far"])

    placed = staged(rows.mapInArrow(place, "vec_id long, embedding array<double>, list int, far double"), "listed")
    held = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("far").alias("far")).collect()
    n, far = np.zeros(count), np.zeros(count)
    for r in held:  # a row per list
        n[r["list"]], far[r["list"]] = r["n"], r["far"]
    known = Lists(n, centres[:, :size], np.sqrt(far / size))
    table = spark.createDataFrame([(r["list"], max(1, math.ceil(r["n"] / block))) for r in held], "list int, parts int")
    mine = lambda over, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), over).cast("int")

    def packed(group: pd.DataFrame) -> bytes:
        group = group.sort_values("vec_id", kind="stable")
        x = np.array(group["embedding"].tolist(), np.float64)
        bound = [group["bound"].to_numpy(np.float64)] if "bound" in group else []
        return S.pack(group["vec_id"].to_numpy(np.int64).view(np.uint64), x.ravel(), *bound)

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[int(key[0]), int(key[1]), packed(group)]], columns=["list", "part", "block"])

    data = placed.join(F.broadcast(table), "list").select("vec_id", "embedding", "list", mine(F.col("parts"), 5).alias("part"))
    data = staged(data.groupBy("list", "part").applyInPandas(pack, "list int, part int, block binary"), "blocks")

    def aim(batches):
        for b in batches:
            if b.num_rows:
                to = nearest(lengthen(vectors_of(b.column(1)), 1.0, True), centres, first)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(to.astype(np.int32)))], ["vec_id", "embedding", "lists"])

    aimed = staged(asks.mapInArrow(aim, "vec_id long, embedding array<double>, lists array<int>"), "aimed")
    share = max(1, math.ceil(aimed.count() / block))  # query blocks

    def run(which: DataFrame) -> DataFrame:
        """Scan the lists of ``which(vec_id, embedding, bound, lists)``."""
        small_batches(spark, 2048)
        each = which.select("vec_id", "embedding", "bound", F.explode("lists").alias("list"), mine(F.lit(share), 6).alias("ask"))
        sent = staged(each.groupBy("list", "ask").applyInPandas(pack, "list int, part int, block binary"), "asked")
        sent = sent.withColumnRenamed("part", "ask")
        wanted = sent.select("list", "ask")
        left = data.join(wanted, "list").select("list", "part", "ask", "block", F.lit(False).alias("asks"))
        right = sent.join(F.broadcast(table), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = left.unionByName(right.select("list", "part", "ask", "block", F.lit(True).alias("asks")))
        small_batches(spark, 64)  # rows are blocks of a megabyte here
        found = staged(both.groupBy("list", "part", "ask").applyInPandas(meet, "query_id long, vec_id long, score double"), "found")
        small_batches(spark, 2048)
        drop_staged(sent)
        return found

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if len(group) < 2:
            return nothing
        group = group.sort_values("asks")
        (yid, y), (qid, q, bound) = map(S.unpack, group["block"])
        yid, qid = yid.astype(np.uint64).view(np.int64), qid.astype(np.uint64).view(np.int64)
        y, q = y.reshape(len(yid), -1), q.reshape(len(qid), -1)
        # A bound is an inner product; as a distance: |q|^2 + largest - 2 q.y.
        norm = (q * q).sum(axis=1) / scale**2
        limit = np.where(np.isnan(bound), np.inf, np.maximum(norm + 1 - 2 * bound / scale**2, 0) + 1e-9)
        turned = lengthen(y / scale, 1.0, False) @ turn
        out = []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            i, j = scan(lengthen(q[part] / scale, 1.0, True) @ turn, turned, limit[part])
            own = qid[part][i] != yid[j]
            i, j = i[own], j[own]
            score = np.einsum("ij,ij->i", q[part][i], y[j])
            order = np.lexsort((yid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            heads = np.searchsorted(i, i)
            best = np.arange(len(i)) - heads < k
            out.append(pd.DataFrame({"query_id": qid[part][i[best]], "vec_id": yid[j[best]], "score": score[best]}))
        S.trim()
        return pd.concat(out) if out else nothing

    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= k)
    near = staged(best(run(aimed.withColumn("bound", F.lit(None).cast("double")))), "first")
    bounds = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))

    def widen(batches):
        for b in batches:
            if b.num_rows:
                bound = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                to = known.probes(vectors_of(b.column(1)), bound / scale**2, np.array(b.column(2).to_pylist(), np.int64), k, miss)
                columns = [b.column(0), b.column(1), pa.array(bound, from_pandas=True), pa.array(to, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "bound", "lists"])

    later = aimed.join(bounds, "vec_id", "left").select("vec_id", "embedding", "lists", "bound")
    later = later.mapInArrow(widen, "vec_id long, embedding array<double>, bound double, lists array<int>")
    both = near.select("query_id", "vec_id", "score").union(run(later))
    return best(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
