"""Exact pairs of embeddings above a cosine threshold by a dual traversal of cover trees.

Vectors are scaled to length one, so a cosine is a distance and metric bounds hold. Equal vectors
are one point with a weight. Points lie in pivot cells (pivots: a farthest-first net of a bounded
sample) and cells in blocks of about ``block`` points. Each block's tree is built once and kept as one
packed row: nested nets with halving radii down to the points, each node with its true covering radius.

Two nodes are compared by their centres: farther apart than both radii and the threshold they are
pruned with all below, so cells, then nodes of each level; so close that even their farthest points
link, all pairs are counted without a look. What remains goes down a level; a level at which hardly
anything is pruned is passed by one matrix product of the next. Points are verified in double precision.

Tasks take the pairs of blocks that the cells' radii leave from a product of the stored blocks with
themselves, which reads them again and writes nothing; a hot cell only makes more blocks. Blocks hold the
vectors as they were given, in their own precision. A task writes one row per point that it found linked, with
the number of links and one partner that stands for its group, never the pairs themselves; components are
those of these rows.

Null, empty, zero vectors and vectors with null or non-finite components link with nothing, and
so do vectors of different lengths, however many lengths there are. Rows that repeat a vec_id are vectors
of their own in the counts. Null vec_ids take part but name a component only if nothing else does. Extra
columns are ignored. In high dimensions with no structure no bound prunes and the cost is that of comparing
all centres; the bounds never cost a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import shards as S
from prismgrid.llm.common import components, drop_staged, release, small_batches, staged
from prismgrid.llm.simhash import merge_labels

THRESHOLD = 0.9
BLOCK, SAMPLE, PIVOTS = 4096, 4096, 256
#: Radii of the levels below the pivots, halving.
RADII = (1.0, 0.5, 0.25, 0.125)
#: A level is kept if the next one kept has so many times its nodes; others hardly divide any.
DIVIDED = 1.5
#: Share of pairs left above which a level is passed.
DENSE = 0.1
_EDGE = 1e-6  # what single precision may be off when centres are compared


def usable(vector) -> F.Column:
    """Whether a vector has a direction."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) > 0) & fine & some, F.lit(False))


def unit(rows) -> np.ndarray:
    """Rows of double precision scaled to length one (huge and tiny ones safely)."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Positions of a net: each next one is the point farthest from those before."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]))
        nxt = int(far.argmax())
        if far[nxt] <= 1e-12:
            break
        chosen.append(nxt)
    return np.array(chosen)


class Net:
    """A level of a block's tree: nodes with centre, covering radius and members (of the level below)."""

    def __init__(self, centre, radius, member):
        self.centre, self.radius = centre, radius
        self.order = np.argsort(member, kind="stable")  # members by node
        self.start = np.searchsorted(member[self.order], np.arange(len(centre) + 1))

    def below(self, node):
        return self.order[self.start[node] : self.start[node + 1]]


def owners(x: np.ndarray, radii=RADII) -> list[np.ndarray]:
    """The centre of each point on nested nets of halving radii, coarse to fine. A node's first member is
    its centre, and stays one on finer levels."""
    near = np.asarray(x, np.float32)
    out, above = [], np.zeros(len(x), np.int64)
    for radius in radii:
        least, owner = 1 - radius * radius / 2, np.full(len(x), -1)
        for node in np.split(np.argsort(above, kind="stable"), np.flatnonzero(np.diff(np.sort(above))) + 1):
            left = np.sort(node)
            while len(left):  # the first point left is the next centre
                inside = near[left] @ near[left[0]] >= least
                inside[0] = True
                owner[left[inside]] = left[0]
                left = left[~inside]
        out.append(owner)
        above = owner
    return out


def nets(x: np.ndarray, owned: list[np.ndarray] | None = None) -> list[Net]:
    """Nested levels of a block, coarse to fine; the finest has points as members. Levels that hardly divide a node
    are left out, as an explicit cover tree leaves out nodes that are their own only child: their centres would be
    compared again for nothing."""
    kept: list[np.ndarray] = []
    for owner in reversed(owners(x) if owned is None else owned):
        if not kept or len(np.unique(kept[0])) >= DIVIDED * len(np.unique(owner)):
            kept.insert(0, owner)
    owned, levels = kept, []
    for k, owner in enumerate(owned):
        heads = np.unique(owner)
        node = np.searchsorted(heads, owner)
        apart = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, x[heads[node]]), 0))
        radius = np.zeros(len(heads))
        np.maximum.at(radius, node, apart + 1e-12)
        finer = np.unique(owned[k + 1]) if k + 1 < len(owned) else np.arange(len(x))
        levels.append(Net(x[heads], radius, node[finer]))
    return levels


def aligned(left: list[Net], right: list[Net]) -> tuple[list[Net], list[Net]]:
    """Both with as many levels: the coarsest nodes of the shorter one wait, as their own only members."""
    wait = lambda nets, levels: [Net(nets[0].centre, nets[0].radius, np.arange(len(nets[0].centre)))] * (levels - len(nets)) + nets
    return wait(left, len(right)), wait(right, len(left))


def _products(a: Net, b: Net, pairs: np.ndarray, most: int):
    """Member pairs of node pairs, at most about ``most`` at a time (a large pair comes alone), and
    whether the two nodes have the same number."""
    na, nb = np.diff(a.start)[pairs[:, 0]], np.diff(b.start)[pairs[:, 1]]
    sizes = np.cumsum(na * nb)
    at = 0
    while at < len(pairs):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        n, m = na[at:end], nb[at:end]
        owner = np.repeat(np.arange(at, end), n * m)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        i = a.order[a.start[pairs[owner, 0]] + inner // nb[owner]]
        j = b.order[b.start[pairs[owner, 1]] + inner % nb[owner]]
        yield np.stack([i, j], axis=1), pairs[owner, 0] == pairs[owner, 1]
        at = end


class Links:
    """Links found in a block pair: weights linked per point and groups."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.label = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Point i[k] with j[k]."""
        size = len(self.weight)
        self.count += np.bincount(i, self.weight[j], size).astype(np.int64) + np.bincount(j, self.weight[i], size).astype(np.int64)
        self.label = merge_labels(self.label, i, j)

    def add_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Every point of ``i`` with every other of ``j``."""
        self.count[i] += self.weight[j].sum()
        self.count[j] += self.weight[i].sum()
        both = np.concatenate([i, j])
        self.label = merge_labels(self.label, np.full(len(both), both.min()), both)

    def compare(self, x, z, i: np.ndarray, j: np.ndarray, shift: int, cosine: float, once: bool) -> None:
        """Points ``i`` of x with ``j`` of z by matrix products; ``once``: only with i before j."""
        for at in range(0, len(i), 512):
            own = i[at : at + 512]
            hit = x[own] @ z[j].T >= cosine
            if once:
                hit &= own[:, None] < j[None, :]
            u, v = np.nonzero(hit)
            if len(u):
                self.add(own[u], j[v] + shift)


def _near_nodes(a: Net, b: Net, reach: float, once: bool, most: float) -> np.ndarray | None:
    """Pairs of nodes that the bounds leave, or None if these are more than the share ``most`` of all."""
    ca, cb = a.centre.astype(np.float32), b.centre.astype(np.float32)
    found, count = [], 0
    for at in range(0, len(ca), 512):
        limit = np.minimum(a.radius[at : at + 512, None] + b.radius[None, :] + reach, 2)
        p = np.argwhere(ca[at : at + 512] @ cb.T >= 1 - limit**2 / 2 - _EDGE)
        p[:, 0] += at
        found.append(p[p[:, 0] <= p[:, 1]] if once else p)
        count += len(found[-1])
        if count > most * len(ca) * len(cb) + 100_000:
            return None
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def traverse(
    x: np.ndarray, y: np.ndarray | None, weight: np.ndarray, cosine: float, left: list[Net] | None = None, right: list[Net] | None = None, most: int = 60_000
) -> Links:
    """Links between the points of two blocks, or within one if ``y`` is None."""
    same = y is None
    reach = math.sqrt(2 - 2 * cosine)
    left = left or nets(x)
    right, shift = (left, 0) if same else (right or nets(y), len(x))
    left, right = aligned(left, right)
    found, points, z = Links(weight), x, x if same else y
    # Within one block only a node's pairs with itself come in both orders; members of two nodes
    # come once, in either order, as numbers are not those of the nodes.
    pairs = None
    for level in range(len(left)):
        if pairs is None:
            pairs = _near_nodes(left[level], right[level], reach, same, DENSE)
            continue
        finer = []
        for p, twice in _products(left[level - 1], right[level - 1], pairs, most):
            p = p[~twice | (p[:, 0] <= p[:, 1])] if same else p
            a, b = left[level].centre[p[:, 0]], right[level].centre[p[:, 1]]
            limit = np.minimum(left[level].radius[p[:, 0]] + right[level].radius[p[:, 1]] + reach, 2)
            finer.append(p[np.einsum("ij,ij->i", a, b) >= 1 - limit**2 / 2 - _EDGE])
        pairs = np.unique(np.concatenate(finer), axis=0) if finer else np.empty((0, 2), np.int64)
    if pairs is None:  # nothing was pruned: all points
        found.compare(points, z, np.arange(len(points)), np.arange(len(z)), shift, cosine, same)
        return found
    a, b = left[-1], right[-1]
    size = np.diff(a.start)[pairs[:, 0]] * np.diff(b.start)[pairs[:, 1]]
    # Small node pairs: their points together.
    for p, twice in _products(a, b, pairs[size <= 4096], most):
        p = p[~twice | (p[:, 0] < p[:, 1])] if same else p
        p = p[np.einsum("ij,ij->i", points[p[:, 0]], z[p[:, 1]]) >= cosine]
        if len(p):
            found.add(p[:, 0], p[:, 1] + shift)
    # Large ones: the centres may settle all pairs at once, or a matrix product does.
    for m, n in pairs[size > 4096]:
        i, j = a.below(m), b.below(n)
        far = math.sqrt(max(2 - 2 * float(a.centre[m] @ b.centre[n]), 0)) + a.radius[m] + b.radius[n]
        if far < reach - _EDGE and not (same and m == n):
            found.add_all(i, j + shift)
        else:
            found.compare(points, z, i, j, shift, cosine, same and m == n)
    return found


def _pivots(points: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Pivots of each length that has more than a block of points; others are one cell."""
    many = points.groupBy("size").count().filter(F.col("count") > block).collect()  # a block of points for each
    out = {}
    for size, n in sorted((r["size"], r["count"]) for r in many):
        part = max(1, -(-n * len(many) // SAMPLE))
        some = points.filter((F.col("size") == size) & (F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(part)) == 0))
        x = unit(some.orderBy("cid").limit(2 * SAMPLE).select("embedding").toPandas()["embedding"].tolist())
        out[size] = x[farthest_first(x, min(PIVOTS, max(1, n // block)))]
    return out


def near_cells(pivots: dict[int, np.ndarray], cells: dict[tuple, tuple], cosine: float, block: int) -> list[tuple]:
    """``(size, cell, its blocks, [(cell, its blocks), ...])``: cells whose covering radii leave a pair, at most
    PIVOTS squared for each length. ``cells`` has rows and covering radius by (size, cell)."""
    reach = math.sqrt(2 - 2 * cosine)
    parts = {k: max(1, math.ceil(n / block)) for k, (n, _) in cells.items()}
    plan = []
    for (size, a), (_, radius) in sorted(cells.items()):
        apart = np.sqrt(np.maximum(2 - 2 * pivots[size] @ pivots[size][a], 0))
        near = [
            (b, parts[size, b])
            for b in range(len(apart))
            if (size, b) in cells and apart[b] <= radius + cells[size, b][1] + 2e-9 + reach + _EDGE
        ]
        plan.append((size, a, parts[size, a], near))
    return plan


def _linked(points: DataFrame, cosine: float, block: int) -> DataFrame:
    """``(cid, partner, links)`` from ``points(cid, embedding, weight, size)``, a staged table that is deleted."""
    spark = points.sparkSession
    pivots = _pivots(points, block)
    kind = points.schema["embedding"].dataType.simpleString()
    raw = np.float32 if kind == "array<float>" else np.float64

    def place(batches):
        for b in batches:
            size = b.column(3).to_numpy(zero_copy_only=False)
            pivot, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for s in np.unique(size):
                if s in pivots:
                    own = np.flatnonzero(size == s)
                    cosines = unit(b.column(1).take(pa.array(own)).to_pylist()) @ pivots[s].T
                    pivot[own] = cosines.argmax(axis=1)
                    far[own] = np.sqrt(np.maximum(2 - 2 * cosines.max(axis=1), 0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pivot), pa.array(far)], ["cid", "embedding", "weight", "size", "pivot", "far"]
            )

    schema = f"cid long, embedding {kind}, weight long, size int, pivot int, far double"
    placed = staged(points.select("cid", "embedding", "weight", "size").mapInArrow(place, schema), "placed")
    drop_staged(points)
    cells = placed.groupBy("size", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    split = {(r["size"], r["pivot"]): r for r in cells.filter(F.col("size").isin(list(pivots))).collect()}
    plan = near_cells(pivots, {k: (r["n"], r["radius"]) for k, r in split.items()}, cosine, block)
    plan = F.broadcast(spark.createDataFrame(plan, "size int, pivot int, own int, near array<struct<pivot:int,parts:int>>"))
    part = F.pmod(F.xxhash64(F.lit(9), "cid"), F.coalesce("own", F.lit(1))).cast("int")
    dealt = placed.join(plan.select("size", "pivot", "own"), ["size", "pivot"], "left").withColumn("part", part)

    def build(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        own = np.array(group["embedding"].tolist(), raw)
        blob = S.pack(group["cid"].to_numpy(np.uint64), group["weight"].to_numpy(np.int64), own.ravel(), *owners(unit(own)))
        return pd.DataFrame([[*map(int, key), blob]], columns=["size", "pivot", "part", "tree"])

    # A length without pivots is one block; many of them share a task.
    # As many files as there are partitions: the product of the blocks has a task for each two of them.
    cut = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "size", "pivot", "part")
    trees = cut.groupBy("size", "pivot", "part").applyInPandas(build, "size int, pivot int, part int, tree binary")
    trees = staged(trees, "trees")
    drop_staged(placed)
    release(spark)
    small_batches(spark, 4)  # rows are two blocks of a megabyte from here on
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "16")
    # A length without pivots is one block and meets itself alone.
    single = trees.filter(~F.col("size").isin(list(pivots))).select("tree", F.lit(None).cast("binary").alias("other"))
    left, right = trees.join(plan.select("size", "pivot", "near"), ["size", "pivot"]).alias("a"), trees.alias("b")
    a, b = F.struct("a.pivot", "a.part"), F.struct("b.pivot", "b.part")
    met = (F.col("a.size") == F.col("b.size")) & (a <= b) & F.exists("a.near", lambda n: n["pivot"] == F.col("b.pivot"))
    pairs = left.join(right.hint("shuffle_replicate_nl"), met)
    pairs = pairs.select("a.tree", F.when(a != b, F.col("b.tree")).alias("other"))

    def opened(blob: bytes):
        cid, weight, own, *owned = S.unpack(blob)
        x = unit(own.reshape(len(cid), -1))
        return cid.astype(np.int64), weight.astype(np.int64), x, nets(x, [o.astype(np.int64) for o in owned])

    def meet(batches):
        last, held = None, None  # pairs of one block come one after the other
        for batch in batches:
            for tree, other in zip(batch["tree"], batch["other"], strict=True):
                if tree != last:
                    last, held = tree, opened(tree)
                if other is None:
                    cid, weight, x, levels = held
                    found = traverse(x, None, weight, cosine, levels)
                else:
                    (cid, weight, x, levels), more = held, opened(other)
                    cid, weight = np.concatenate([cid, more[0]]), np.concatenate([weight, more[1]])
                    found = traverse(x, more[2], weight, cosine, levels, more[3])
                hit = np.flatnonzero(found.count)
                S.trim()
                yield pd.DataFrame({"cid": cid[hit], "partner": cid[found.label[hit]], "links": found.count[hit]})

    return pairs.unionByName(single).mapInPandas(meet, "cid long, partner long, links long")


def near_pairs(vectors: DataFrame, cosine: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``."""
    small_batches(vectors.sparkSession, 2048)
    # Vectors are kept as they are given, in single precision or double; what is compared is double.
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    key = [F.xxhash64(F.lit(1), "embedding").alias("k1"), F.xxhash64(F.lit(2), "embedding").alias("k2")]
    rows = rows.withColumn("ok", usable(F.col("embedding"))).select("*", *key)
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    points = rows.filter("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding")
    )
    points = points.withColumn("size", F.size("embedding"))
    points = staged(points.withColumn("cid", F.monotonically_increasing_id()), "points")
    light = staged(points.select("k1", "k2", "cid", "first_id", "weight"), "light")
    rows = staged(rows.filter("ok").select("vec_id", "k1", "k2"), "vectors")
    release(vectors.sparkSession)
    found = staged(_linked(points, cosine, block), "found")
    small_batches(vectors.sparkSession, 4096)
    member = components(found.filter("cid <> partner").select(F.col("cid").alias("src"), F.col("partner").alias("dst")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = light.join(links, "cid", "left").join(member.withColumnRenamed("node", "cid"), "cid", "left")
    named = staged(
        named.select("k1", "k2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")),
        "named",
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(smallest, "component").select("k1", "k2", "n_links", "component_id"), "named")
    linked = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
