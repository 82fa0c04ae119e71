"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: A-Z lower-cased, words, 3-word shingles with repeats (fewer words: the whole
sequence), XXH64 with seed 42 of each; a bit is 1 if set in over half the hashes. No words:
fingerprint zero, linked like any other.

Links, at most ``bits`` differing: the 64 bits are cut into 16 segments of 4 and mapped to their
bit counts. The Manhattan distance of two such points never exceeds the Hamming distance, so
linked fingerprints lie at Manhattan distance <= 3, and of the two halves of the grid (8
counts each) at least one is within 1. For each half a fingerprint is indexed in its own cell
and probes that cell and the cells one step above: a grid range-join. Points that meet are
verified on the exact fingerprints.

A cell with more than ``block`` fingerprints on either side is cut into blocks and all block
pairs become groups of their own; many groups share a bucket, whose number follows the data, so
no task gets an unbounded group. A bucket writes at most one row per fingerprint, to the smallest
one that its links reach; all pairs of a group are never written. Equal fingerprints are one node.

Null or empty text: fingerprint zero. Repeated doc_ids: each row gets its fingerprint, the
component is the smallest doc_id of any linked row; null doc_ids are grouped but never name a
component unless nothing else does. Other columns pass through; ``fingerprint`` and
``component_id`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismgrid.llm.common import components, small_batches, staged, words_of

SHINGLE, SEED, LINK_BITS = 3, 42, 3
#: Fingerprints of a cell that one group may hold on each side.
BLOCK = 16_384
_HALVES = 2
#: Roles of a row in a cell: indexed and probing, probing only, indexed only.
BOTH, PROBE, INDEX = 0, 1, 2
_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = words_of(text)
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), SEED)]
    elif shingle == 3:
        hashes = [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [h(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed ``long`` (the same 64 bits)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def fp(texts: pa.Array) -> pa.Array:
        each = np.array([fingerprint(x, shingle) for x in texts.to_pylist()], dtype=np.uint64)
        return pa.array(each.view(np.int64))

    return docs.withColumn(to, fp(F.col(text)))


def popcounts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 segments of each fingerprint, shape (n, 16)."""
    u = fps.view(np.uint64)
    return np.stack([_ONES[((u >> np.uint64(4 * i)) & np.uint64(15)).astype(np.int64)] for i in range(16)], axis=1)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (position of the fingerprint, cell, role) of both halves.

    A cell is the half's number and its 8 counts in base 5. Role BOTH is a fingerprint's own
    cell; role PROBE the cells one count higher, which is enough: of two points one step apart
    one is a step above the other.
    """
    counts, base = popcounts(fps), 5 ** np.arange(8, dtype=np.int64)
    at = np.arange(len(fps))
    rows, keys, roles = [], [], []
    for half in range(_HALVES):
        own = counts[:, 8 * half : 8 * half + 8]
        key = own @ base + half * 5**8
        rows.append(at), keys.append(key), roles.append(np.full(len(at), BOTH))
        for k in range(8):
            ok = own[:, k] < 4
            rows.append(at[ok]), keys.append(key[ok] + base[k]), roles.append(np.full(ok.sum(), PROBE))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (a smaller or equal position for each) after joining a[i] with b[i]."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def linked(keys: np.ndarray, fps: np.ndarray, roles: np.ndarray, bits: int, chunk: int = 1 << 20) -> np.ndarray:
    """Pairs (fingerprint, smallest one it is linked with) that span the links found in the cells.

    Probes meet the indexed fingerprints of their cell, a bounded number of pairs at a time.
    """
    every, node = np.unique(fps, return_inverse=True)
    label = np.arange(len(every))
    held = np.flatnonzero(roles != PROBE)
    held = held[np.argsort(keys[held], kind="stable")]
    asks = np.flatnonzero(roles != INDEX)
    low = np.searchsorted(keys[held], keys[asks], "left")
    high = np.searchsorted(keys[held], keys[asks], "right")
    ends = np.cumsum(high - low)
    total, done = (int(ends[-1]) if len(ends) else 0), 0
    while done < total:  # pair number p belongs to the probe whose range of numbers holds it
        numbers = np.arange(done, min(done + chunk, total))
        ask = np.searchsorted(ends, numbers, "right")
        index = held[high[ask] - (ends[ask] - numbers)]
        query = asks[ask]
        near = np.bitwise_count(fps[query] ^ fps[index]) <= bits
        label = merge_labels(label, node[query[near]], node[index[near]])
        done += chunk
    moved = np.flatnonzero(label != np.arange(len(every)))
    return np.stack([every[moved], every[label[moved]]], axis=1)


def links(distinct: DataFrame, bits: int = LINK_BITS, block: int = BLOCK, bucket_rows: int = 150_000) -> DataFrame:
    """``(src, dst)``: rows that connect all distinct fingerprints ``fp`` (long) that links connect."""
    if bits > 3:
        raise ValueError("two halves of the grid are complete for 3 bits at most")
    spark = distinct.sparkSession
    small_batches(spark, 16_384)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys, roles = cells(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(roles.astype(np.int32)), pa.array(fps[rows])], ["cell", "role", "fp"]
            )

    dealt = distinct.select("fp").mapInArrow(deal, "cell long, role int, fp long")
    total = distinct.count() * 18
    index, probe = F.sum(F.when(F.col("role") == BOTH, 1).otherwise(0)), F.count(F.lit(1))
    large = dealt.groupBy("cell").agg(
        F.ceil(index / block).cast("int").alias("n0"), F.ceil(probe / block).cast("int").alias("n1")
    )
    large = staged(large.filter("n0 > 1 or n1 > 1"), "large")
    count = large.count()
    dealt = dealt.withColumn("b", F.lit(0))
    if count:
        # A cell over the bound becomes n0 x n1 groups: each block of its index meets each block of its probes.
        joined = dealt.join(F.broadcast(large) if count <= 10_000 else large, "cell", "left")
        own = lambda n: F.pmod(F.xxhash64("fp", F.lit(7)), F.col(n)).cast("int")
        as_index = F.transform(
            F.sequence(F.lit(0), F.col("n1") - 1),
            lambda j: F.struct(F.lit(INDEX).alias("role"), (own("n0") * F.col("n1") + j).alias("b")),
        )
        as_probe = F.transform(
            F.sequence(F.lit(0), F.col("n0") - 1),
            lambda i: F.struct(F.lit(PROBE).alias("role"), (i * F.col("n1") + own("n1")).alias("b")),
        )
        plain = F.array(F.struct(F.col("role").alias("role"), F.lit(0).alias("b")))
        parts = F.when(F.col("n0").isNull(), plain).when(F.col("role") == PROBE, as_probe)
        parts = parts.otherwise(F.concat(as_index, as_probe))
        dealt = joined.select("cell", "fp", F.explode(parts).alias("p")).select("cell", "p.role", "fp", "p.b")
    buckets = max(48, -(-total // bucket_rows))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("cell", "b"), F.lit(buckets)).cast("int"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["cell"].to_numpy() * (group["b"].max() + 1) + group["b"].to_numpy()
        pairs = linked(keys, group["fp"].to_numpy().view(np.uint64), group["role"].to_numpy(), bits).view(np.int64)
        return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return dealt.groupBy("bucket").applyInPandas(verify, "src long, dst long")


def near_duplicates(docs: DataFrame, bits: int = LINK_BITS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``docs`` without text: ``doc_id, fingerprint`` (16 lower-case hex digits), ``component_id``."""
    own = staged(fingerprints(docs.select("doc_id", "text"), to="fp", shingle=shingle).select("doc_id", "fp"), "fps")
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    member = components(links(distinct, bits, block)).withColumnRenamed("node", "fp")
    member = staged(
        distinct.join(member, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")),
        "members",
    )
    first = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = staged(member.join(first, "component").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_keys() -> list[F.Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.lit(1), "text").alias("_k1"), F.xxhash64(F.lit(2), "text").alias("_k2")]


def keep_one(docs: DataFrame, member: DataFrame) -> DataFrame:
    """One row of each component of ``member(_k1, _k2, component)``: the smallest doc_id's, nulls last,
    then the smallest key's. Rows are told apart by doc_id and text."""
    keyed = docs.select("*", *text_keys())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    named = keyed.groupBy("_k1", "_k2").agg(first).join(member, ["_k1", "_k2"])
    kept = named.groupBy("component").agg(F.min(F.struct("first", "_k1", "_k2")).alias("row"))
    kept = kept.select(F.col("row.first.doc_id").alias("_id"), F.col("row._k1").alias("_1"), F.col("row._k2").alias("_2"))
    same = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_k1"] == kept["_1"]) & (keyed["_k2"] == kept["_2"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_k1", "_k2"]).drop("_k1", "_k2")


def deduplicate(docs: DataFrame, bits: int = LINK_BITS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row of each component of near-duplicates, as :func:`keep_one` picks it; same columns."""
    own = staged(fingerprints(docs, to="fp", shingle=shingle).select("fp", *text_keys()).distinct(), "fps")
    member = components(links(own.select("fp").distinct(), bits, block)).withColumnRenamed("node", "fp")
    return keep_one(docs, own.join(member, "fp", "left").select("_k1", "_k2", F.coalesce("component", "fp").alias("component")))
