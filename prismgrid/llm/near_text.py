"""Groups of texts: SimHash links first, then all pairs of five-word shingle sets with a Jaccard similarity of 0.8.

SimHash fingerprints of five-word shingles within 3 bits link almost equal texts cheaply
(:mod:`simhash`). At a similarity of 0.8 fingerprints differ in about ten bits and more, where no index of them
is selective, so the rest of the links comes from the shingles, and none is lost. In any one order of all
shingles the prefixes (a fifth of a set, and one) of two similar sets meet; their first common shingle also
bounds what they can share by the places it has in both. The order puts shingles that many texts hold last,
which keeps common passages out of the prefixes: shingles are counted, all of them, in a table of fixed size by
their hash. Whatever the collisions there, the order is one.

Rows of a shingle that many texts hold carry a sketch of the text's whole set: a bit is the parity of the shingles
that fall on it. Two sketches differ in no more bits than the sets in shingles, so pairs whose sketches differ in more
than a similarity allows are left out for certain, where they meet, and never become rows. A large group of loose
copies thus costs a row for each prefix shingle, and one for each pair that comes near the similarity. Sketches of
some thousand words and more are half full whatever the set and leave little out; nothing is lost by that.

Candidates are verified on the whole sets, in three rounds, each only between components of those before: each text
with one other that has one of its ``FIRST`` smallest hashes in common, which connects most copies; with ``PARTNERS``
others of each of these, as in a large group of loose copies only some pairs are similar; at last all that share a
prefix shingle. A large group of copies is thus not compared pair by pair. Distinct texts are nodes; texts without words are one group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import shards as S
from prismgrid.llm.common import components, drop_staged, release, small_batches, staged, words_of
from prismgrid.llm.simhash import LINK_BITS, fingerprints, keep_one, links, text_keys

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Smallest hashes of a text that the first rounds look at, and how many partners each of them gives in the second.
FIRST, PARTNERS = 4, 8
#: Counters of shingles (a byte each, sent to every worker), and the slices they are summed in.
COUNTERS, SLICES = 1 << 24, 256
#: Bits of a sketch, and the least number of bits of the count of a shingle whose rows carry one (16 texts); in a
#: table so full that most counters are above that, ``ABOVE`` bits over the middle one.
SKETCH, MANY, ABOVE = 1024, 5, 3
#: Bytes of text in a bucket of the table of texts.
TABLE = 1 << 25


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending (fewer words: the whole sequence)."""
    words = words_of(text)
    count = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + size]), SEED) for i in range(count)], np.uint64))


def counters(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each hash bucket, as the number of bits of that count. The driver gets
    ``COUNTERS`` bytes, whatever the texts."""

    def count(batches):
        held = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            own = np.concatenate([np.empty(0, np.uint64), *map(shingles, batch.column(0).to_pylist())])
            at, times = np.unique((own % np.uint64(COUNTERS)).astype(np.int64), return_counts=True)
            held[at] += times.astype(np.uint32)
        blocks = [S.pack(x) for x in held.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(blocks)], ["slice", "block"])
        S.trim()

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(S.unpack(b)[0].astype(np.int64) for b in group["block"])
        return pd.DataFrame({"slice": [int(key[0])], "block": [np.frexp(total.astype(np.float64))[1].astype(np.uint8).tobytes()]})

    kind = "slice int, block binary"
    sums = texts.select("text").mapInArrow(count, kind).groupBy("slice").applyInPandas(add, kind).collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for r in sums:
        out[r["slice"]] = np.frombuffer(r["block"], np.uint8)
    return out.ravel()


def prefix(own: np.ndarray, held: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the order of (counter, hash)."""
    most = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    return own[np.argsort(held[(own % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")][:most]


def sketch(own: np.ndarray) -> bytes:
    """Parities of the shingles on each bit. Bits are taken by the upper half of a hash, its order by the whole."""
    at = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SKETCH
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sketches and sizes of some of the texts."""

    def __init__(self, cid: np.ndarray, n: np.ndarray, sketch: np.ndarray):
        """Rows; a text's rows may repeat it, and ``sketch`` is None in those that carry none."""
        held = np.flatnonzero(pd.notna(sketch))
        self.cid, first = np.unique(cid[held], return_index=True)
        self.n = n[held[first]].astype(np.int64)
        self.words = np.array(sketch[held[first]].tolist(), f"S{SKETCH // 8}").view(np.uint64).reshape(len(first), SKETCH // 64)

    def near(self, pairs: np.ndarray, similarity: float, chunk: int = 1 << 16) -> np.ndarray:
        """Which pairs can be similar, as far as both have a sketch."""
        out = np.ones(len(pairs), bool)
        if not len(self.cid):
            return out
        at = np.minimum(np.searchsorted(self.cid, pairs), len(self.cid) - 1)
        known = np.flatnonzero((self.cid[at] == pairs).all(axis=1))
        for part in np.split(known, range(chunk, len(known), chunk)):
            a, b = at[part].T
            apart = np.bitwise_count(self.words[a] ^ self.words[b]).sum(axis=1, dtype=np.int64)  # at most as far as the sets
            out[part] = apart * (1 + similarity) <= (1 - similarity) * (self.n[a] + self.n[b]) + 1e-6
        return out


def meetings(
    h, cid, n, at, group, partners: int | None, similarity: float = SIMILARITY, chunk: int = 1 << 20, sketches: Sketches | None = None
) -> np.ndarray:
    """Distinct pairs of ``cid`` that share ``h``, lie in different ``group`` and can be similar.

    ``partners``: how many others of a shingle each one is paired with, those before it by cid (a hash); 0: with
    the first of the shingle; None: with all. ``sketches``: of some texts.
    """
    order = np.lexsort((cid, h))
    h, cid, n, at, group = h[order], cid[order], n[order], at[order], group[order]
    first = np.searchsorted(h, h, "left")
    before = np.arange(len(h)) - first  # rows before this one in its shingle
    if partners is not None:
        before = np.minimum(before, max(partners, 1))
    ends = np.cumsum(before)
    found = [np.empty((0, 2), np.int64)]
    for done in range(0, int(ends[-1]) if len(ends) else 0, chunk):
        numbers = np.arange(done, min(done + chunk, int(ends[-1])))
        j = np.searchsorted(ends, numbers, "right")
        i = first[j] if partners == 0 else j - (ends[j] - numbers)
        most = np.minimum(n[i] - at[i], n[j] - at[j])  # shared from here on, if this is the first
        ok = most * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6
        ok &= (group[i] != group[j]) & (cid[i] != cid[j])
        pairs = np.unique(np.stack([cid[i[ok]], cid[j[ok]]], axis=1), axis=0)
        found.append(pairs[sketches.near(pairs, similarity)] if sketches else pairs)
    return np.unique(np.concatenate(found), axis=0)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Candidates that are similar. ``texts`` is bucketed by cid: one text a pair travels."""
    left, right = (texts.select(F.col("cid").alias(c), F.col("text").alias(f"t_{c}")) for c in ("a", "b"))
    both = pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "t_a", "t_b")

    def check(batches):
        last, x = None, None
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = []
            for k in range(batch.num_rows):
                if (now := b[k].as_py()) != last:
                    last, x = now, shingles(tb[k].as_py())
                y = shingles(ta[k].as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["src", "dst"])

    return both.mapInArrow(check, "src long, dst long")


def _fingerprint_links(texts: DataFrame, bits: int) -> DataFrame:
    """Links that connect all texts whose fingerprints SimHash connects: to one text of each fingerprint,
    and between these."""
    own = staged(fingerprints(texts, to="fp", shingle=SHINGLE).select("cid", "fp"), "fps")
    first = staged(own.groupBy("fp").agg(F.min("cid").alias("first")), "distinct")
    found = staged(links(first, bits), "fp-links")
    small_batches(texts.sparkSession)
    near = found.join(first.withColumnRenamed("first", "a"), found["src"] == F.col("fp")).drop("fp")
    near = near.join(first.withColumnRenamed("first", "b"), near["dst"] == F.col("fp")).select("a", "b")
    same = own.join(first, "fp").filter("cid <> first").select("cid", "first")
    out = staged(same.union(near).toDF("src", "dst"), "simhash-links")
    for old in (own, first, found):
        drop_staged(old)
    return out


def groups(docs: DataFrame, similarity: float = SIMILARITY, bits: int = LINK_BITS, bucket_rows: int = 1_000_000) -> DataFrame:
    """``(_k1, _k2, component)`` of each distinct text of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(8, -(-S.text_bytes(docs) // TABLE))
    rows = docs.select(*text_keys(), "text")
    texts = rows.groupBy("_k1", "_k2").agg(F.any_value("text").alias("text")).withColumn("cid", F.col("_k1"))
    texts = S.staged_by([texts], "cid", buckets, "texts")
    linked = _fingerprint_links(texts, bits)
    held = counters(texts)
    sent, many = spark.sparkContext.broadcast(held), max(MANY, int(np.median(held)) + ABOVE)

    def deal(batches):
        for batch in batches:
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            sketches = pa.array([sketch(x) for x in sets], pa.binary())
            cids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, heads in ((True, [x[:FIRST] for x in sets]), (False, [prefix(x, sent.value, similarity) for x in sets])):
                size = np.array([len(x) for x in heads], np.int64)
                n = np.repeat(np.array([len(x) for x in sets], np.int32), size)
                at = (np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                h = np.concatenate([*heads, np.empty(0, np.uint64)])
                few = sent.value[(h % np.uint64(COUNTERS)).astype(np.int64)] < many
                columns = [h.view(np.int64), np.repeat(cids, size), n, at, np.full(len(n), first)]
                columns = [*map(pa.array, columns), sketches.take(pa.array(np.repeat(np.arange(len(sets)), size), mask=few))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "cid", "n", "at", "first", "sketch"])

    dealt = texts.select("cid", "text").mapInArrow(deal, "h long, cid long, n int, at int, first boolean, sketch binary")
    dealt = staged(dealt, "prefixes")

    def candidates(rows: DataFrame, partners: int | None) -> DataFrame:
        def meet(group: pd.DataFrame) -> pd.DataFrame:
            h, cid, n, at, grp, sketched = (group[c].to_numpy() for c in ("h", "cid", "n", "at", "grp", "sketch"))
            pairs = meetings(h, cid, n, at, grp, partners, similarity, sketches=Sketches(cid, n, sketched))
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        buckets = max(12, -(-rows.count() // bucket_rows))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
        return staged(rows.groupBy("bucket").applyInPandas(meet, "a long, b long").distinct(), "candidates")

    def similar(member: DataFrame, first: bool, partners: int | None) -> DataFrame:
        """Links between texts that are in different groups of ``member`` so far."""
        rows = dealt.filter(F.col("first") == first).join(member, "cid", "left").withColumn("grp", F.coalesce("grp", "cid"))
        pairs = candidates(rows.select("h", "cid", "n", "at", "grp", "sketch"), partners)
        if partners is None:
            drop_staged(dealt)
        release(spark)
        out = staged(_verified(pairs, texts, similarity), "found")
        drop_staged(pairs)
        release(spark)
        return out

    grouped = lambda found: staged(components(found).select(F.col("node").alias("cid"), F.col("component").alias("grp")), "groups")
    for first, partners in ((True, 0), (True, PARTNERS), (False, None)):
        member = grouped(linked)
        linked = linked.union(similar(member, first, partners))
        drop_staged(member)
    member = grouped(linked)
    named = texts.select("_k1", "_k2", "cid").join(member, "cid", "left").select("_k1", "_k2", F.coalesce("grp", "cid").alias("component"))
    named = staged(named, "named")
    drop_staged(member), S.drop_table(texts)
    release(spark)
    return named


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, bits: int = LINK_BITS) -> DataFrame:
    """One row of each group, as :func:`simhash.keep_one` picks it; same columns."""
    return keep_one(docs, groups(docs, similarity, bits))
