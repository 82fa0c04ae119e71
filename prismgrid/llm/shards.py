"""Word bigrams by shard: the exchange both language models stand on.

Texts are hashed in NumPy and gathered in batches of about ``words`` words. Of a batch two things are
written: for each shard that holds some of them its distinct bigrams with their training counts, and
for the batch itself its postings (which documents hold which bigram, how often) and who is in it.
Postings never travel: a shard merges the bigrams of all batches and sends values back to each batch,
in the order of the batch's own list, so a bigram that is in every document costs one entry a batch.

Bigrams go to the shard of their first word. A word whose bigrams would fill a shard (``Splits``)
has them dealt over several by the second word.
"""

from __future__ import annotations

import ctypes
import math
import pickle
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import drop_staged, release, shared_dir, staged

_U = np.uint64
#: Words that stand for the borders of a text; hashes of words are never these by more than chance.
BEGIN, END = 1, 2
WINDOW = 1 << 19
#: Bytes of text that a wave takes at least.
WAVE = 1 << 25
#: What a row of :func:`deal` holds: bigrams for a shard, a batch's postings, who is in a batch.
KEYS, POSTINGS, HEAD = 0, 1, 2
DEALT = "part int, kind int, batch long, block binary"
_DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("block", pa.binary())])
#: Texts sampled to find words whose bigrams fill a shard; only where bigrams lie depends on them.
SAMPLE = 20_000


def trim() -> None:
    """Give freed memory back to the machine; a worker process lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-cased bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), starts
    at = np.arange(starts[0], len(data))
    at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    coefficient = mix64((np.arange(at.max() + 1, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15)) | _U(1)
    value = (data[starts[0] :].astype(_U) + _U(1)) * coefficient[at]
    value[space[starts[0] :]] = 0
    return mix64(np.add.reduceat(value, starts - starts[0])) >> _U(8), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """56-bit hashes of all words (A-Z lower-cased) and how many each text has."""
    parts = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    counts, hashes = np.zeros(len(parts), np.int64), []
    at = 0
    while at < len(parts):
        size, end = len(parts[at]), at + 1
        while end < len(parts) and size + len(parts[end]) < WINDOW:
            size, end = size + len(parts[end]) + 1, end + 1
        data = np.frombuffer(b"\n".join(parts[at:end]), np.uint8)
        edges = np.cumsum([len(p) + 1 for p in parts[at:end]])
        begin = 0
        while begin < len(data):  # a text beyond the window is cut at white space
            stop = min(begin + 2 * WINDOW, len(data))
            if stop < len(data):
                space = np.flatnonzero((data[begin:] == 32) | ((data[begin:] >= 9) & (data[begin:] <= 13)))
                later = space[space >= stop - begin]
                stop = begin + int(later[0]) if len(later) else len(data)
            h, starts = _window(data[begin:stop])
            hashes.append(h)
            np.add.at(counts, at + np.searchsorted(edges, starts + begin, "right"), 1)
            begin = stop
        at = end
    return (np.concatenate(hashes) if hashes else np.empty(0, _U)), counts


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: narrowest unsigned type, bytes of equal weight together, zstd."""
    out, press = [], zstandard.ZstdCompressor(level=1)
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, _U) if top <= np.iinfo(t).max))
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        body = press.compress(planes)
        out += [struct.pack("<2sII", a.dtype.str[1:].encode(), len(a), len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """What :func:`pack` took."""
    out, at, press = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sII", data, at)
        at += 10
        dtype = np.dtype(kind.decode())
        raw = press.decompress(data[at : at + size], max_output_size=max(1, n * dtype.itemsize))
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += size
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned values, the first one kept."""
    return np.concatenate([a[:1], np.diff(a)])


def ungaps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a.astype(_U), dtype=_U)


def gather(rows: Iterable[tuple[list, list[str | None], np.ndarray]], words: int) -> Iterator[tuple]:
    """Merge ``(ids, texts, flags)`` until about ``words`` words are held; yields
    ``(ids, flags, hashes, counts)``."""
    ids, flags, hashes, counts, held = [], [], [], [], 0
    for i, texts, f in rows:
        h, n = word_hashes(texts)
        ids += i
        flags.append(f), hashes.append(h), counts.append(n)
        held += len(h)
        if held >= words:
            yield ids, np.concatenate(flags), np.concatenate(hashes), np.concatenate(counts)
            ids, flags, hashes, counts, held = [], [], [], [], 0
    if ids:
        yield ids, np.concatenate(flags), np.concatenate(hashes), np.concatenate(counts)


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, position of the text) for each word and one end per text."""
    n = len(hashes) + len(counts)
    ends = np.cumsum(counts + 1) - 1
    word = np.empty(n, _U)
    inner = np.ones(n, bool)
    inner[ends] = False
    word[inner], word[ends] = hashes, END
    before = np.empty(n, _U)
    before[1:] = word[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = BEGIN
    return before, word, np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)


@dataclass(frozen=True)
class Splits:
    """Over how many shards the bigrams of a frequent first word go; others stay in one."""

    shards: int
    words: np.ndarray  # ascending hashes
    parts: np.ndarray

    def at(self, first: np.ndarray) -> np.ndarray:
        """Position of each word in ``words``, -1 if it is not split."""
        if not len(self.words):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.words, first), len(self.words) - 1)
        return np.where(self.words[at] == first, at, -1)

    def shard(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.at(first)
        over = np.where(at >= 0, self.parts[at] if len(self.parts) else 1, 1).astype(np.uint64)
        return ((first % _U(self.shards) + mix64(second) % over) % _U(self.shards)).astype(np.int64)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shard_count(size: int, words: int, least: int = 8) -> int:
    """Shards of about ``words`` words each for ``size`` bytes of text (six a word)."""
    return max(least, math.ceil(size / 6 / words))


def wave_count(size: int, most: int) -> int:
    """Waves that documents go through in: what is exchanged takes a part of the disk at a time."""
    return min(most, max(1, size // WAVE))


def in_wave(docs: DataFrame, wave: int, waves: int) -> DataFrame:
    """A wave's documents by hash."""
    return docs if waves == 1 else docs.filter(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(waves)) == wave)


def splits(docs: DataFrame, shards: int, words: int, sample: int = SAMPLE) -> Splits:
    """Words that hold over half a shard's share of the bigrams of a sample: two a shard at most."""

    def count(batches):
        rows = ((b.column(0).to_pylist(), b.column(0).to_pylist(), np.ones(b.num_rows, bool)) for b in batches)
        for _, _, hashes, texts in gather(rows, words):
            word, n = np.unique(hashes, return_counts=True)
            word, n = np.append(word, _U(BEGIN)).view(np.int64), np.append(n, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    part = max(1, -(-docs.count() // sample))
    some = docs.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(part)) == 0).select("text")
    seen = staged(some.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample")
    total = seen.agg(F.sum("n")).first()[0] or 0
    over = F.ceil(F.col("n") * (2 * shards) / max(total, 1))
    top = seen.withColumn("over", F.least(over, F.lit(shards))).filter("over > 1").collect()
    drop_staged(seen)
    top = sorted((r["word"] & 0xFFFFFFFFFFFFFFFF, r["over"]) for r in top)
    return Splits(shards, np.array([w for w, _ in top], _U), np.array([n for _, n in top], np.int64))


def bigram_blocks(before, word, text, train: np.ndarray, split: Splits) -> tuple[list[tuple[int, bytes]], bytes]:
    """(shard, block) of one batch, shards ascending, and its postings in the order of the blocks.

    ``train`` marks the texts that are learned from.
    """
    first, u = np.unique(before, return_inverse=True)
    del before
    u = u.astype(np.int32)
    second, w = np.unique(word, return_inverse=True)
    del word
    n_texts = len(train)
    key = u.astype(np.int64)
    del u
    key *= len(second)
    key += w
    del w
    key *= n_texts
    key += text
    del text
    key.sort()
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    times = np.diff(np.append(fresh, len(key))).astype(np.int32)
    key = key[fresh]
    del fresh
    pair, doc = key // n_texts, (key % n_texts).astype(np.int32)
    del key
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
    learned = np.add.reduceat(times * train[doc], at) if len(at) else at
    postings = np.diff(np.append(at, len(pair)))
    pu, pw = pair[at] // len(second), pair[at] % len(second)
    del pair
    shard = split.shard(first[pu], second[pw])
    order = np.argsort(shard, kind="stable")
    pu, pw, learned, shard = pu[order], pw[order], learned[order], shard[order]
    out = []
    own, cuts = np.unique(shard, return_index=True)
    for s, a, b in zip(own, cuts, np.append(cuts[1:], len(shard)), strict=True):
        before_, runs = np.unique(pu[a:b], return_counts=True)
        vocabulary, wi = np.unique(pw[a:b], return_inverse=True)
        out.append((int(s), pack(gaps(first[before_]), runs, gaps(second[vocabulary]), wi, learned[a:b])))
    postings, at = postings[order], at[order]
    inside = np.arange(postings.sum()) - np.repeat(np.cumsum(postings) - postings, postings)
    inside += np.repeat(at, postings)
    doc, times = doc[inside], times[inside]
    step = np.diff(doc, prepend=0)  # documents ascend within a bigram
    heads = np.cumsum(postings) - postings
    step[heads] = doc[heads]
    return out, pack(postings, step, times)


def read_block(data: bytes):
    """(word before, how many bigrams each has, vocabulary, word of each bigram, learned)."""
    u, runs, v, wi, learned = unpack(data)
    return ungaps(u), runs, ungaps(v), wi, learned


def read_postings(data: bytes):
    """(bigram, document, times) of each posting of a batch."""
    postings, step, times = unpack(data)
    heads = np.cumsum(postings, dtype=np.int64) - postings
    total = np.cumsum(step, dtype=np.int64)
    base = total[heads] - step[heads] if len(heads) else heads
    return np.repeat(np.arange(len(postings)), postings), (total - np.repeat(base, postings)).astype(np.int32), times


def bucket_keys(buckets: int) -> np.ndarray:
    """An int for each bucket that Spark's hash puts there, so that every task gets one shard."""
    found, start = np.full(buckets, -1, np.int64), 0
    while (found < 0).any():
        k = np.arange(start, start + 8 * buckets, dtype=np.uint64)
        mask = _U(0xFFFFFFFF)
        turn = lambda x, n: ((x << _U(n)) | (x >> _U(32 - n))) & mask
        h = turn(k * _U(0xCC9E2D51) & mask, 15) * _U(0x1B873593) & mask
        h = (turn(h ^ _U(42), 13) * _U(5) + _U(0xE6546B64)) & mask ^ _U(4)
        h = (h ^ (h >> _U(16))) * _U(0x85EBCA6B) & mask
        h = (h ^ (h >> _U(13))) * _U(0xC2B2AE35) & mask
        at = (h ^ (h >> _U(16))).astype(np.uint32).view(np.int32).astype(np.int64) % buckets
        where, first = np.unique(at, return_index=True)
        new = found[where] < 0
        found[where[new]] = k[first[new]].astype(np.int64)
        start += 8 * buckets
    return found


def deal(docs: DataFrame, split: Splits, words: int, train: str | None = None, extra: tuple[str, ...] = (), wave: int = 0) -> DataFrame:
    """Rows of :data:`DEALT` for ``docs(doc_id, text, *extra)``, learned from where ``train`` is true
    (everywhere without it). A head is ``(rows of doc_id and extra, words of each, learned)``."""
    keys = bucket_keys(split.shards)
    columns = ["doc_id", *extra]
    flag = F.lit(True) if train is None else F.col(train)

    def run(batches):
        task = TaskContext.get().partitionId()

        def rows():
            for b in batches:
                ids = list(zip(*[b.column(i + 2).to_pylist() for i in range(len(columns))], strict=True))
                yield ids, b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), bool)

        for n, (ids, flags, hashes, counts) in enumerate(gather(rows(), words)):
            batch = (wave << 56) + (task << 28) + n
            blocks, postings = bigram_blocks(*with_ends(hashes, counts), flags.astype(np.int64), split)
            own = int(keys[int(mix64(np.array([batch], _U))[0] % _U(split.shards))])
            out = [(int(keys[s]), KEYS, batch, block) for s, block in blocks]
            out += [(own, POSTINGS, batch, postings), (own, HEAD, batch, pickle.dumps((ids, counts, flags)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _DEALT, strict=True)], schema=_DEALT)
            del blocks, postings, out
            trim()

    return docs.select("text", flag.alias("_learned"), *columns).mapInArrow(run, DEALT)


def staged_by(parts: Iterable[DataFrame], key: str, buckets: int, name: str, by: str | None = None) -> DataFrame:
    """Write ``parts`` one after the other to one table in the shared folder, bucketed by ``key``: grouping
    or joining by it later needs no shuffle of the blocks. Rows of different ``by`` go to different files."""
    table = f"{name}_{uuid.uuid4().hex}"
    for df in parts:
        spark = df.sparkSession
        out = df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{table}")
        (out.partitionBy(by) if by else out).saveAsTable(table, format="parquet", mode="append")
        del out, df
        release(spark)
    return spark.table(table)


def drop_table(df: DataFrame) -> None:
    """Remove a table written by :func:`staged_by` with its files."""
    spark = df.sparkSession
    names = {r for r in df.inputFiles()}
    for root in {f.rpartition("/")[0].rpartition("/kind=")[0] or f.rpartition("/")[0] for f in names}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        spark.sql(f"drop table if exists `{root.rpartition('/')[2]}`")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Merged:
    """The distinct bigrams of a shard over all batches, by word before and word."""

    def __init__(self, blocks: list[bytes]):
        parts = [read_block(b) for b in blocks]
        self.first, u_at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        self.second, v_at = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        lengths = [len(p[3]) for p in parts]
        keys, at, nu, nv = np.empty(sum(lengths), np.int64), 0, 0, 0
        for p, n in zip(parts, lengths, strict=True):
            u = np.repeat(u_at[nu : nu + len(p[0])], p[1])
            keys[at : at + n] = u * len(self.second) + v_at[nv : nv + len(p[2])][p[3]]
            nu, nv, at = nu + len(p[0]), nv + len(p[2]), at + n
        learned = np.concatenate([p[4] for p in parts])
        del parts
        pair, where = np.unique(keys, return_inverse=True)
        del keys
        where = where.astype(np.int32)
        self.count = np.bincount(where, learned, len(pair)).astype(np.int64)
        self.u, self.w = (pair // len(self.second)).astype(np.int32), (pair % len(self.second)).astype(np.int32)
        self.where = np.split(where, np.cumsum(lengths)[:-1])

    def by_first(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.u, values, len(self.first)).astype(np.int64)

    def by_second(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, values, len(self.second)).astype(np.int64)


def targets(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard that keeps what is known of a word as such."""
    return (mix64(words) % _U(shards)).astype(np.int64)


def by_target(words: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions of ascending ``words`` by target, and the same cut into ``(target, positions)``."""
    target = targets(words, shards)
    order = np.argsort(target, kind="stable")
    own, cuts = np.unique(target[order], return_index=True)
    return order, [(int(t), p) for t, p in zip(own, np.split(order, cuts[1:]), strict=True)] if len(own) else []
