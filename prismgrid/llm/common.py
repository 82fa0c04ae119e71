"""Shared plumbing of the training-data operators: tokens, shared-folder tables, components.

Nothing here depends on a local disk that only one machine sees: intermediate
tables go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of the operators define it (ASCII white space separates).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: a temporary one, on a local master only,
    as executors elsewhere would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="prismgrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost
    executors cost nothing but a re-read, and later passes do not recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a table written by :func:`staged` that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Bits of an id filter; a parameter of the plan, whatever the ids.
FILTER_BITS = 1 << 24


def may_hold(ids: DataFrame, column: str, bits: int = FILTER_BITS):
    """A condition that holds for every value in ``ids.column`` and for few others: a bitmap of hashes of fixed
    size (two megabytes), to thin a table before the exact join. With ever more ids it thins less."""
    at = lambda c: F.pmod(F.xxhash64(F.lit(31), F.col(c)), F.lit(bits))

    def mark(batches):
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[b.column(0).to_numpy(zero_copy_only=False)] = True
        yield pa.RecordBatch.from_pydict({"one": [0], "map": [zstandard.compress(np.packbits(seen).tobytes(), 1)]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(bits // 8, np.uint8)
        for m in group["map"]:
            out |= np.frombuffer(zstandard.decompress(m), np.uint8)
        return pd.DataFrame({"map": [out.tobytes()]})

    marks = ids.select(at(column).alias("at")).mapInArrow(mark, "one long, map binary")
    # A subquery of one row: as a literal the map would be spelt out in every description of every plan that the driver keeps.
    whole = staged(marks.groupBy("one").applyInPandas(merge, "map binary"), "bitmap").scalar()
    byte = F.conv(F.hex(F.substring(whole, (at(column) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.floor(byte / F.pow(F.lit(2.0), 7 - at(column) % 8)) % 2) == 1, F.lit(False))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one batch holds, of Arrow and of the Parquet reader; documents and blocks may be
    very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(max(rows, 64), 4096)))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8. Null: no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links.

    ``edges(src, dst)`` holds links between different integer nodes, in any direction,
    repeats allowed. Returns ``(node, component)`` for every node of a link, ``component``
    the smallest node reachable. Each round takes the smallest grandparent among the
    neighbours, hooks it on the node and on its parent, and shortcuts pointers, so the
    rounds grow with the logarithm of a chain's length. Minima are pre-aggregated before
    each shuffle and nothing but one count reaches the driver.
    """
    both = staged(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "links")
    label = staged(
        both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("parent")), "parents"
    )
    for _ in range(max_rounds):
        up = label.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        now = staged(label.join(up, "parent").select("node", "parent", "grand"), "grand")
        near = (
            both.join(now.select(F.col("node").alias("dst"), "grand"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("grand").alias("near"))
        )
        met = now.join(near, "node").select("node", "parent", F.least("grand", "near").alias("low"))
        met = staged(met, "met")
        hooks = met.select("node", "low").union(met.select(F.col("parent").alias("node"), "low"))
        new = staged(hooks.groupBy("node").agg(F.min("low").alias("parent")), "parents")
        moved = (
            new.join(label.select("node", F.col("parent").alias("was")), "node").filter("parent != was").limit(1).count()
        )
        for old in (label, now, met):
            drop_staged(old)
        label = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    drop_staged(both)
    return label.select("node", F.col("parent").alias("component"))

