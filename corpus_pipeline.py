"""A training-data pipeline over ``documents``: five operators, each on all its predecessor kept.

Quality by Kneser-Ney perplexity drops rejected documents; one document of each group of
near-duplicates is kept (SimHash of five-word shingles within 3 bits, and all pairs whose shingle sets have a
Jaccard similarity of 0.8 or more); personal data is masked; sources are mixed to their target weights by
repeating or leaving out documents; byte-level BPE encodes what is left.

Each stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``docs``, the last one adds
token ids. Empty input gives empty output; null texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.llm import bpe, mixing, near_text, pii, quality_kn
from prismgrid.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is below their language's threshold."""
    return quality_kn.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash or by a similarity of 0.8 or more of five-word shingles."""
    return near_text.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding gives the text back."""
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, *args), *args)
    same = F.coalesce(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(False))
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("byte-level bpe", encode),
]

#: SQL has neither the sampled rounding nor the tokenizer nor the EM; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
