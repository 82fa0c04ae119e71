"""The folder all executors share, and statistics barriers written to it.

An operator whose statistics and pixels both hang on the same long plan would run that plan twice;
a barrier writes the pixels once, cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none: a temporary folder, on a local master only, as
    executors elsewhere would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="prismgrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def barrier(df: DataFrame, name: str = "barrier") -> DataFrame:
    """``df`` as a written table."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
