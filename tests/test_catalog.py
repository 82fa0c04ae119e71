"""Every registered raster query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from prismgrid import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Run by the driver at a larger size; too slow here for what they add.
SLOW = {"c12_finish_rendition", "c12_finish_reference", "c23_preset_vivid", "c23_preset_detail", "c23_preset_natural", "c07_pyramid_fusion", "c03_merge_rows", "w10_laplacian_collapse", "a22_rendition_report"}
#: Reports are held to their quality floors in test_quality.
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET memory_limit='3GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return columns, sorted((tuple(clean(v) for v in r) for r in frame[columns].itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize(("name", "count"), [("a13_weighted_merge", 301), ("c07_pyramid_fusion", 303)])
def test_bursts_whose_rows_do_not_divide(spark, tmp_path, name, count):
    spark.read.parquet(f"{SF}/embeddings.parquet").filter(f"vec_id < {count}").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(catalog.ORACLE_SQL[name]).df())
