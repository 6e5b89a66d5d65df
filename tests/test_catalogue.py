"""Every query of the catalogue with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    values = frame.where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, db, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_forest_learns_its_rows(spark):
    from pyspark.sql import functions as F

    from tessera.operators import classify

    data = spark.range(300).select((F.col("id") % 3).cast("int").alias("label"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("features"))
    out = classify.predict(classify.fit_forest(data, "features", trees=10, depth=4), data, "features")
    assert out.where("cls <> label").count() == 0
    tiers = out.select(classify.review_seconds(F.lit(0.9)).alias("a"), classify.review_seconds(F.lit(0.95)).alias("b"), classify.review_seconds(F.lit(0.5)).alias("c")).first()
    assert tuple(tiers) == (0.5, 4.0, 10.0)
