"""Tables that fill a block in part, or that have no peaks, against DuckDB."""

import duckdb
import pytest

from tessera.operators import radiometry
from tessera.plans import catalogue
from tests.test_catalogue import rows

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, table, name):
    db = duckdb.connect()
    db.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    ours, theirs = catalogue.queries()[name](spark, str(folder)).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(theirs) and rows(ours) == rows(theirs)


@pytest.fixture(scope="module", params=[156, 102])
def part_filled(request, tmp_path_factory):
    """The first block begins at its row 30, the last has its rows up to 56, or fewer than a probe reaches."""
    folder = tmp_path_factory.mktemp("part")
    duckdb.sql(f"copy (select * from '{SF}/embeddings.parquet' where vec_id between 30 and {request.param}) to '{folder}/embeddings.parquet' (format parquet)")
    return folder


def test_features_of_part_filled_blocks(spark, part_filled):
    same_as_sql(spark, part_filled, "embeddings", "features_srgb16_kernel")


def test_literal_neighbours_of_part_filled_blocks(spark, part_filled):
    same_as_sql(spark, part_filled, "embeddings", "neighbor_kernel_literal")


def test_training_neighbours_of_part_filled_blocks(spark, part_filled):
    same_as_sql(spark, part_filled, "embeddings", "neighbor_kernel_training")
    same_as_sql(spark, part_filled, "embeddings", "neighbor_kernel_clean")


def test_thresholds_without_peaks_are_the_ends(spark, tmp_path):
    duckdb.sql(f"copy (select i as event_id, i % 7 as user_id, cast(i as double) as value from range(1000) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    same_as_sql(spark, tmp_path, "events", "hist_thresholds")


def test_thresholds_of_one_histogram_without_keys(spark):
    histogram = spark.createDataFrame([(i, i + 4, 5) for i in range(6)], "i long, dn long, h long")
    ends = spark.createDataFrame([(5, 8)], "low long, high long")
    assert tuple(radiometry.thresholds(histogram, ends, []).first()) == (4, 9, 9, 4)
    assert tuple(radiometry.thresholds(histogram, ends.where("low < 0"), []).first()) == (4, 9, 9, 4)
