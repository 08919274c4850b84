"""Every query that has SQL equals it on the smallest tables; some of those without run."""

import pytest

from orrery.plans import catalogue, fields  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, compare, name):
    compare(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name], SF)


@pytest.mark.parametrize("name", ["region_growth", "balanced_ghosts", "displacement_boost", "ellipsoid"])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("rows", [[(7, [0.1, 0.2, 0.3])], [(1, [1.0, 0.0, 0.0]), (2, [0.98, 0.0, 0.05]), (3, [-1.0, 0.0, 0.0]), (4, None)]])
def test_tree_forces_of_few_and_outermost_points(spark, compare, tmp_path, rows):
    """One vector alone has no force, one of the axes lies on a face of the cube, one is null."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    compare(catalogue.QUERIES["bh_force"](spark, str(tmp_path)), catalogue.ORACLE["bh_force"], str(tmp_path))
