import pytest
from conftest import DATA
from oracle import connect, same

from trackloom.plans import registry


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.001")


#: Queries that find nothing in the smallest tables, but do at sf0.01.
EMPTY = {"w02_first_image", "w03_second_image", "w04_next_images", "j17_2d3d"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, con, name):
    same(registry.QUERIES[name](spark, f"{DATA}/sf0.001"), registry.ORACLES[name], con, name not in EMPTY)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
