"""Every registered query against its SQL oracle."""

import __spark_entry__ as contract
import compare
import pytest

# The optional operators for training text have their own tests.
NAMES = sorted(name for name in contract.queries() if name.startswith("q_"))
MODELS = [n for n in NAMES if "model" in n] + ["q_ns_landings", "q_widow_shelf", "q_closest_year"]


@pytest.fixture(scope="module")
def small(sf_small):
    return compare.connect(sf_small)


@pytest.fixture(scope="module")
def medium(sf_medium):
    return compare.connect(sf_medium)


def check(spark, con, sf_dir, name):
    types, rows = compare.spark_result(contract.queries()[name](spark, sf_dir))
    oracle_types, oracle_rows = compare.oracle(con, contract.oracle_sql()[name])
    assert types == oracle_types
    assert rows == oracle_rows
    return rows


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_small(spark, small, sf_small, name):
    check(spark, small, sf_small, name)


@pytest.mark.parametrize("name", MODELS)
def test_models_medium(spark, medium, sf_medium, name):
    assert check(spark, medium, sf_medium, name)


def test_entry(spark, sf_small):
    df = contract.entry(spark)
    assert [f.name for f in df.schema][:2] == ["TYPE", "SQ_MT"]
    assert df.count() >= 1
