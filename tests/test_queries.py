"""Every registered query against its oracle text."""

import compare
import pytest

import __spark_entry__ as entry
from tallyfold.plans import registry

# Those of the package itself; the training-data operators have their own tests.
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(key, spark, con, sf):
    left = compare.spark_bag(QUERIES[key](spark, sf))
    assert key in ORACLES
    assert compare.difference(left, compare.duck_bag(con, ORACLES[key])) is None


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


# Those left out run jobs while they are built.
@pytest.mark.parametrize("key", sorted(set(ORACLES) - {"stream_drop_folder", "dependency_levels", "dependency_cycles", "dependency_order", "deliveries_by_year"}))
def test_query_types_match(key, spark, con, sf):
    left = {f.name: _TYPES.get(f.dataType.simpleString()) for f in QUERIES[key](spark, sf).schema.fields}
    right = {r[0]: r[1] for r in con.execute(f"describe {ORACLES[key]}").fetchall()}
    assert left == right


def test_entry_is_the_recap(spark):
    out = entry.entry(spark)
    assert out.columns == ["pos", "operation", "montant"]
    assert out.count() == 5


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
