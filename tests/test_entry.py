"""The driver's contract, with or without the training-data operators."""

import pytest

import __spark_entry__ as entry


def test_queries_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert any(k.startswith("adapt_") for k in entry.queries())


def test_every_operator_has_its_query():
    if entry.registry is None:
        pytest.skip("the training-data operators are not here")
    names = list(entry.queries())
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
