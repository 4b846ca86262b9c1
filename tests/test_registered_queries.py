"""Every registered query runs on the smallest tables and equals its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import compare

SF = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, name):
    ok, note = compare(spark, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).columns == ["title", "q_idx", "response", "source_chunks"]
