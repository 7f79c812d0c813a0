"""Every registered query against its SQL twin; without one, it must give rows."""
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.base import QUERIES
from catalog.check import compare, oracle_connection

FOLDER = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"
queries()  # registers
# No cell of the sparse smallest grid lies near a station.
MAY_BE_EMPTY = {"station_cells_scan_S07", "clustered_station_scan_S07", "model_ssh_series_J05", "clustered_station_series_J05", "gauge_extraction_chain", "peaks_W02"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


# Text queries have their own in tests/llm.
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, n, _ = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY), problem


def test_entry_has_stable_schema(spark):
    assert entry(spark).columns == [
        "region", "season", "z", "level_set", "mean_diff_temperature", "mean_abs_diff_temperature", "n"]


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
