"""Registered queries against their SQL where there are more queries than a broadcast takes, as at 1 GB."""

import functools

import duckdb
import pytest
from test_catalogue import SF, rows

from quorix.operators import search
from quorix.plans import catalogue

BLOCKED = ("confusion_matrix", "detection_score", "final_score", "knn_full_exact", "knn_neighbors", "metrics_by_name", "recall_ivf", "result_report", "weighted_errors")


@pytest.mark.parametrize("name", BLOCKED)
def test_blocked_query(spark, monkeypatch, name):
    # Both sides of the blocked join come from one checkpoint, and what follows reads few of the columns.
    monkeypatch.setattr(search, "nearest", functools.partial(search.nearest, slice_rows=3, ref_rows=40))
    events = duckdb.connect()
    events.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(events.execute(catalogue.ORACLES[name]).df())
