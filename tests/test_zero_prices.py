"""Queries on the newest quote of a ticker when many of those quotes state a price of zero."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from compare import TABLES, connect, difference, spark_rows, sql_rows

from lowtide.checks import REGISTRY

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def zero_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zero")
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(SF_DIR / f"{name}.parquet")
    duckdb.connect().execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 3 < 2 THEN 0e0 ELSE value END AS value)
                  FROM '{SF_DIR}/events.parquet') TO '{folder}/events.parquet'"""
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["change_deletes", "constraints", "incremental_flatten", "large_caps_with_quote", "latest_quotes", "merge_guarded"],
)
def test_newest_quotes_of_zero_price(spark, zero_dir, name):
    query = REGISTRY[name]
    assert difference(spark_rows(query.run(spark, zero_dir)), sql_rows(connect(zero_dir), query.sql)) is None
