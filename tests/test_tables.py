"""Merges, lookups, quality rules and table lifecycle on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lowtide import schemas
from lowtide.operators import exports, indicators, lookups, merge, quality, reports, universe
from lowtide.session import run_folder
from lowtide.sources import tables as readers

T = lambda day, hour=0: dt.datetime(2026, 1, day, hour)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_merge_is_idempotent_and_prefers_the_incoming_row(spark):
    schema = "ticker string, price double, last_updated timestamp_ntz"
    current = spark.createDataFrame([("A", 1.0, T(5)), ("B", 1.0, T(5)), ("C", 1.0, T(5))], schema)
    incoming = spark.createDataFrame([("A", 2.0, T(4)), ("B", 2.0, T(5)), ("C", 2.0, T(6)), ("D", 2.0, T(1))], schema)
    once = merge.guarded_upsert(current, incoming, ["ticker"])
    assert rows(once, "ticker", "price") == [("A", 1.0), ("B", 2.0), ("C", 2.0), ("D", 2.0)]
    assert rows(merge.guarded_upsert(once, incoming, ["ticker"]), "*") == rows(once, "*")
    everything = merge.upsert(current, incoming, ["ticker"], ["last_updated"])
    assert rows(everything, "ticker", "price") == [("A", 2.0), ("B", 2.0), ("C", 2.0), ("D", 2.0)]


def test_merge_keeps_null_columns_of_the_newest_row(spark):
    df = spark.createDataFrame([("A", 1.0, T(1)), ("A", None, T(2))], "ticker string, price double, t timestamp_ntz")
    assert rows(indicators.latest_per_key(df, ["ticker"], ["t"]), "ticker", "price") == [("A", None)]


def test_save_tickers_keeps_status(spark):
    current = spark.createDataFrame(
        [("A", "NSE", "INACTIVE", "gone", T(1)), ("B", None, None, None, None)], schemas.TICKERS
    )
    incoming = spark.createDataFrame([("A", "LSE"), ("B", "LSE"), ("C", "LSE"), ("C", "LSE")], "ticker string, market string")
    out = merge.save_tickers(current, incoming, "2026-01-09")
    assert rows(out, "ticker", "market", "status") == [("A", "LSE", "INACTIVE"), ("B", "LSE", None), ("C", "LSE", "ACTIVE")]


def test_rows_without_a_market_count_as_seen(spark):
    current = spark.createDataFrame([("A", "NSE", "ACTIVE", None, T(1)), ("B", "NSE", None, None, T(1))], schemas.TICKERS)
    incoming = spark.createDataFrame([("A", None), ("N", None)], "ticker string, market string")
    out = merge.save_tickers(current, incoming, "2026-01-09")
    assert rows(out, "ticker", "market", "status", "last_updated") == [
        ("A", "NSE", "ACTIVE", T(9)), ("B", "NSE", None, T(1)), ("N", None, "ACTIVE", T(9))
    ]


def test_the_last_update_of_a_key_counts(spark):
    current = spark.createDataFrame([("A", "NSE", None, None, T(1))], schemas.TICKERS)
    updates = spark.createDataFrame(
        [("A", "INACTIVE", "gone", 1), ("A", "ACTIVE", None, 3), ("A", "INACTIVE", "z", 2), ("Q", "ACTIVE", "", 9)],
        "ticker string, status string, status_message string, n int",
    )
    out = merge.update_status(current, updates, "2026-01-09", ["n"])
    assert rows(out, "ticker", "status", "status_message") == [("A", "ACTIVE", None)]
    values = spark.createDataFrame([("A", 1, 2), ("B", 1, 2)], "k string, x int, y int")
    changes = spark.createDataFrame([("A", 5, None, 1), ("A", 7, None, 2), ("A", 6, 9, 0)], "k string, x int, y int, n int")
    assert rows(merge.update_columns(values, changes, "k", ["x", "y"], ["n"]), "*") == [("A", 7, 2), ("B", 1, 2)]


def test_versions_of_a_replaced_table(spark):
    path = run_folder(spark, "versions")
    assert merge.read_current(spark, path) is None and merge.retired_versions(spark, path).isEmpty()
    merge.replace_table(spark, spark.range(3), path)
    old = merge.read_current(spark, path)  # a reader that has the old state goes on reading it
    merge.replace_table(spark, merge.read_current(spark, path).filter("id > 0"), path)
    assert old.count() == 3 and rows(merge.read_current(spark, path), "id") == [(1,), (2,)]
    with pytest.raises(Exception):
        merge.replace_table(spark, spark.range(9).select(F.raise_error(F.lit("lost"))), path)
    assert rows(merge.read_current(spark, path), "id") == [(1,), (2,)]
    assert merge.retired_versions(spark, path).count() == 1
    merge.drop_table(spark, path)
    assert merge.read_current(spark, path) is None and merge.retired_versions(spark, path).count() == 2


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([("A",), ("B",), (None,)], "ticker string")
    right = lambda *v: spark.createDataFrame([(x,) for x in v], "ticker string")
    for other in (right("A"), right("A", None), right(None), right(), right("A", "A", "B")):
        want = spark.sql("SELECT * FROM {l} WHERE ticker NOT IN (SELECT ticker FROM {r})", l=left, r=other)
        assert rows(lookups.not_in(left, other), "ticker") == rows(want, "ticker")


def test_prefilter_and_selection(spark):
    tickers = spark.createDataFrame([(t,) for t in "ABCDE"], "ticker string")
    known = spark.createDataFrame(
        [("A", "NSE", 100_000_000, True, T(9)), ("B", "NSE", None, False, T(9)), ("C", "XX", 600_000_000, True, T(1)), ("D", "LSE", 600_000_000, True, T(9))],
        "ticker string, exchange string, market_cap_usd bigint, is_active boolean, last_updated timestamp_ntz",
    )
    out = universe.fundamental_prefilter(tickers, known, "2026-02-05")
    assert rows(out, "*") == [
        ("A", True, "Market cap $100M < threshold $150M"), ("B", True, "Stock no longer active"),
        ("C", False, "Data 35 days old, needs refresh"), ("D", False, "Passes fundamental filters"),
        ("E", False, "No cached fundamentals"),
    ]
    with pytest.raises(ValueError):
        universe.seed_tickers(known, known, "LSE", "fd_capfilter")


def test_actionable_parole(spark):
    df = spark.createDataFrame([("A", "ACTIVE", T(1)), ("B", None, T(1)), ("C", "INACTIVE", T(1)), ("D", "INACTIVE", dt.datetime(2025, 1, 1))], "ticker string, status string, last_updated timestamp_ntz")
    assert rows(universe.actionable(df, "2026-01-09"), "ticker") == [("A",), ("B",), ("D",)]


def test_table_lifecycle(spark):
    root = run_folder(spark, "lifecycle")
    schemas.create_tables(spark, root)
    for name in schemas.TABLES:
        assert schemas.read_table(spark, root, name).isEmpty()
    assert len(schemas.read_table(spark, root, "stock_fundamentals").columns) == 81
    spark.createDataFrame([("A", "NSE", None, None, T(1))], schemas.TICKERS).write.mode("append").parquet(f"{root}/tickers")
    schemas.create_tables(spark, root)  # leaves existing tables alone
    assert schemas.read_table(spark, root, "tickers").count() == 1
    schemas.register(spark, root, ["tickers"])
    found = readers.parameterised_query(spark, "SELECT ticker FROM tickers WHERE market = :m", {"m": "NSE"})
    assert rows(found, "ticker") == [("A",)]
    schemas.truncate_table(spark, root, "tickers")
    assert schemas.read_table(spark, root, "tickers").isEmpty()


def test_wide_prices(spark):
    wide = spark.createDataFrame(
        [("2026-01-01", 1.0, 2.0, "0.5", 1.5, 10.0, None, None, None, None, None), ("2026-01-02", 1.0, None, "x", 1.5, None, 1.0, 1.0, 1.0, 1.0, 7.6)],
        "Date string, `A.L|Open` double, `A.L|High` double, `A.L|Low` string, `A.L|Close` double, `A.L|Volume` double, "
        "`B|Open` double, `B|High` double, `B|Low` double, `B|Close` double, `B|Volume` double",
    )
    bars = readers.wide_to_bars(wide)
    assert rows(bars, "ticker", "low", "volume") == [("A.L", 0.5, 10), ("A.L", None, 0), ("B", 1.0, 8), ("B", None, 0)]
    assert rows(readers.ingest_wide(wide, "w"), "ticker", "source") == [("A.L", "w"), ("B", "w")]


def test_curated_list_file(spark, tmp_path):
    (tmp_path / "x.json").write_text('{\n "exchange": "SEHK",\n "index_name": "i",\n "tickers": ["1.HK", "5.HK"]\n}')
    assert rows(readers.ticker_lists(spark, str(tmp_path)), "exchange", "position", "ticker") == [("SEHK", 0, "1.HK"), ("SEHK", 1, "5.HK")]


def test_catch_rows_defaults(spark):
    df = spark.createDataFrame([("A", 1.005, 7), (None, None, None)], "symbol string, price double, volume bigint")
    out = exports.catch_rows(df, "2026-01-01")
    assert out.columns == schemas.column_names(schemas.CATCHES)
    assert rows(out, "ticker", "price", "volume", "usd_mcap", "reason") == [("A", 1.01, 7, 0.0, ""), ("UNKNOWN", 0.0, 0, 0.0, "")]


def test_unreadable_catch_log_counts_as_empty(spark, tmp_path):
    assert readers.read_catches(spark, str(tmp_path / "absent")).isEmpty()
    log = tmp_path / "log"
    log.mkdir()
    (log / "part.csv").write_text(
        "timestamp,ticker,price,volume,usd_mcap,pct_from_low,reason\n"
        "2026-01-01T00:00:00.000,A,1.5,10,0.0,1.0,ok\n2026-01-01T00:00:00.000,B,oops,10,0.0,1.0,bad\n"
    )
    (log / "other.csv").write_text("reason,price,ticker,volume\n\"odd, quoted\",2.5,C,7\nshort,1.0\n,,D,\n")
    assert rows(readers.read_catches(spark, str(log)), "ticker", "price", "volume", "reason") == [
        ("A", 1.5, 10, "ok"), ("C", 2.5, 7, "odd, quoted"), ("D", None, None, ""),
    ]
    assert rows(readers.malformed_catches(spark, str(log)), "issue") == [("number of values",), ("price",)]


def test_freshness(spark):
    bars = spark.range(1)
    now = lambda *v: spark.createDataFrame([(x,) for x in v], "last_updated timestamp_ntz")
    fresh = lambda quotes, history: reports.freshness(quotes, history, "2026-01-03 00:00:00").first()["is_fresh"]
    assert fresh(now(T(2, 1)), bars) is True
    assert fresh(now(T(1, 1)), bars) is False
    assert fresh(now(), bars) is False
    assert fresh(now(T(2, 1)), bars.limit(0)) is False


def test_quality_rules_count_undecided_rows(spark):
    df = spark.createDataFrame([(1, None, 5.0), (None, "x", 2000.0), (0, "y", None)], "market_cap_usd bigint, company_name string, pe_ratio double")
    out = {r["rule"]: (r["invalid"], r["undecided"]) for r in quality.count_violations(df, quality.fundamentals_rules()).collect()}
    assert out == {"cap_not_positive": (1, 1), "name_missing": (1, 0), "pe_out_of_range": (1, 1)}


def test_quality_metrics_duplicates(spark):
    df = spark.createDataFrame([("A", 1.0, T(1)), ("A", None, T(2)), ("B", 9.0, T(20))], "ticker string, v double, t timestamp_ntz")
    m = quality.quality_metrics(df, "x", ["ticker"], "t", "2026-01-21", F.col("v") > 5, max_age_days=3).first()
    assert (m["total_records"], m["duplicate_records"], m["null_values"], m["outlier_records"]) == (3, 1, 1, 1)
    assert m["completeness_score"] == pytest.approx(5 / 6, abs=1e-6) and m["timeliness_score"] == pytest.approx(1 / 3, abs=1e-6)


def test_digest_writes_ordered_lines(spark, tmp_path):
    schema = "symbol string, price_date date, price double, pct_from_low double, rvol double, rsi double, atr_pct double"
    day = dt.date(2026, 1, 1)
    df = spark.createDataFrame([("B.NS", day, 2.0, 1.1, 1.0, 30.0, 0.1), ("A.NS", day, 1.0, 1.1, 1.0, 30.0, 0.1), ("C.L", day, 3.0, 1.1, 1.0, 30.0, 0.1)], schema)
    path = str(tmp_path / "digest")
    exports.write_digest(reports.digest(df), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[0] == "🇬🇧 *LSE (1)*" and lines[2] == "🇮🇳 *NSE (2)*" and "`A.NS`" in lines[3]
    assert reports.digest_title(df).first()["title"] == "📊 *DAILY SCAN — 3 SIGNALS*"
