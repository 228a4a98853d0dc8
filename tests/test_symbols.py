"""Scalar functions on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions import rules, symbols, text, values


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "symbol, exchange, vendor",
    [("0005", "SEHK", "5"), ("0000", "SEHK", "0000"), ("BP", "LSE", "BP."), ("HSBA", "LSE", "HSBA"), ("B.", "LSE", "B."), ("X", "NSE", "X"), ("X", "??", "X")],
)
def test_to_vendor(spark, symbol, exchange, vendor):
    assert value(spark, symbols.to_vendor_symbol(F.lit(symbol), F.lit(exchange))) == vendor


@pytest.mark.parametrize("symbol, exchange, ticker", [("BP.", "LSE", "BP.L"), ("5", "SEHK", "5.HK"), ("T", "SMART", "T"), ("T", "??", "T")])
def test_from_vendor(spark, symbol, exchange, ticker):
    assert value(spark, symbols.from_vendor_symbol(F.lit(symbol), F.lit(exchange))) == ticker


@pytest.mark.parametrize("ticker, exchange", [("RELIANCE.NS", "NSE"), ("2222.SR", "TADAWUL"), ("AAPL", ""), ("X.ZZ", ""), ("A.B.L", "LSE"), ("X.", "")])
def test_exchange_of(spark, ticker, exchange):
    assert value(spark, symbols.exchange_of(F.lit(ticker))) == exchange
    from lowtide.operators.lookups import with_exchange

    df = spark.createDataFrame([(ticker,)], "ticker string")
    assert with_exchange(df, spark).first()["exchange"] == exchange


@pytest.mark.parametrize("old", ["X.NS.NS", "X.NS.NSE", "X.NSE", "X.NS", "X"])
def test_standardise(spark, old):
    assert value(spark, symbols.standardise(F.lit(old))) == "X.NS"


def test_standardise_keeps_empty_and_null(spark):
    assert value(spark, symbols.standardise(F.lit(""))) == ""
    assert value(spark, symbols.standardise(F.lit(None).cast("string"))) is None


def test_suffix_chains(spark):
    both = lambda t: (value(spark, symbols.exchange_by_ending(F.lit(t))), value(spark, symbols.exchange_by_content(F.lit(t))))
    assert both("A.TO") == ("TSE", "TSE")
    assert both("A.AX") == ("SMART", "ASX")
    assert both("A.NS.X") == ("SMART", "NSE")  # contained, not at the end
    assert value(spark, symbols.country_of_exchange(F.lit("IDX"))) == "Indonesia"
    assert value(spark, symbols.country_of_exchange(F.lit("LSE"))) == "Unknown"
    assert tuple(value(spark, symbols.contract_of(F.lit("AB.PA")))) == ("AB", "SBF", "EUR", True)
    assert tuple(value(spark, symbols.contract_of(F.lit("AB.JK")))) == ("AB.JK", "IDX", None, False)


@pytest.mark.parametrize("raw, number", [(" 1,234.50 ", 1234.5), ("", None), ("n/a", None), ("NaN", None), ("-3", -3.0), (None, None)])
def test_clean_number(spark, raw, number):
    assert value(spark, values.clean_number(F.lit(raw).cast("string"))) == number


def test_money(spark):
    assert value(spark, values.full_usd_cap(F.lit(2.5))) == 2.5e9
    assert value(spark, values.full_usd_cap(F.lit(5e8))) == 5e8
    assert value(spark, values.full_usd_cap(F.lit(None).cast("double"))) == 0.0
    assert value(spark, values.whole_number(F.lit(7.5))) == 8
    assert value(spark, values.clean_forecast(F.lit(-99999.99))) is None
    assert [value(spark, values.currency_of(F.lit(t))) for t in ("A.T", "A.TO", "A.L")] == ["JPY", "CAD", "USD"]
    rates = {r["currency"]: r["usd_rate"] for r in dims.fx_rates(spark).collect()}
    assert (rates["INR"], rates["THB"]) == (0.012, 0.028)
    assert value(spark, values.usd_value(F.lit(10.0), F.lit(None).cast("double"))) == 10.0


def test_reason_and_alert_line(spark):
    reason = lambda *v: value(spark, text.screening_reason(*[F.lit(x).cast("double") for x in v[:2]], F.lit(v[2]).cast("bigint")))
    assert reason(102.0, 100.0, 1234567) == "2.0% from 52w low; Vol: 1,234,567"
    assert reason(102.0, None, 0) == "No 52w low baseline (Volume Catch)"
    line = lambda t, *v: value(spark, text.alert_line(F.lit(t), *[F.lit(x).cast("double") for x in v]))
    assert line("A.NS", 1234.5, 1.02, 5.5, 22.0, 0.031) == "🔥 `A.NS` — ₹1,234.50 | +2.0% | RSI 22 | RVOL 5.5x | ATR 3.1%"
    assert line("A", 9.0, 0.0, 0.0, None, None) == "📌 `A` — $9.00"
    assert line("A.L", 9.0, 1.5, 3.0, None, 0.0) == "⚡ `A.L` — £9.00 | +50.0% | RVOL 3.0x"
    assert value(spark, text.short_money(F.lit(1_250_000_000))) == "$1.3B"
    assert value(spark, text.short_money(F.lit(0))) == "N/A"


def test_rules(spark):
    import hashlib

    assert value(spark, rules.cache_key(F.lit("A"), F.lit("filtering"))) == hashlib.md5(b"A|filtering").hexdigest()
    due = lambda day, last: tuple(value(spark, rules.quarterly_update_due(F.lit(day).cast("date"), F.lit(last).cast("date"))))
    assert due("2026-02-01", None) == (False, "Not quarter start date")
    assert due("2026-04-01", None) == (True, "No previous fundamentals data found")
    assert due("2026-04-01", "2026-01-01") == (True, "90 days since last update")
    assert due("2026-04-01", "2026-03-01") == (False, "Last update was 31 days ago")
    assert [value(spark, rules.error_status(F.lit(m))) for m in ("HTTP 404", "Possibly DELISTED", "timeout")] == ["INACTIVE", "INACTIVE", "RETRY"]
    act = lambda c, n: value(spark, rules.vendor_error_action(F.lit(c), F.lit(n)))
    assert [act(200, 0), act(354, 0), act(502, 2), act(504, 3), act(1, 0)] == ["inactive", "fallback", "retry", "log", "log"]
    assert [value(spark, rules.history_period(F.lit(d))) for d in (30, 31, 180, 181)] == ["1mo", "3mo", "6mo", "1y"]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_scan_windows_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        utc = F.lit("2026-01-05 04:20:00").cast("timestamp_ntz")  # 09:50 in India
        args = utc, F.lit("Asia/Kolkata"), F.lit(585)
        assert value(spark, rules.in_scan_window(*args, F.lit(915))) is True
        assert str(value(spark, rules.next_scan_start(*args))) == "2026-01-06 04:15:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
