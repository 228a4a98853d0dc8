"""Ticker and symbol conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions.lookup import first_match, lookup


def _exchanges_with(rule: str) -> list[str]:
    return [row[0] for row in dims.EXCHANGES if row[6] == rule]


def to_vendor_symbol(symbol: Column, exchange: Column) -> Column:
    """Listing symbol -> vendor symbol: no leading zeros for some exchanges, a closing
    period on short symbols for others."""
    bare = F.regexp_replace(symbol, "^0+", "")
    return (
        F.when(
            exchange.isin(_exchanges_with("strip_leading_zeros")),
            F.when(bare == "", symbol).otherwise(bare),
        )
        .when(
            exchange.isin(_exchanges_with("trailing_period"))
            & (F.length(symbol) <= 2)
            & ~symbol.endswith("."),
            F.concat(symbol, F.lit(".")),
        )
        .otherwise(symbol)
    )


def from_vendor_symbol(symbol: Column, exchange: Column) -> Column:
    """Vendor symbol -> suffixed ticker."""
    stripped = F.when(
        exchange.isin(_exchanges_with("trailing_period")), F.regexp_replace(symbol, r"\.+$", "")
    ).otherwise(symbol)
    return F.concat(stripped, suffix_of_exchange(exchange))


def suffix(ticker: Column) -> Column:
    """Last suffix with its dot; NULL when the ticker has none."""
    return F.when(
        F.contains(ticker, F.lit(".")), F.concat(F.lit("."), F.substring_index(ticker, ".", -1))
    )


def exchange_of(ticker: Column) -> Column:
    """Exchange by last suffix, '' when there is none or it is unknown."""
    return lookup(dims.EXCHANGE_BY_SUFFIX, suffix(ticker), "")


def exchange_by_ending(ticker: Column) -> Column:
    """Exchange by the four endings of the older cap filter, else SMART."""
    return first_match(
        [(ticker.endswith(s), F.lit(e)) for s, e in dims.LEGACY_SUFFIX_EXCHANGE.items()],
        F.lit("SMART"),
    )


def exchange_by_content(ticker: Column) -> Column:
    """Exchange by the first known suffix *contained* in the ticker, else SMART."""
    return first_match(
        [(F.contains(ticker, F.lit(s)), F.lit(e)) for s, e in dims.WRITER_SUFFIX_EXCHANGE.items()],
        F.lit("SMART"),
    )


def country_of_exchange(exchange: Column) -> Column:
    return lookup(dims.EXCHANGE_COUNTRY, exchange, "Unknown")


def contract_of(ticker: Column) -> Column:
    """Struct (symbol, exchange, currency, supported) used to request quotes."""
    known = list(dims.CONTRACT_SUFFIXES.items())
    exchange = first_match(
        [(ticker.endswith(s), F.lit(e)) for s, (e, _) in known], F.lit("SMART")
    )
    currency = first_match(
        [(ticker.endswith(s), F.lit(c)) for s, (_, c) in known], F.lit("USD")
    )
    symbol = first_match(
        [
            (ticker.endswith(s), F.left(ticker, F.length(ticker) - len(s)))
            for s, (_, c) in known
            if c is not None
        ],
        ticker,
    )
    return F.struct(
        symbol.alias("symbol"),
        exchange.alias("exchange"),
        currency.alias("currency"),
        (~exchange.isin(*dims.UNSUPPORTED_CONTRACT_EXCHANGES)).alias("supported"),
    )


def market_type(exchange: Column) -> Column:
    return lookup(dims.TYPE_BY_EXCHANGE, exchange, dims.DEFAULT_MARKET_TYPE)


def min_market_cap(exchange: Column) -> Column:
    return lookup(dims.MIN_CAP_BY_EXCHANGE, exchange, dims.DEFAULT_MIN_CAP_USD)


def suffix_of_exchange(exchange: Column) -> Column:
    return lookup(dims.SUFFIX_BY_EXCHANGE, exchange, "")


def append_suffix(symbol: Column, ending: Column) -> Column:
    """Append the suffix unless the symbol already ends with it."""
    return F.when(F.endswith(symbol, ending), symbol).otherwise(F.concat(symbol, ending))


def standardise(ticker: Column) -> Column:
    """Repair doubled or long NSE suffixes and add a missing one; empty stays empty."""
    bare = F.regexp_replace(ticker, r"(\.NS\.NSE|\.NS\.NS|\.NSE|\.NS)$", "")
    return F.when(ticker == "", ticker).otherwise(F.concat(bare, F.lit(".NS")))


def undouble_suffix(ticker: Column) -> Column:
    """Collapse a repeated '.NS.NS' when '.NS' occurs more than once."""
    return F.when(
        F.regexp_count(ticker, F.lit(r"\.NS")) > 1,
        F.replace(ticker, F.lit(".NS.NS"), F.lit(".NS")),
    ).otherwise(ticker)


def is_historical_id(ticker: Column) -> Column:
    """Archive ids of delisted listings: a zero, capitals or digits, and '.L'."""
    return ticker.rlike(r"^0[A-Z0-9]+\.L$")


def base_symbol(ticker: Column) -> Column:
    """Everything before the first dot."""
    return F.substring_index(ticker, ".", 1)


def without_last_suffix(ticker: Column) -> Column:
    """Everything before the last dot."""
    return F.regexp_replace(ticker, r"\.[^.]*$", "")


def id_variants(ticker: Column) -> Column:
    """The ids one listing goes by: as given, bare for the vendor, suffixed for bars and
    for the directory."""
    bare = base_symbol(ticker)
    listed = F.concat(bare, F.lit(".NS"))
    return F.struct(
        ticker.alias("master"),
        bare.alias("vendor"),
        listed.alias("bars"),
        listed.alias("directory"),
    )
