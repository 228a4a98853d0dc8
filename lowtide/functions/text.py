"""Display strings: money, reasons, signal strength and alert lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions.lookup import first_match, lookup
from lowtide.functions.symbols import suffix
from lowtide.functions.values import half_away


def fixed(value: Column, digits: int) -> Column:
    """Decimal text.  Rounding first makes the result independent of the formatter."""
    return F.format_string(f"%.{digits}f", half_away(value.cast("double"), digits))


def short_money(value: Column) -> Column:
    """$1.2B / $345.6M, N/A when missing or zero."""
    return (
        F.when(value.isNull() | (value == 0), F.lit("N/A"))
        .when(value >= 1_000_000_000, F.concat(F.lit("$"), fixed(value / 1e9, 1), F.lit("B")))
        .otherwise(F.concat(F.lit("$"), fixed(value / 1e6, 1), F.lit("M")))
    )


def number_or_none(value: Column, digits: int = 2) -> Column:
    return F.when(value != 0, fixed(value, digits)).otherwise("None")


def percent(ratio: Column, digits: int = 1) -> Column:
    return F.concat(fixed(ratio * 100, digits), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def excerpt(document: Column, size: int) -> Column:
    """The start of a document, for display only."""
    return F.left(document, F.lit(size))


def screening_reason(price: Column, low_52w: Column, volume: Column) -> Column:
    """Why a stored quote was caught."""
    above_low = F.try_divide(price - low_52w, low_52w) * 100
    return F.concat_ws(
        "; ",
        F.when(low_52w > 0, F.concat(fixed(above_low, 1), F.lit("% from 52w low"))).otherwise(
            "No 52w low baseline (Volume Catch)"
        ),
        F.when(volume > 0, F.concat(F.lit("Vol: "), thousands(volume))),
    )


def signal_strength(rsi: Column, rvol: Column) -> Column:
    """EXTREME, STRONG or WATCH; a missing RSI never counts as low."""
    low = lambda limit: F.coalesce(rsi <= limit, F.lit(False))
    known_rvol = F.coalesce(rvol, F.lit(0.0))
    return (
        F.when(low(25) & (known_rvol >= 5.0), "EXTREME")
        .when(low(35) | (known_rvol >= 3.0), "STRONG")
        .otherwise("WATCH")
    )


def display_info(ticker: Column) -> Column:
    """Struct (flag, sign, label) of the exchange a ticker is listed on."""
    ending = suffix(ticker)
    parts = {"flag": 1, "sign": 2, "label": 3}
    return F.struct(
        *[
            lookup({row[0]: row[i] for row in dims.DISPLAY}, ending, default).alias(name)
            for (name, i), default in zip(parts.items(), dims.DISPLAY_DEFAULT)
        ]
    )


def alert_line(
    ticker: Column, price: Column, pct_from_low: Column, rvol: Column, rsi: Column, atr_pct: Column
) -> Column:
    """One digest line; optional parts that are missing or zero are left out."""
    icon = lookup(dims.SIGNAL_ICONS, signal_strength(rsi, rvol))
    money = F.concat(display_info(ticker).getField("sign"), F.format_number(F.round(price, 2), 2))
    head = F.concat(icon, F.lit(" `"), ticker, F.lit("` — "), money)
    return F.concat_ws(
        " | ",
        head,
        F.when(pct_from_low > 0, F.concat(F.lit("+"), percent(pct_from_low - 1))),
        F.when(rsi.isNotNull(), F.concat(F.lit("RSI "), fixed(rsi, 0))),
        F.when(rvol != 0, F.concat(F.lit("RVOL "), fixed(rvol, 1), F.lit("x"))),
        F.when(atr_pct != 0, F.concat(F.lit("ATR "), percent(atr_pct))),
    )


def exchange_by_region_suffix(ticker: Column, endings: dict[str, str], default: str) -> Column:
    """Label by ending, for reports over a chosen set of markets."""
    return first_match([(ticker.endswith(s), F.lit(x)) for s, x in endings.items()], F.lit(default))
