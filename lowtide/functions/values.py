"""Cleaning of raw values and money conversions.  Missing is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions.lookup import first_match

# --- fixed value: marks a missing forecast in vendor documents
MISSING_FORECAST = -99999.99


def clean_number(text: Column) -> Column:
    """Text -> double; blanks, separators and garbage are handled, NaN becomes NULL."""
    value = F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")
    return F.when(~F.isnan(value), value)


def clean_text(text: Column) -> Column:
    """NULL for blank text and for a bare NaN that was read as text (with or without quotes)."""
    return F.when(~F.trim(text).isin("", "NaN", '"NaN"'), text)


def clean_double(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def whole_number(value: Column) -> Column:
    """Round to a whole number first: a plain cast would truncate."""
    return F.round(value).cast("bigint")


def volume_or_zero(value: Column) -> Column:
    return F.coalesce(whole_number(clean_number(value.cast("string"))), F.lit(0).cast("bigint"))


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding of non-negative doubles in double arithmetic.

    ``round`` goes through BigDecimal, about ten times slower on a wide panel.
    """
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.5) / scale


def half_away(value: Column, digits: int) -> Column:
    """Rounding of doubles of either sign, halves away from zero, as scaled in double arithmetic.

    ``round`` with digits takes the decimal form of the unscaled value, which may lie below a half
    while the scaled value is one."""
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def clean_forecast(value: Column) -> Column:
    return F.nullif(value, F.lit(MISSING_FORECAST))


def currency_of(ticker: Column) -> Column:
    """Currency by ticker suffix, USD when unknown."""
    return first_match(
        [(ticker.endswith(s), F.lit(c)) for s, c in dims.SUFFIX_CURRENCY.items()], F.lit("USD")
    )


def usd_value(amount: Column, rate: Column) -> Column:
    """Amount in USD; a missing rate counts as 1."""
    return amount * F.coalesce(rate, F.lit(1.0))


def full_usd_cap(cap: Column) -> Column:
    """Market cap in whole dollars: a value under 1000 is read as billions."""
    known = F.coalesce(cap.cast("double"), F.lit(0.0))
    return F.when(known < 1000, known * 1e9).otherwise(known)


def json_number(doc: Column, path: str) -> Column:
    """A number at a JSON path, NULL when missing or not a number."""
    return F.get_json_object(doc, path).try_cast("double")


def quote_field(doc: Column, name: str) -> Column:
    """A quote field given flat or inside ``Ticker``, as cleaned text."""
    return F.coalesce(doc.getField(name), doc.getField("Ticker").getField(name))
