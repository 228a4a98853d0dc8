"""Fixed dimension tables.

All of them have a constant number of rows, so they are the only inputs this
package broadcasts unconditionally.  They are built from Arrow tables, which Spark
plans as a LocalRelation with exact statistics.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------------

# exchange, market type, minimum market cap in USD, data source, ticker suffix,
# currency, symbol rule
EXCHANGES = (
    ("NSE", "EMERGING", 150_000_000, "IBKR", ".NS", "INR", None),
    ("BSE", "EMERGING", 150_000_000, "IBKR", ".BO", "INR", None),
    ("ASX", "MAJOR", 500_000_000, "IBKR", ".AX", "AUD", None),
    ("SGX", "MAJOR", 500_000_000, "IBKR", ".SI", "SGD", None),
    ("SEHK", "MAJOR", 500_000_000, "IBKR", ".HK", "HKD", "strip_leading_zeros"),
    ("LSE", "MAJOR", 500_000_000, "IBKR", ".L", "GBP", "trailing_period"),
    ("JSE", "EMERGING", 150_000_000, "IBKR", ".JO", "ZAR", None),
    ("TADAWUL", "EMERGING", 150_000_000, "IBKR", ".SR", "SAR", None),
    ("SMART", "MAJOR", 500_000_000, "IBKR_PAID", "", "USD", None),
    ("TSE", "MAJOR", 500_000_000, "IBKR_PAID", ".TO", "CAD", None),
    ("IBIS", "MAJOR", 500_000_000, "IBKR_PAID", ".DE", "EUR", None),
    ("SBF", "MAJOR", 500_000_000, "IBKR_PAID", ".PA", "EUR", None),
    ("IDX", "EMERGING", 150_000_000, "YFINANCE", ".JK", None, None),
    ("SET", "EMERGING", 150_000_000, "YFINANCE", ".BK", None, None),
    ("BOVESPA", "EMERGING", 150_000_000, "YFINANCE", ".SA", None, None),
    ("KSE", "MAJOR", 500_000_000, "YFINANCE", ".KS", None, None),
    ("TWSE", "MAJOR", 500_000_000, "YFINANCE", ".TW", None, None),
    ("BURSA", "EMERGING", 150_000_000, "YFINANCE", ".KL", None, None),
)

DEFAULT_MARKET_TYPE = "MAJOR"
DEFAULT_MIN_CAP_USD = 500_000_000
UNKNOWN_EXCHANGE = "SMA"

# market flag -> switched on by default
MARKET_FLAGS = {
    "nse": True,
    "asx": True,
    "sgx": True,
    "sehk": True,
    "lse": True,
    "jse": True,
    "tadawul": True,
    "tsx": False,
    "xetra": False,
    "sbf": False,
    "smart": False,
    "idx": True,
    "set": True,
    "bovespa": False,
    "kse": False,
    "twse": False,
    "bursa": False,
}

# market flag, directory exchange code, market code in the universe table, ticker suffix
UNIVERSE_MARKETS = (
    ("nse", "NSE", "NSE", ".NS"),
    ("tsx", "TOR", "TSE", ".TO"),
    ("asx", "ASX", "ASX", ".AX"),
    ("sgx", "SES", "SGX", ".SI"),
    ("xetra", "GER", "XETRA", ".DE"),
    ("sbf", "FRA", "SBF", ".PA"),
    ("sehk", "HKG", "SEHK", ".HK"),
    ("lse", "LSE", "LSE", ".L"),
    ("jse", "JNB", "JSE", ".JO"),
    ("tadawul", "SAU", "TADAWUL", ".SR"),
    ("idx", "JKT", "IDX", ".JK"),
    ("set", "SET", "SET", ".BK"),
)

# markets whose directory listing is restricted to the allowed cap categories
CAP_FILTERED_MARKETS = ("ASX", "JSE", "LSE", "SEHK", "SGX", "TADAWUL")
ALLOWED_CAPS = ("Large Cap", "Mid Cap", "Small Cap")
EXCLUDED_CAPS = ("Nano Cap", "Micro Cap")

# USD value of one unit when no rate is supplied
FALLBACK_FX = {"INR": 0.012, "IDR": 0.000064, "THB": 0.028, "USD": 1.0, "CAD": 0.74}

# currency by ticker suffix, otherwise USD
SUFFIX_CURRENCY = {".NS": "INR", ".JK": "IDR", ".BK": "THB", ".TO": "CAD", ".T": "JPY"}

# the four suffixes the older cap filter knows
LEGACY_SUFFIX_EXCHANGE = {".NS": "NSE", ".TO": "TSE", ".JK": "IDX", ".BK": "SET"}

# the eight suffixes the fundamentals writer knows
WRITER_SUFFIX_EXCHANGE = {
    ".NS": "NSE",
    ".TO": "TSE",
    ".AX": "ASX",
    ".SI": "SGX",
    ".DE": "IBIS",
    ".PA": "SBF",
    ".JK": "IDX",
    ".BK": "SET",
}

EXCHANGE_COUNTRY = {
    "NSE": "India",
    "TSE": "Canada",
    "IDX": "Indonesia",
    "SET": "Thailand",
    "SMART": "United States",
}

# suffix -> exchange, currency for quote requests; the last two are unsupported there
CONTRACT_SUFFIXES = {
    ".TO": ("TSE", "CAD"),
    ".NS": ("NSE", "INR"),
    ".AX": ("ASX", "AUD"),
    ".SI": ("SGX", "SGD"),
    ".DE": ("IBIS", "EUR"),
    ".PA": ("SBF", "EUR"),
    ".JK": ("IDX", None),
    ".BK": ("SET", None),
}
UNSUPPORTED_CONTRACT_EXCHANGES = ("IDX", "SET")

# suffix, flag, currency sign, exchange label for digests
DISPLAY = (
    (".NS", "🇮🇳", "₹", "NSE"),
    (".BO", "🇮🇳", "₹", "BSE"),
    (".AX", "🇦🇺", "A$", "ASX"),
    (".SI", "🇸🇬", "S$", "SGX"),
    (".HK", "🇭🇰", "HK$", "SEHK"),
    (".L", "🇬🇧", "£", "LSE"),
    (".JO", "🇿🇦", "R", "JSE"),
    (".SR", "🇸🇦", "SAR ", "TADAWUL"),
    (".T", "🇯🇵", "¥", "TSE"),
    (".TO", "🇨🇦", "CA$", "TSX"),
    (".DE", "🇩🇪", "€", "XETRA"),
    (".PA", "🇫🇷", "€", "Euronext"),
    (".KS", "🇰🇷", "₩", "KRX"),
    (".TW", "🇹🇼", "NT$", "TWSE"),
    (".SA", "🇧🇷", "R$", "Bovespa"),
    (".KL", "🇲🇾", "RM ", "Bursa"),
    (".BK", "🇹🇭", "฿", "SET"),
    (".JK", "🇮🇩", "Rp ", "IDX"),
)
DISPLAY_DEFAULT = ("🌐", "$", "US/OTHER")
SIGNAL_ICONS = {"EXTREME": "🔥", "STRONG": "⚡", "WATCH": "📌"}

# market flag -> region
MARKET_REGIONS = {
    "us": "north_america",
    "tsx": "north_america",
    "uk": "europe",
    "germany": "europe",
    "france": "europe",
    "japan": "asia_pacific",
    "australia": "asia_pacific",
    "singapore": "asia_pacific",
    "hongkong": "asia_pacific",
    "nse": "india",
    "idx": "emerging_asia",
    "set": "emerging_asia",
}

# region, first minute of the scan window, last minute, time zone
SCAN_WINDOWS = (
    ("north_america", 9 * 60 + 30, 15 * 60 + 30, "US/Eastern"),
    ("europe", 9 * 60 + 30, 16 * 60 + 30, "Europe/London"),
    ("india", 9 * 60 + 45, 15 * 60 + 15, "Asia/Kolkata"),
    ("asia_pacific", 9 * 60 + 30, 15 * 60 + 30, "Asia/Tokyo"),
    ("emerging_asia", 10 * 60 + 30, 16 * 60 + 30, "Asia/Bangkok"),
)

# vendor error code -> (action, message)
VENDOR_ERRORS = {
    200: ("inactive", "Security not found"),
    354: ("fallback", "No subscription"),
    502: ("retry", "Connection issue"),
    504: ("retry", "Connection issue"),
}
MAX_RETRIES = 3

# --- derived lookups and tables ----------------------------------------------------

SUFFIX_BY_EXCHANGE = {row[0]: row[4] for row in EXCHANGES}
EXCHANGE_BY_SUFFIX = {row[4]: row[0] for row in EXCHANGES if row[4]}
MIN_CAP_BY_EXCHANGE = {row[0]: row[2] for row in EXCHANGES}
TYPE_BY_EXCHANGE = {row[0]: row[1] for row in EXCHANGES}
CURRENCY_BY_EXCHANGE = {row[0]: row[5] for row in EXCHANGES if row[5]}


def _table(spark: SparkSession, rows, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    columns = list(zip(*rows))
    return spark.createDataFrame(
        pa.table({name: pa.array(values, kind) for (name, kind), values in zip(fields, columns)})
    )


def registry(spark: SparkSession) -> DataFrame:
    """Exchange registry, one row per exchange, with its position as ``idx``."""
    rows = [(i, *row) for i, row in enumerate(EXCHANGES)]
    return _table(
        spark,
        rows,
        [
            ("idx", pa.int64()),
            ("exchange", pa.string()),
            ("market_type", pa.string()),
            ("min_cap_usd", pa.int64()),
            ("provider", pa.string()),
            ("suffix", pa.string()),
            ("currency", pa.string()),
            ("symbol_rule", pa.string()),
        ],
    )


def market_flags(spark: SparkSession, flags: dict[str, bool] | None = None) -> DataFrame:
    rows = list((flags if flags is not None else MARKET_FLAGS).items())
    return _table(spark, rows, [("market_flag", pa.string()), ("enabled", pa.bool_())])


def universe_markets(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        UNIVERSE_MARKETS,
        [
            ("market_flag", pa.string()),
            ("directory_code", pa.string()),
            ("market", pa.string()),
            ("suffix", pa.string()),
        ],
    )


def fx_rates(spark: SparkSession, rates: dict[str, float] | None = None) -> DataFrame:
    rows = list((rates if rates is not None else FALLBACK_FX).items())
    return _table(spark, rows, [("currency", pa.string()), ("usd_rate", pa.float64())])


def display(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        DISPLAY,
        [
            ("suffix", pa.string()),
            ("flag", pa.string()),
            ("sign", pa.string()),
            ("label", pa.string()),
        ],
    )


def regions(spark: SparkSession) -> DataFrame:
    return _table(
        spark, list(MARKET_REGIONS.items()), [("market_flag", pa.string()), ("region", pa.string())]
    )


def scan_windows(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        SCAN_WINDOWS,
        [
            ("region", pa.string()),
            ("start_minute", pa.int64()),
            ("end_minute", pa.int64()),
            ("time_zone", pa.string()),
        ],
    )


def ttl_hours(spark: SparkSession, ttl: dict[str, int]) -> DataFrame:
    return _table(
        spark, list(ttl.items()), [("data_type", pa.string()), ("ttl_hours", pa.int64())]
    )
