"""Logical schemas of every table the package reads or writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: column names and types -----------------------------------------------

TICKERS = (
    "ticker string, market string, status string, status_message string, last_updated timestamp_ntz"
)

PRICES_DAILY = (
    "ticker string, price_date date, open double, high double, low double, close double, "
    "volume bigint, source string"
)

RAW_QUOTES = (
    "ticker string, market_data string, last_price double, volume bigint, last_updated timestamp_ntz"
)

CURRENT_MARKET_DATA = (
    "ticker string, last_price double, close_price double, open_price double, high_price double, "
    "low_price double, volume bigint, last_updated timestamp_ntz"
)

RAW_COMPANY_XML = (
    "ticker string, xml_snapshot string, xml_ratios string, contract_details string, "
    "last_updated timestamp_ntz"
)

STOCK_FUNDAMENTALS = (
    """
    ticker string, company_name string,
    rep_no string, org_perm_id string, isin string, ric string,
    exchange_code string, exchange_country string,
    most_recent_split_date date, most_recent_split_factor double,
    mkt_cap_usd double, pe_ratio double, price_to_book double, price_to_revenue double,
    ev double, ebitda double, revenue_annual double, net_income_annual double,
    roe_pct double, gross_margin_pct double, dividend_yield_pct double,
    dividend_per_share double, eps_basic double, revenue_per_share double,
    book_value_per_share double, cash_per_share double, cash_flow_per_share double,
    target_price double, proj_pe double, proj_eps double, proj_eps_q double,
    proj_sales double, proj_sales_q double, proj_profit double, proj_dps double,
    proj_lt_growth double, recommendation_score double,
    xml_52w_low double, xml_52w_high double, xml_last_price double,
    xml_vol_10d_avg double, xml_last_price_date date,
    co_status string, co_type string, latest_annual_date date, latest_interim_date date,
    employees int, shares_out double, shares_out_date date, total_float double,
    reporting_currency string, most_recent_exch_date date, most_recent_exch_val double,
    industry_trbc string, industry_trbc_code string, industry_naics string,
    industry_naics_code string, industry_sic string, industry_sic_code string,
    address string, city string, postal_code string, country_code string,
    phone string, website string, email string,
    business_summary string, financial_summary string,
    officer_1_name string, officer_1_title string,
    officer_2_name string, officer_2_title string,
    officer_3_name string, officer_3_title string,
    officer_4_name string, officer_4_title string,
    officer_5_name string, officer_5_title string,
    officers_json string,
    price_currency string, last_fundamental_update timestamp_ntz
    """
)

DIRECTORY = (
    "ticker string, company_name string, summary string, currency string, sector string, "
    "industry_group string, industry string, exchange string, market string, country string, "
    "state string, city string, zipcode string, website string, market_cap_category string, "
    "isin string, cusip string, figi string, composite_figi string, shareclass_figi string"
)

FUNDAMENTALS_CACHE = (
    "ticker string, symbol string, exchange string, market_cap_usd bigint, sector string, "
    "industry string, currency string, country string, last_updated timestamp_ntz, "
    "data_source string, is_active boolean, metadata string"
)

CACHE_ENTRIES = (
    "cache_key string, data string, timestamp timestamp_ntz, data_type string"
)

CATCHES = (
    "timestamp timestamp_ntz, ticker string, price double, volume bigint, usd_mcap double, "
    "pct_from_low double, reason string"
)

CLEANUP_LOG = (
    "exchange string, total_processed bigint, valid_count bigint, invalid_count bigint, "
    "cleaned_at timestamp_ntz, notes string"
)

TABLES = {
    "tickers": TICKERS,
    "prices_daily": PRICES_DAILY,
    "raw_quotes": RAW_QUOTES,
    "current_market_data": CURRENT_MARKET_DATA,
    "raw_company_xml": RAW_COMPANY_XML,
    "stock_fundamentals": STOCK_FUNDAMENTALS,
    "directory": DIRECTORY,
    "fundamentals_cache": FUNDAMENTALS_CACHE,
    "cache_entries": CACHE_ENTRIES,
    "catches": CATCHES,
    "cleanup_log": CLEANUP_LOG,
}


def column_names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


# --- table lifecycle ----------------------------------------------------------------------


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def create_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Create the missing tables as empty Parquet folders under ``root``."""
    for name in names or TABLES:
        empty(spark, name).write.mode("ignore").parquet(f"{root}/{name}")


def truncate_table(spark: SparkSession, root: str, name: str) -> None:
    """Replace the content of a table by no rows, keeping its schema."""
    empty(spark, name).write.mode("overwrite").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def register(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Expose the tables to ``spark.sql`` for parameterised ad-hoc queries."""
    for name in names or TABLES:
        read_table(spark, root, name).createOrReplaceTempView(name)
