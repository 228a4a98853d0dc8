"""The benchmark's Parquet tables seen as the tables of this package.

Every adapter derives its rows from the whole table; missing values, inactive listings and
malformed documents follow from the data itself (balances, event types).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions.lookup import lookup
from lowtide.operators.bars import daily_bars
from lowtide.session import spread

# --- fixed values -------------------------------------------------------------------------

LAST_DAY = "2001-11-04"
UNIVERSE_TIME = "2001-11-05 00:00:00"
EVENTS_TIME = "2024-02-01 00:00:00"
PRICE_TICKS = 10_000.0
#: a document is made and parsed within one task, about a millisecond each
DOCUMENTS_A_TASK = 10_000

CAP_CATEGORY_BY_TYPE = {
    "ECONOMY": "Nano Cap",
    "SMALL": "Micro Cap",
    "STANDARD": "Small Cap",
    "MEDIUM": "Mid Cap",
    "LARGE": "Large Cap",
}

# --- helpers ---------------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(values: list, position: Column) -> Column:
    return lookup({i: v for i, v in enumerate(values) if v is not None}, position.cast("int"))


def _cents(amount: str) -> Column:
    return F.floor(F.col(amount) * 100 + 0.5)


def _exchange(key: Column) -> Column:
    return _at([row[0] for row in dims.EXCHANGES], key % len(dims.EXCHANGES))


def _ticker(prefix: str, key: Column) -> Column:
    ending = _at([row[4] for row in dims.EXCHANGES], key % len(dims.EXCHANGES))
    return F.concat(F.lit(prefix), key.cast("string"), ending)


# --- bars ---------------------------------------------------------------------------------------


def _sequence() -> Column:
    """(order key, line number, part key, tick) as one integer of up to 38 digits."""
    high = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(18,0)")
    low = (F.col("l_partkey") * (1 << 27) + F.col("tick")).cast("decimal(19,0)")
    return (high * F.lit("1" + "0" * 19).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        F.col("l_shipdate").cast("date").alias("price_date"),
        _cents("l_extendedprice").alias("tick"),
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    return rows.withColumn("seq", _sequence())


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: price = extended price / 100, volume = quantity * 1000."""
    daily = daily_bars(
        trades(spark, sf_dir),
        ["l_suppkey"],
        "tick",
        F.col("l_quantity") * 1000,
        ["seq"],
    )
    price = lambda c: (F.col(c) / F.lit(PRICE_TICKS)).alias(c)
    return daily.select(
        _ticker("S", F.col("l_suppkey")).alias("ticker"),
        "price_date",
        *[price(c) for c in ("open", "high", "low", "close")],
        "volume",
    )


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide daily prices with columns ``A|Open`` … for every return flag that occurs."""
    # a line may occur once per supplier, so the supplier takes part in the order
    daily = daily_bars(
        trades(spark, sf_dir),
        ["l_returnflag"],
        "tick",
        F.col("l_quantity") * 1000,
        ["seq", "l_suppkey"],
    )
    prices = [
        F.max(F.col(name) / F.lit(PRICE_TICKS)).alias(name.title()) for name in ("open", "high", "low", "close")
    ]
    wide = (
        daily.groupBy(F.col("price_date").alias("Date"))
        .pivot("l_returnflag")
        .agg(*prices, F.max("volume").alias("Volume"))
    )
    return wide.toDF(*["|".join(c.rsplit("_", 1)) for c in wide.columns])


# --- universe and fundamentals ----------------------------------------------------------------------


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as listed companies."""
    suppliers = load(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"),
        _ticker("S", F.col("s_suppkey")).alias("ticker"),
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        F.lit(None).cast("string").alias("segment"),
    )
    customers = load(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"),
        _ticker("C", F.col("c_custkey")).alias("ticker"),
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return suppliers.unionByName(customers).withColumn("exchange", _exchange(F.col("key")))


def _last_updated() -> Column:
    days = F.floor(F.abs("balance") / 25).cast("int")
    return F.lit(UNIVERSE_TIME).cast("timestamp_ntz") - F.make_dt_interval(days=days)


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("balance")
    return listings(spark, sf_dir).select(
        "ticker",
        F.col("exchange").alias("market"),
        F.when(balance < 0, "INACTIVE")
        .when(balance < 500, None)
        .when(balance >= 8000, "INACTIVE")
        .otherwise("ACTIVE")
        .alias("status"),
        F.when(balance < 0, "negative balance").alias("status_message"),
        _last_updated().alias("last_updated"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a balance; debtors have no fundamentals."""
    balance = F.col("balance")
    cap = F.round(balance * 100).cast("bigint") * 1000
    return (
        listings(spark, sf_dir)
        .filter(balance >= 0)
        .select(
            "ticker",
            F.concat(F.upper(F.left("kind", F.lit(1))), F.col("key").cast("string")).alias("symbol"),
            F.when(~balance.between(9000, 9500), F.col("name")).alias("company_name"),
            "exchange",
            cap.alias("market_cap_usd"),
            cap.cast("double").alias("mkt_cap_usd"),
            F.col("segment").alias("sector"),
            F.concat(F.lit("Industry "), F.col("nation").cast("string")).alias("industry"),
            lookup(dims.CURRENCY_BY_EXCHANGE, F.col("exchange")).alias("currency"),
            F.concat(F.lit("NATION_"), F.col("nation").cast("string")).alias("country"),
            _last_updated().alias("last_updated"),
            F.col("kind").alias("data_source"),
            (balance >= 500).alias("is_active"),
            F.round(balance / 9 - 50, 2).alias("pe_ratio"),
            F.round(balance / 4000, 2).alias("debt_to_equity"),
            F.round(balance / 5000, 2).alias("current_ratio"),
            F.when(balance < 7000, F.round(balance / 50 + 1, 2)).alias("xml_52w_low"),
            F.round(balance / 10 + 5, 2).alias("xml_52w_high"),
        )
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as directory listings over the twelve universe markets."""
    market = F.col("p_partkey") % len(dims.UNIVERSE_MARKETS)
    pick = lambda i: _at([row[i] for row in dims.UNIVERSE_MARKETS], market)
    bare = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return load(spark, sf_dir, "part").select(
        F.when(F.col("p_size") > 25, F.concat(bare, pick(3))).otherwise(bare).alias("ticker"),
        F.col("p_name").alias("company_name"),
        F.concat_ws(", ", "p_name", "p_type", "p_brand").alias("summary"),
        lookup(dims.CURRENCY_BY_EXCHANGE, pick(2)).alias("currency"),
        F.col("p_brand").alias("sector"),
        pick(1).alias("exchange"),
        pick(2).alias("market"),
        lookup(CAP_CATEGORY_BY_TYPE, F.col("p_type")).alias("market_cap_category"),
        "p_partkey",
        "p_size",
        "p_retailprice",
    )


# --- quotes and logs ---------------------------------------------------------------------------------


def _events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "event_type",
        "user_id",
        "ts",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        _cents("value").alias("cents"),
        _ticker("C", F.col("user_id")).alias("ticker"),
    )


def raw_quotes_of(events: DataFrame) -> DataFrame:
    """Quote documents, flat for even events and nested for odd ones.

    Sign-ups carry no document, clicks no last price, errors no close; a view of an NSE
    ticker doubles its suffix.
    """
    e = _events(events)
    cents = lambda steps: (F.col("cents") + F.col("k") * steps) / F.lit(100.0)
    kind = F.col("event_type")
    body = F.struct(
        F.when(kind != "click", cents(0)).alias("last"),
        F.when(kind != "error", cents(1)).alias("close"),
        cents(2).alias("open"),
        cents(3).alias("high"),
        cents(-1).alias("low"),
        (F.col("k") * 1000).alias("volume"),
    )
    flat = F.col("event_id") % 2 == 0
    document = F.when(flat, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("Ticker"))))
    doubled = (kind == "view") & F.col("ticker").endswith(".NS")
    return e.select(
        F.when(doubled, F.concat("ticker", F.lit(".NS"))).otherwise(F.col("ticker")).alias("ticker"),
        F.when(kind != "signup", document).alias("market_data"),
        F.when(flat & (kind != "click"), cents(0)).alias("last_price"),
        F.when(flat, F.col("k") * 1000).alias("volume"),
        F.col("ts").alias("last_updated"),
        "event_id",
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_quotes_of(load(spark, sf_dir, "events"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("cache_key"),
        F.col("props").alias("data"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("data_type"),
        "event_id",
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as vendor failures."""
    k = F.col("k")
    return (
        _events(load(spark, sf_dir, "events"))
        .filter(F.col("event_type") == "error")
        .select(
            "event_id",
            "ticker",
            F.when(k < 25, "HTTP Error 404: page missing")
            .when(k < 50, "Possibly Delisted; no price data")
            .when(k < 60, "No data found for this date range")
            .otherwise("Read timed out")
            .alias("message"),
            F.when(k < 30, 200).when(k < 50, 354).when(k < 70, 502).when(k < 90, 504).otherwise(999)
            .cast("bigint")
            .alias("error_code"),
            (k % 5).alias("retry_count"),
        )
    )


def decisions(spark: SparkSession, sf_dir: str, criteria_version: str) -> DataFrame:
    """Events as earlier screening decisions per user ticker."""
    return _events(load(spark, sf_dir, "events")).select(
        F.md5(F.concat_ws("|", "ticker", F.lit("filtering"), F.lit(criteria_version))).alias("cache_key"),
        (F.col("k") < 50).alias("should_skip"),
        F.concat(F.lit("k="), F.col("k").cast("string")).alias("reason"),
        F.col("ts").alias("timestamp"),
    )


# --- documents -----------------------------------------------------------------------------------------


def directory_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as directory documents: keyed by ticker for large sizes, direct otherwise."""
    d = directory(spark, sf_dir)
    body = F.concat(
        F.lit("{"),
        *[
            piece
            for name, value in (
                ("name", "company_name"),
                ("summary", "summary"),
                ("sector", "sector"),
                ("exchange", "exchange"),
                ("market_cap", "market_cap_category"),
            )
            for piece in (
                F.lit(f'"{name}": '),
                F.coalesce(F.concat(F.lit('"'), F.col(value), F.lit('"')), F.lit("NaN")),
                F.lit(", "),
            )
        ],
        F.lit('"state": NaN, "city": " ", "website": "http://example.com/'),
        F.col("p_partkey").cast("string"),
        F.lit('"}'),
    )
    keyed = F.concat(F.lit('{"'), F.col("ticker"), F.lit('": '), body, F.lit("}"))
    return d.select("ticker", F.when(F.col("p_size") > 25, keyed).otherwise(body).alias("raw_data"))


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as info documents; those under 1000 state no market cap."""
    balance = F.col("balance")
    info = F.struct(
        F.when(balance >= 1000, F.round(balance * 100).cast("bigint") * 1000).alias("marketCap"),
        F.col("segment").alias("sector"),
        F.concat(F.lit("Industry "), F.col("nation").cast("string")).alias("industry"),
        F.when(balance < 6000, F.lit("EUR")).alias("currency"),
    )
    return listings(spark, sf_dir).select("ticker", F.to_json(info).alias("info"))


# company snapshot of the vendor's form with invented values; {placeholders} are filled from one listing
COMPANY_TEMPLATE = """<?xml version="1.0" encoding="UTF-8"?>
<ReportSnapshot Major="1">
<CoIDs><CoID Type="RepNo">R{key}</CoID><CoID Type="CompanyName">{stated_name}</CoID>\
<CoID Type="OrganizationPermID">{perm_id}</CoID></CoIDs>
<Issues><Issue ID="1" Type="C"><IssueID Type="Name">Voting</IssueID><IssueID Type="ISIN">{isin}</IssueID>\
<IssueID Type="RIC">{ticker}</IssueID><Exchange Code="{exchange}" Country="{country}">listed</Exchange>{split}</Issue>
<Issue ID="2" Type="P"><IssueID Type="Name">Nonvoting</IssueID><Exchange Code="XQQ" Country="QQQ">also listed</Exchange></Issue></Issues>
<CoGeneralInfo><CoStatus Code="7">Trading</CoStatus><CoType Code="SHR">Share Company</CoType>\
<LatestAvailableAnnual>2000-12-29</LatestAvailableAnnual><Employees LastUpdated="2000-11-17">{employees}</Employees>\
<SharesOut Date="2001-06-08" TotalFloat="{total_float}">{shares}</SharesOut><ReportingCurrency Code="USD">x</ReportingCurrency>\
<MostRecentExchange Date="2001-10-19">1.3125</MostRecentExchange></CoGeneralInfo>
<TextInfo><Text Type="Business Summary">{segment} company of {name}</Text><Text Type="Financial Summary">Short &amp; simple</Text></TextInfo>
<contactInfo><streetAddress line="1">{key} Main Street</streetAddress><streetAddress line="2"></streetAddress>\
<streetAddress line="3">{floor}</streetAddress><city>CITY {nation}</city><postalCode>{postal_code}</postalCode>\
<country code="{country}">Country</country><phone><phone type="mainphone"><countryPhoneCode>99</countryPhoneCode>\
<city-areacode>77</city-areacode><number>{key}</number></phone><phone type="mainfax"><countryPhoneCode>99</countryPhoneCode>\
<city-areacode>77</city-areacode><number>0</number></phone></phone></contactInfo>
<webLinks><webSite mainCategory="Home Page">https://example.com/{key}</webSite><eMail mainCategory="Contact">ir{key}@example.com</eMail></webLinks>
<peerInfo><IndustryInfo><Industry type="TRBC" order="1" code="81A">{segment}</Industry><Industry type="TRBC" order="2" code="81B">{segment} last</Industry>\
<Industry type="NAICS" order="1" code="700100">Weaving</Industry><Industry type="NAICS" order="2" code="700200">Dyeing</Industry>\
<Industry type="SIC" order="1" code="7700">Textiles</Industry></IndustryInfo></peerInfo>
<officers><officer rank="1"><firstName>Ann</firstName><lastName>No{key}</lastName><title startYear="1996">Chair</title></officer>\
<officer rank="2"><firstName>Bo</firstName><lastName>Li</lastName><title startYear="1996">Director</title></officer>{third_officer}</officers>
<Ratios{price_currency} ExchangeRate="1.0"><Group ID="Price and Volume"><Ratio FieldName="NPRICE" Type="N">{price}</Ratio>\
<Ratio FieldName="NHIG" Type="N">{high}</Ratio><Ratio FieldName="NLOW" Type="N">{low}</Ratio><Ratio FieldName="PDATE" Type="N">2001-10-22T00:00:00</Ratio>\
<Ratio FieldName="VOL10DAVG" Type="N">10.5</Ratio></Group><Group ID="Income Statement"><Ratio FieldName="MKTCAP" Type="N">{cap}</Ratio>\
<Ratio FieldName="APEEXCLXOR" Type="N">{pe}</Ratio><Ratio FieldName="AREV" Type="N"> </Ratio></Group></Ratios>
<ForecastData><Ratio FieldName="TargetPrice" Type="N"><Value PeriodType="CURR">{target}</Value></Ratio>\
<Ratio FieldName="ProjPE" Type="N"><Value PeriodType="CURR">{proj_pe}</Value></Ratio><Ratio FieldName="ConsRecom" Type="N"><Mean>1.75</Mean></Ratio></ForecastData>
</ReportSnapshot>"""


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Fill {placeholders} of a template in one formatting call."""
    names = re.findall(r"{(\w+)}", template)
    pattern = re.sub(r"{\w+}", "%s", template.replace("%", "%%"))
    return F.format_string(pattern, *[values[name].cast("string") for name in names])


def company_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as company snapshots; the deepest debtors have an empty ``{}`` document, others lack
    their name, market cap or price-earnings ratio."""
    companies = spread(listings(spark, sf_dir), "ticker", DOCUMENTS_A_TASK)
    key, balance = F.col("key"), F.col("balance")
    text = lambda condition, given, other="": F.when(condition, given).otherwise(other)
    third = (
        '<officer rank="3"><firstName>Cy</firstName><lastName></lastName>'
        '<title startYear="1996">Secretary</title></officer>'
    )
    values = {
        "key": key,
        "name": F.col("name"),
        "stated_name": text(balance.between(4000, 4200), "", F.col("name")),
        "ticker": F.col("ticker"),
        "exchange": F.col("exchange"),
        "segment": F.coalesce("segment", F.lit("SUPPLY")),
        "nation": F.col("nation"),
        "perm_id": key + F.lit(7700000000),
        "isin": F.concat(F.lit("QQ"), F.lpad(key.cast("string"), 10, "0")),
        "country": F.concat(F.lit("N"), F.col("nation").cast("string")),
        "split": text(balance > 5000, '<MostRecentSplit Date="1999-04-06">3.0</MostRecentSplit>'),
        "employees": key * 3 + 1,
        "shares": key * 1000 + 0.5,
        "total_float": key * 900,
        "floor": text(balance > 2000, "Floor 3"),
        "postal_code": F.lpad(key.cast("string"), 6, "0"),
        "third_officer": text(balance > 3000, third),
        "price_currency": text(balance >= 1000, ' PriceCurrency="INR"'),
        "price": balance,
        "high": F.round(balance + 100.25, 2),
        "low": F.round(balance - 100.25, 2),
        "cap": text(balance.between(4300, 4500), "n/a", (key * 7 + 100).cast("string")),
        "pe": text(balance > 1500, F.round(balance / 100, 4).cast("string"), "n/a"),
        "target": F.round(balance + 10, 2),
        "proj_pe": text(balance < 2000, "-99999.99000", "22.5"),
    }
    return companies.select(
        "ticker",
        F.when(balance < -900, F.lit("{}")).otherwise(_fill(COMPANY_TEMPLATE, values)).alias("xml_snapshot"),
        F.lit(UNIVERSE_TIME).cast("timestamp_ntz").alias("last_updated"),
    )
