"""Flattening of company XML snapshots into the fundamentals table.

``from_xml`` with an explicit schema parses every document once, in the JVM; a malformed
or empty document gives a row of NULLs, which is how the quarantine recognises it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide import dims, schemas
from lowtide.functions import symbols
from lowtide.functions.lookup import lookup
from lowtide.functions.values import clean_forecast, clean_number

# --- fixed values: vendor codes -> columns ---------------------------------------------------

RATIO_CODES = {
    "MKTCAP": "mkt_cap_local_mn",
    "APEEXCLXOR": "pe_ratio",
    "APRICE2BK": "price_to_book",
    "APR2REV": "price_to_revenue",
    "EV": "ev",
    "AEBITD": "ebitda",
    "AREV": "revenue_annual",
    "ANIAC": "net_income_annual",
    "AROEPCT": "roe_pct",
    "AGROSMGN": "gross_margin_pct",
    "ADIVYIELD": "dividend_yield_pct",
    "ADIVSHR": "dividend_per_share",
    "AEPSXCLXOR": "eps_basic",
    "AREVPS": "revenue_per_share",
    "ABVPS": "book_value_per_share",
    "ACSHPS": "cash_per_share",
    "ACFSHR": "cash_flow_per_share",
    "NLOW": "xml_52w_low",
    "NHIG": "xml_52w_high",
    "NPRICE": "xml_last_price",
    "VOL10DAVG": "xml_vol_10d_avg",
    "PDATE": "xml_last_price_date",
}

FORECAST_CODES = {
    "TargetPrice": "target_price",
    "ProjPE": "proj_pe",
    "ProjEPS": "proj_eps",
    "ProjEPSQ": "proj_eps_q",
    "ProjSales": "proj_sales",
    "ProjSalesQ": "proj_sales_q",
    "ProjProfit": "proj_profit",
    "ProjDPS": "proj_dps",
    "ProjLTGrowthRate": "proj_lt_growth",
    "ConsRecom": "recommendation_score",
}

SNAPSHOT = """
    CoIDs struct<CoID: array<struct<_Type: string, _VALUE: string>>>,
    Issues struct<Issue: array<struct<
        _ID: string, _Type: string,
        IssueID: array<struct<_Type: string, _VALUE: string>>,
        Exchange: array<struct<_Code: string, _Country: string, _VALUE: string>>,
        MostRecentSplit: array<struct<_Date: string, _VALUE: string>>>>>,
    CoGeneralInfo struct<
        CoStatus: array<struct<_Code: string, _VALUE: string>>,
        CoType: array<struct<_Code: string, _VALUE: string>>,
        LatestAvailableAnnual: array<string>,
        LatestAvailableInterim: array<string>,
        Employees: array<struct<_LastUpdated: string, _VALUE: string>>,
        SharesOut: array<struct<_Date: string, _TotalFloat: string, _VALUE: string>>,
        ReportingCurrency: array<struct<_Code: string, _VALUE: string>>,
        MostRecentExchange: array<struct<_Date: string, _VALUE: string>>>,
    TextInfo struct<Text: array<struct<_Type: string, _VALUE: string>>>,
    contactInfo struct<
        streetAddress: array<struct<_line: string, _VALUE: string>>,
        city: array<string>,
        postalCode: array<string>,
        country: array<struct<_code: string, _VALUE: string>>,
        phone: struct<phone: array<struct<
            _type: string, countryPhoneCode: string, `city-areacode`: string, number: string>>>>,
    webLinks struct<
        webSite: array<struct<_mainCategory: string, _VALUE: string>>,
        eMail: array<struct<_mainCategory: string, _VALUE: string>>>,
    peerInfo struct<IndustryInfo: struct<Industry: array<struct<
        _type: string, _order: string, _code: string, _VALUE: string>>>>,
    officers struct<officer: array<struct<
        firstName: string, lastName: string,
        title: struct<_startYear: string, _VALUE: string>>>>,
    Ratios struct<
        _PriceCurrency: string,
        Group: array<struct<_ID: string, Ratio: array<struct<_FieldName: string, _VALUE: string>>>>>,
    ForecastData struct<Ratio: array<struct<
        _FieldName: string,
        Value: array<struct<_PeriodType: string, _VALUE: string>>,
        Mean: string>>>
"""

#: what a document gives: the columns of the fundamentals table, but the cap as it is stated
_FLAT = schemas.STOCK_FUNDAMENTALS.replace("mkt_cap_usd", "mkt_cap_local_mn")
FLAT_COLUMNS = schemas.column_names(_FLAT)

# --- picking ------------------------------------------------------------------------------


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _text(value: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(value), F.lit(""))


def _typed(items: Column, attribute: str, wanted: str) -> Column:
    return F.filter(items, lambda x: x[attribute] == wanted)


def _by_code(items: Column, code: str) -> Column:
    """The last element with the given field name (later ones overwrite earlier ones)."""
    return _last(_typed(items, "_FieldName", code))


def _day(text: Column) -> Column:
    return F.left(text, F.lit(10)).try_cast("date")


# --- flattening -----------------------------------------------------------------------------


def parse_snapshots(raw: DataFrame, doc: str = "xml_snapshot") -> DataFrame:
    """Add the parsed document as ``_x`` and whether it is usable as ``_ok``.

    The parsed value comes out of a one-element array.  A filter on it therefore stays above
    the parser; it would otherwise be pushed down with a copy of the parser in each term.
    """
    parser = F.from_xml(F.col(doc), SNAPSHOT, {"rowTag": "ReportSnapshot"})
    parsed = raw.filter(F.col(doc).isNotNull()).select("*", F.explode(F.array(parser)).alias("_x"))
    present = [F.col(f"_x.{name}").isNotNull() for name in ("CoIDs", "Issues", "CoGeneralInfo", "Ratios")]
    return parsed.withColumn("_ok", present[0] | present[1] | present[2] | present[3])


def _intermediates() -> dict[str, Column]:
    """Parts of a document that several columns read, each evaluated once per document."""
    issues = F.col("_x.Issues.Issue")

    def first_issue_part(name: str) -> Column:
        given = F.filter(F.transform(issues, lambda i: i[name]), lambda part: part.isNotNull())
        return _first(F.flatten(given))

    return {
        "_ids": _trimmed(F.col("_x.CoIDs.CoID")),
        "_issue_ids": _trimmed(
            F.flatten(F.transform(issues, lambda i: F.coalesce(i["IssueID"], F.array())))
        ),
        "_exchange": first_issue_part("Exchange"),
        "_split": first_issue_part("MostRecentSplit"),
        "_shares": _first(F.col("_x.CoGeneralInfo.SharesOut")),
        "_rate": _first(F.col("_x.CoGeneralInfo.MostRecentExchange")),
        "_main_phone": _first(_typed(F.col("_x.contactInfo.phone.phone"), "_type", "mainphone")),
        "_any_phone": _first(F.col("_x.contactInfo.phone.phone")),
        "_trbc": _last(_industries("TRBC")),
        "_naics": _last(F.filter(_industries("NAICS"), lambda x: x["_order"] == "1")),
        "_sic": _last(F.filter(_industries("SIC"), lambda x: x["_order"] == "1")),
        "_officers": F.transform(
            F.coalesce(F.col("_x.officers.officer"), F.array()),
            lambda o: F.struct(
                F.trim(
                    F.concat(
                        F.coalesce(o["firstName"], F.lit("")),
                        F.lit(" "),
                        F.coalesce(o["lastName"], F.lit("")),
                    )
                ).alias("n"),
                F.coalesce(o["title"]["_VALUE"], F.lit("")).alias("t"),
            ),
        ),
        "_ratios": F.transform(
            F.flatten(
                F.transform(F.col("_x.Ratios.Group"), lambda g: F.coalesce(g["Ratio"], F.array()))
            ),
            lambda r: F.struct(
                r["_FieldName"].alias("_FieldName"),
                r["_VALUE"].alias("_VALUE"),
                clean_number(r["_VALUE"]).alias("number"),
            ),
        ),
        "_forecasts": F.transform(
            F.col("_x.ForecastData.Ratio"),
            lambda r: F.struct(
                r["_FieldName"].alias("_FieldName"),
                clean_forecast(clean_number(_forecast_text(r))).alias("number"),
            ),
        ),
    }


def _trimmed(items: Column) -> Column:
    return F.transform(
        items, lambda x: F.struct(x["_Type"].alias("_Type"), _text(x["_VALUE"]).alias("_VALUE"))
    )


def _industries(kind: str) -> Column:
    return _typed(F.col("_x.peerInfo.IndustryInfo.Industry"), "_type", kind)


def _forecast_text(ratio: Column) -> Column:
    """The current value if there is such a node (even a blank one), else the mean."""
    current = _first(_typed(ratio["Value"], "_PeriodType", "CURR"))
    return F.when(current.isNotNull(), current["_VALUE"]).otherwise(ratio["Mean"])


def _columns() -> dict[str, Column]:
    """All fundamentals columns, from the parsed document and the intermediates."""
    part = F.col
    info = "_x.CoGeneralInfo."
    named = lambda items, kind: _first(_typed(part(items), "_Type", kind))["_VALUE"]
    plain = lambda path: _text(_first(part(path))["_VALUE"])
    phone = F.concat_ws(
        " ",
        F.concat(F.lit("+"), F.coalesce(_text(part("_any_phone.countryPhoneCode")), F.lit(""))),
        F.coalesce(_text(part("_any_phone.city-areacode")), F.lit("")),
        F.coalesce(_text(part("_any_phone.number")), F.lit("")),
    )
    lines = [
        _text(_first(_typed(part("_x.contactInfo.streetAddress"), "_line", str(i)))["_VALUE"])
        for i in (1, 2, 3)
    ]
    out: dict[str, Column] = {
        "company_name": named("_ids", "CompanyName"),
        "rep_no": named("_ids", "RepNo"),
        "org_perm_id": named("_ids", "OrganizationPermID"),
        "isin": named("_issue_ids", "ISIN"),
        "ric": named("_issue_ids", "RIC"),
        "exchange_code": part("_exchange._Code"),
        "exchange_country": part("_exchange._Country"),
        "most_recent_split_date": _day(part("_split._Date")),
        "most_recent_split_factor": clean_number(part("_split._VALUE")),
        "co_status": plain(info + "CoStatus"),
        "co_type": plain(info + "CoType"),
        "latest_annual_date": _day(_first(part(info + "LatestAvailableAnnual"))),
        "latest_interim_date": _day(_first(part(info + "LatestAvailableInterim"))),
        "employees": clean_number(plain(info + "Employees")).cast("int"),
        "shares_out": clean_number(part("_shares._VALUE")),
        "shares_out_date": _day(part("_shares._Date")),
        "total_float": clean_number(part("_shares._TotalFloat")),
        "reporting_currency": _first(part(info + "ReportingCurrency"))["_Code"],
        "most_recent_exch_date": _day(part("_rate._Date")),
        "most_recent_exch_val": clean_number(part("_rate._VALUE")),
        "address": _text(F.concat_ws(", ", *lines)),
        "city": _text(_first(part("_x.contactInfo.city"))),
        "postal_code": _text(_first(part("_x.contactInfo.postalCode"))),
        "country_code": _first(part("_x.contactInfo.country"))["_code"],
        "phone": F.when(part("_main_phone").isNotNull(), F.trim(phone)),
        "website": plain("_x.webLinks.webSite"),
        "email": plain("_x.webLinks.eMail"),
        "business_summary": _last(_typed(part("_x.TextInfo.Text"), "_Type", "Business Summary"))["_VALUE"],
        "financial_summary": _last(_typed(part("_x.TextInfo.Text"), "_Type", "Financial Summary"))["_VALUE"],
        "officers_json": F.to_json("_officers"),
        "price_currency": F.coalesce(
            _text(part("_x.Ratios._PriceCurrency")),
            lookup(dims.CURRENCY_BY_EXCHANGE, symbols.exchange_of(part("ticker"))),
        ),
    }
    for kind in ("trbc", "naics", "sic"):
        out[f"industry_{kind}"] = part(f"_{kind}._VALUE")
        out[f"industry_{kind}_code"] = part(f"_{kind}._code")
    for i in range(1, 6):
        officer = F.get("_officers", i - 1)
        out[f"officer_{i}_name"] = officer["n"]
        out[f"officer_{i}_title"] = officer["t"]
    for code, column in RATIO_CODES.items():
        ratio = _by_code(part("_ratios"), code)
        out[column] = _day(ratio["_VALUE"]) if code == "PDATE" else ratio["number"]
    for code, column in FORECAST_CODES.items():
        out[column] = _by_code(part("_forecasts"), code)["number"]
    return out


def flatten_snapshots(raw: DataFrame, suffix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots -> (fundamentals rows, quarantined documents), optionally of one suffix.

    ``mkt_cap_local_mn`` holds what the document states, millions of local currency; ``in_dollars``
    turns the rows into those of the fundamentals table.
    """
    scope = raw if suffix is None else raw.filter(F.col("ticker").endswith(suffix))
    parsed = parse_snapshots(scope)
    values = _columns()
    wanted = [
        values[name].alias(name) for name in FLAT_COLUMNS if name not in ("ticker", "last_fundamental_update")
    ]
    good = parsed.filter("_ok").withColumns(_intermediates()).select(
        "ticker", *wanted, F.col("last_updated").alias("last_fundamental_update")
    )
    bad = parsed.filter(~F.col("_ok")).select("ticker", "xml_snapshot", "last_updated")
    return good, bad


def flatten_all(raw: DataFrame, suffix: str | None = None) -> DataFrame:
    """All documents in one frame, parsed once: the fundamentals columns, ``ok``, and the document
    itself where it could not be flattened."""
    scope = raw if suffix is None else raw.filter(F.col("ticker").endswith(suffix))
    values = _columns()
    wanted = [
        values[name].alias(name) for name in FLAT_COLUMNS if name not in ("ticker", "last_fundamental_update")
    ]
    return parse_snapshots(scope).withColumns(_intermediates()).select(
        "ticker",
        *wanted,
        F.col("last_updated").alias("last_fundamental_update"),
        F.when(~F.col("_ok"), F.col("xml_snapshot")).alias("xml_snapshot"),
        F.col("_ok").alias("ok"),
    )


def write_snapshots(raw: DataFrame, folder: str, suffix: str | None = None) -> None:
    """Flatten every document once into a table that is partitioned by its status."""
    flatten_all(raw, suffix).write.mode("overwrite").partitionBy("ok").parquet(folder)


def read_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(fundamentals rows, quarantined documents) of a written table, each from its own files."""
    ddl = _FLAT + ", xml_snapshot string, ok boolean"
    both = spark.read.schema(ddl).parquet(folder)
    good = both.filter("ok").drop("ok", "xml_snapshot")
    bad = both.filter("NOT ok").select(
        "ticker", "xml_snapshot", F.col("last_fundamental_update").alias("last_updated")
    )
    return good, bad


def flatten_counts(raw: DataFrame) -> DataFrame:
    """How many documents were flattened and how many were skipped."""
    return parse_snapshots(raw).agg(
        F.count_if("_ok").alias("upserted"), F.count_if(~F.col("_ok")).alias("errors")
    )


def usd_market_cap(fundamentals: DataFrame, fx: DataFrame) -> DataFrame:
    """Whole-dollar market cap from millions of local currency; flags a missing rate."""
    return (
        fundamentals.join(
            fx.withColumnRenamed("currency", "price_currency"), "price_currency", "left"
        )
        .withColumn("fx_missing", F.col("usd_rate").isNull())
        .withColumn(
            "usd_mcap", F.col("mkt_cap_local_mn") * 1e6 * F.coalesce("usd_rate", F.lit(1.0))
        )
        .drop("usd_rate")
    )


def in_dollars(fundamentals: DataFrame, fx: DataFrame) -> DataFrame:
    """Flattened documents as rows of the fundamentals table, whose cap is in whole dollars."""
    return usd_market_cap(fundamentals, fx).select(
        *[
            F.col("usd_mcap" if name == "mkt_cap_usd" else name).alias(name)
            for name in schemas.column_names(schemas.STOCK_FUNDAMENTALS)
        ]
    )


def required_fields(raw: DataFrame) -> DataFrame:
    """Per document: is it well-formed, does it state the three required values, and which are missing?

    A company document must give its name, its market cap and its price-earnings ratio."""
    x = parse_snapshots(raw).withColumns({k: v for k, v in _intermediates().items() if k in ("_ids", "_ratios")})
    values = {
        "name": _first(_typed(F.col("_ids"), "_Type", "CompanyName"))["_VALUE"],
        "market_cap": _by_code(F.col("_ratios"), "MKTCAP")["number"],
        "pe_ratio": _by_code(F.col("_ratios"), "APEEXCLXOR")["number"],
    }
    return x.select(
        "ticker",
        F.coalesce("_ok", F.lit(False)).alias("well_formed"),
        *[v.isNotNull().alias(f"has_{name}") for name, v in values.items()],
        F.concat_ws(",", *[F.when(v.isNull(), F.lit(name)) for name, v in values.items()]).alias("missing"),
    )


def ratio_tags(raw: DataFrame, order: str = "ticker", doc: str = "xml_snapshot") -> DataFrame:
    """First value of each ratio tag over all documents, found by pattern."""
    pattern = r'Ratio FieldName="(.*?)" Type="(\w)">(.*?)</Ratio>'
    parts = F.arrays_zip(
        *[
            F.regexp_extract_all(F.col(doc), F.lit(pattern), F.lit(i)).alias(name)
            for i, name in ((1, "tag"), (3, "value"))
        ]
    )
    # posexplode keeps the order within a document for tags that repeat there
    tags = raw.select(order, F.posexplode(parts).alias("pos", "part"))
    return tags.groupBy(F.col("part.tag").alias("tag")).agg(
        F.min_by(F.col("part.value"), F.struct(order, "pos")).alias("value"),
        F.count("*").alias("occurrences"),
    )
