"""JSON and XML flattening and document discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks.base import query, sql, values_cte
from lowtide.operators.indicators import latest_per_key
from lowtide.operators.merge import guarded_upsert
from lowtide.session import run_folder
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import discovery, json_docs, xml_docs
from lowtide.sources.tables import parameterised_query

QUOTE_COLUMNS = "ticker, last_price, close_price, open_price, high_price, low_price, volume, last_updated"


@query(
    "directory_flatten",
    "D-12 S-3 F-14",
    sql(
        "directory",
        """SELECT ticker, company_name, summary, sector, exchange, market_cap_category,
                  CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS city,
                  'http://example.com/' || p_partkey AS website
           FROM directory""",
    ),
)
def directory_flatten(spark, sf):
    return json_docs.flatten_directory(tables.directory_json(spark, sf)).select(
        "ticker", "company_name", "summary", "sector", "exchange", "market_cap_category", "state",
        "city", "website",
    )


@query(
    "json_coalesce_flatten",
    "D-13 F-10 F-13 F-16",
    sql("quotes", f"SELECT event_id, {QUOTE_COLUMNS} FROM quotes"),
)
def json_coalesce_flatten(spark, sf):
    return json_docs.parse_quotes(tables.raw_quotes(spark, sf))


@query(
    "quotes_or_zero",
    "F-17",
    sql(
        "ev",
        """SELECT event_id,
             CASE WHEN event_id % 2 = 1 AND event_type NOT IN ('click', 'signup') THEN cents / 1e2 ELSE 0e0 END AS last_price,
             CASE WHEN event_id % 2 = 1 AND event_type NOT IN ('error', 'signup') THEN (cents + k) / 1e2 ELSE 0e0 END AS close_price,
             CASE WHEN event_id % 2 = 1 AND event_type <> 'signup' THEN k * 1000 ELSE 0 END AS volume
           FROM ev""",
    ),
)
def quotes_or_zero(spark, sf):
    return json_docs.quotes_or_zero(tables.raw_quotes(spark, sf)).select(
        "event_id", "last_price", "close_price", "volume"
    )


@query(
    "closed_market_quotes",
    "D-13",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN value + 1 END ELSE value END AS last_price,
              event_id % 3 = 0 AS was_closed FROM events""",
)
def closed_market_quotes(spark, sf):
    """Every third quote is of a closed market (-1), flat, nested or as a table column."""
    e = tables.load(spark, sf, "events")
    closed = F.col("event_id") % 3 == 0
    last = F.when(closed, F.lit(-1.0)).otherwise(F.col("value"))
    close = F.when(F.col("event_id") % 2 == 0, F.col("value") + 1)
    body = F.struct(last.cast("string").alias("last"), close.cast("string").alias("close"))
    nested = F.to_json(F.struct(F.struct(last.alias("last"), close.alias("close")).alias("Ticker")))
    in_column = F.col("event_id") % 5 == 0
    raw = e.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ticker"),
        F.when(in_column, F.to_json(F.struct(close.alias("close")))).when(F.col("event_id") % 2 == 0, F.to_json(body)).otherwise(nested).alias("market_data"),
        F.when(in_column | (F.col("event_id") % 2 == 0), last).alias("last_price"),
        F.lit(1).cast("bigint").alias("volume"),
        "event_id",
        closed.alias("was_closed"),
    )
    return json_docs.parse_quotes(raw, closed_as_missing=True).select("event_id", "last_price", "was_closed")


@query("latest_quotes", "D-13 K-4", sql("latest", f"SELECT {QUOTE_COLUMNS} FROM latest"))
def latest_quotes(spark, sf):
    return json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"]).drop("event_id")


@query(
    "incremental_flatten",
    "D-13 K-4 A-2",
    sql(
        "quotes",
        f"""SELECT {QUOTE_COLUMNS} FROM quotes
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY last_updated DESC, event_id DESC) = 1""",
    ),
)
def incremental_flatten(spark, sf):
    """Half of the time range is stored already; the delta above its high-water mark is merged."""
    raw = tables.raw_quotes(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    stored = json_docs.latest_quotes(raw.filter(F.col("last_updated") <= half), ["event_id"])
    delta = json_docs.newer_than(raw, json_docs.high_water_mark(stored))
    merged = guarded_upsert(
        stored, json_docs.parse_quotes(delta), ["ticker"], "last_updated", ["event_id"]
    )
    return merged.drop("event_id")


@query(
    "info_to_fundamentals",
    "F-29",
    sql(
        "listings",
        """SELECT ticker, split_part(ticker, '.', 1) AS symbol,
                  CASE WHEN ticker LIKE '%.%' THEN exchange ELSE '' END AS exchange,
                  CAST(round(balance * 100) AS BIGINT) * 1000 AS market_cap_usd,
                  coalesce(segment, '') AS sector, 'Industry ' || nation AS industry,
                  CASE WHEN balance < 6000 THEN 'EUR' ELSE 'USD' END AS currency, '' AS country
           FROM listings WHERE balance >= 1000""",
    ),
)
def info_to_fundamentals(spark, sf):
    return json_docs.info_to_fundamentals(tables.company_info(spark, sf))


@query(
    "info_keys",
    "D-17",
    sql(
        "listings",
        """SELECT 'marketCap' AS field, count(*) AS documents FROM listings WHERE balance >= 1000
           UNION ALL SELECT 'sector', count(*) FROM listings WHERE segment IS NOT NULL
           UNION ALL SELECT 'industry', count(*) FROM listings
           UNION ALL SELECT 'currency', count(*) FROM listings WHERE balance < 6000""",
    ),
)
def info_keys(spark, sf):
    return json_docs.document_keys(tables.company_info(spark, sf), "info")


# --- XML ------------------------------------------------------------------------------------

XML_SQL = """
    SELECT ticker, CASE WHEN balance NOT BETWEEN 4000 AND 4200 THEN name END AS company_name, 'R' || key AS rep_no,
           CAST(key + 7700000000 AS VARCHAR) AS org_perm_id, 'QQ' || lpad(CAST(key AS VARCHAR), 10, '0') AS isin,
           ticker AS ric, exchange AS exchange_code, 'N' || nation AS exchange_country,
           CASE WHEN balance > 5000 THEN DATE '1999-04-06' END AS most_recent_split_date,
           CASE WHEN balance > 5000 THEN 3e0 END AS most_recent_split_factor,
           'Trading' AS co_status, 'Share Company' AS co_type, DATE '2000-12-29' AS latest_annual_date,
           CAST(NULL AS DATE) AS latest_interim_date, CAST(key * 3 + 1 AS INTEGER) AS employees,
           key * 1000 + 5e-1 AS shares_out, DATE '2001-06-08' AS shares_out_date,
           key * 9e2 AS total_float, 'USD' AS reporting_currency,
           DATE '2001-10-19' AS most_recent_exch_date, 1.3125e0 AS most_recent_exch_val,
           coalesce(segment, 'SUPPLY') || ' last' AS industry_trbc, '81B' AS industry_trbc_code,
           'Weaving' AS industry_naics, '700100' AS industry_naics_code,
           'Textiles' AS industry_sic, '7700' AS industry_sic_code,
           key || ' Main Street' || CASE WHEN balance > 2000 THEN ', Floor 3' ELSE '' END AS address,
           'CITY ' || nation AS city, lpad(CAST(key AS VARCHAR), 6, '0') AS postal_code,
           'N' || nation AS country_code, '+99 77 ' || key AS phone,
           'https://example.com/' || key AS website, 'ir' || key || '@example.com' AS email,
           coalesce(segment, 'SUPPLY') || ' company of ' || name AS business_summary,
           'Short & simple' AS financial_summary,
           'Ann No' || key AS officer_1_name, 'Chair' AS officer_1_title,
           'Bo Li' AS officer_2_name, 'Director' AS officer_2_title,
           CASE WHEN balance > 3000 THEN 'Cy' END AS officer_3_name,
           CASE WHEN balance > 3000 THEN 'Secretary' END AS officer_3_title,
           '[{"n":"Ann No' || key || '","t":"Chair"},{"n":"Bo Li","t":"Director"}'
             || CASE WHEN balance > 3000 THEN ',{"n":"Cy","t":"Secretary"}' ELSE '' END || ']' AS officers_json,
           balance AS xml_last_price, round(balance + 100.25e0, 2) AS xml_52w_high,
           round(balance - 100.25e0, 2) AS xml_52w_low, DATE '2001-10-22' AS xml_last_price_date,
           10.5e0 AS xml_vol_10d_avg, CASE WHEN balance NOT BETWEEN 4300 AND 4500 THEN key * 7e0 + 100 END AS mkt_cap_local_mn,
           CASE WHEN balance > 1500 THEN round(balance / 100, 4) END AS pe_ratio,
           CAST(NULL AS DOUBLE) AS revenue_annual,
           CASE WHEN balance >= 1000 THEN 'INR' WHEN ticker LIKE '%.%' THEN reg_currency END AS price_currency,
           round(balance + 10, 2) AS target_price,
           CASE WHEN balance >= 2000 THEN 22.5e0 END AS proj_pe, 1.75e0 AS recommendation_score
    FROM listings WHERE balance >= -900"""


@query("xml_flatten_roundtrip", "D-1 D-2 D-3 D-4 D-5 D-6 D-7 D-8 D-9 D-11 S-4", sql("listings", XML_SQL))
def xml_flatten_roundtrip(spark, sf):
    good, _ = xml_docs.flatten_snapshots(tables.company_xml(spark, sf))
    return good.select(
        "ticker", "company_name", "rep_no", "org_perm_id", "isin", "ric", "exchange_code",
        "exchange_country", "most_recent_split_date", "most_recent_split_factor", "co_status",
        "co_type", "latest_annual_date", "latest_interim_date", "employees", "shares_out",
        "shares_out_date", "total_float", "reporting_currency", "most_recent_exch_date",
        "most_recent_exch_val", "industry_trbc", "industry_trbc_code", "industry_naics",
        "industry_naics_code", "industry_sic", "industry_sic_code", "address", "city",
        "postal_code", "country_code", "phone", "website", "email", "business_summary",
        "financial_summary", "officer_1_name", "officer_1_title", "officer_2_name",
        "officer_2_title", "officer_3_name", "officer_3_title", "officers_json", "xml_last_price",
        "xml_52w_high", "xml_52w_low", "xml_last_price_date", "xml_vol_10d_avg", "mkt_cap_local_mn",
        "pe_ratio", "revenue_annual", "price_currency", "target_price", "proj_pe",
        "recommendation_score",
    )


@query(
    "xml_quarantine",
    "D-10",
    sql(
        "listings",
        "SELECT ticker, '{}' AS xml_snapshot FROM listings WHERE balance < -900",
    ),
)
def xml_quarantine(spark, sf):
    _, bad = xml_docs.flatten_snapshots(tables.company_xml(spark, sf))
    return bad.select("ticker", "xml_snapshot")


@query(
    "xml_flatten_counts",
    "D-10 A-14",
    sql(
        "listings",
        """SELECT count(*) FILTER (balance >= -900) AS upserted, count(*) FILTER (balance < -900) AS errors
           FROM listings""",
    ),
)
def xml_flatten_counts(spark, sf):
    return xml_docs.flatten_counts(tables.company_xml(spark, sf))


@query(
    "xml_flatten_once",
    "D-10 A-14",
    sql(
        "listings",
        """SELECT balance >= -900 AS ok, count(*) AS documents,
                  count(CASE WHEN balance >= -900 AND balance NOT BETWEEN 4000 AND 4200 THEN 1 END) AS names
           FROM listings GROUP BY ALL""",
    ),
)
def xml_flatten_once(spark, sf):
    """Good rows, quarantine and counts from one parse: one written table, split by status."""
    folder = run_folder(spark, "snapshots")
    xml_docs.write_snapshots(tables.company_xml(spark, sf), folder)
    good, bad = xml_docs.read_snapshots(spark, folder)
    part = lambda df, ok, name: df.groupBy(F.lit(ok).alias("ok")).agg(
        F.count("*").alias("documents"), F.count(name).alias("names")
    )
    return part(good, True, "company_name").unionByName(part(bad, False, F.lit(None)))


@query(
    "xml_scope_by_suffix",
    "D-10 P-7",
    sql(
        "listings",
        """SELECT ticker, CASE WHEN balance NOT BETWEEN 4000 AND 4200 THEN name END AS company_name FROM listings
           WHERE balance >= -900 AND ticker LIKE '%.HK'""",
    ),
)
def xml_scope_by_suffix(spark, sf):
    good, _ = xml_docs.flatten_snapshots(tables.company_xml(spark, sf), suffix=".HK")
    return good.select("ticker", "company_name")


@query(
    "xml_usd_market_cap",
    "D-7 F-12",
    sql(
        "listings",
        """SELECT ticker, round(CASE WHEN balance NOT BETWEEN 4300 AND 4500 THEN key * 7e0 + 100 END * 1e6 * CASE cur WHEN 'INR' THEN 0.012e0
                    WHEN 'CAD' THEN 0.74e0 ELSE 1e0 END, 2) AS usd_mcap,
                  coalesce(cur NOT IN ('INR', 'CAD', 'USD', 'THB', 'IDR'), TRUE) AS fx_missing
           FROM (SELECT *, CASE WHEN balance >= 1000 THEN 'INR' WHEN ticker LIKE '%.%' THEN reg_currency END AS cur
                 FROM listings WHERE balance >= -900)""",
    ),
)
def xml_usd_market_cap(spark, sf):
    good, _ = xml_docs.flatten_snapshots(tables.company_xml(spark, sf))
    return xml_docs.usd_market_cap(good, dims.fx_rates(spark)).select(
        "ticker", F.round("usd_mcap", 2).alias("usd_mcap"), "fx_missing"
    )


@query(
    "xml_required_fields",
    "Q-F",
    sql(
        "listings",
        """SELECT ticker, balance >= -900 AS well_formed,
                  balance >= -900 AND balance NOT BETWEEN 4000 AND 4200 AS has_name,
                  balance >= -900 AND balance NOT BETWEEN 4300 AND 4500 AS has_market_cap,
                  balance > 1500 AS has_pe_ratio,
                  concat_ws(',', CASE WHEN balance < -900 OR balance BETWEEN 4000 AND 4200 THEN 'name' END,
                            CASE WHEN balance < -900 OR balance BETWEEN 4300 AND 4500 THEN 'market_cap' END,
                            CASE WHEN balance <= 1500 THEN 'pe_ratio' END) AS missing
           FROM listings""",
    ),
)
def xml_required_fields(spark, sf):
    return xml_docs.required_fields(tables.company_xml(spark, sf))


@query(
    "xml_ratio_tags",
    "D-18",
    sql(
        "listings",
        """SELECT tag, (SELECT CASE tag WHEN 'NPRICE' THEN CAST(balance AS VARCHAR)
                          WHEN 'NHIG' THEN CAST(round(balance + 100.25e0, 2) AS VARCHAR)
                          WHEN 'NLOW' THEN CAST(round(balance - 100.25e0, 2) AS VARCHAR)
                          WHEN 'PDATE' THEN '2001-10-22T00:00:00' WHEN 'VOL10DAVG' THEN '10.5'
                          WHEN 'MKTCAP' THEN CASE WHEN balance BETWEEN 4300 AND 4500 THEN 'n/a' ELSE CAST(key * 7 + 100 AS VARCHAR) END
                          WHEN 'APEEXCLXOR' THEN CASE WHEN balance > 1500
                               THEN CAST(round(balance / 100, 4) AS VARCHAR) ELSE 'n/a' END
                          WHEN 'AREV' THEN ' '
                          WHEN 'TargetPrice' THEN '<Value PeriodType="CURR">' || CAST(round(balance + 10, 2) AS VARCHAR) || '</Value>'
                          WHEN 'ProjPE' THEN '<Value PeriodType="CURR">' || CASE WHEN balance < 2000 THEN '-99999.99000' ELSE '22.5' END || '</Value>'
                          WHEN 'ConsRecom' THEN '<Mean>1.75</Mean>' END
                        FROM listings WHERE balance >= -900 ORDER BY ticker LIMIT 1) AS value,
                  (SELECT count(*) FROM listings WHERE balance >= -900) AS occurrences
           FROM (VALUES ('NPRICE'), ('NHIG'), ('NLOW'), ('PDATE'), ('VOL10DAVG'), ('MKTCAP'),
                 ('APEEXCLXOR'), ('AREV'), ('TargetPrice'), ('ProjPE'), ('ConsRecom')) t(tag)""",
    ),
)
def xml_ratio_tags(spark, sf):
    return xml_docs.ratio_tags(tables.company_xml(spark, sf))


# --- discovery: the number of nodes follows from how the documents are built --------------------


def nodes(spark, sf, per_document=True):
    return discovery.xml_nodes(tables.company_xml(spark, sf), per_document=per_document)


NODE_COUNTS_SQL = sql(
        "listings",
        """SELECT ticker,
                  78 + CASE WHEN balance > 5000 THEN 1 ELSE 0 END + CASE WHEN balance > 3000 THEN 4 ELSE 0 END AS total_nodes,
                  54 + CASE WHEN balance > 5000 THEN 1 ELSE 0 END + CASE WHEN balance > 3000 THEN 3 ELSE 0 END AS leaf_nodes
           FROM listings WHERE balance >= -900""",
    )


@query("xml_node_counts", "D-15", NODE_COUNTS_SQL)
def xml_node_counts(spark, sf):
    found = discovery.document_counts(tables.company_xml(spark, sf))
    return found.select("ticker", "total_nodes", "leaf_nodes")


# what every document holds: its data-bearing paths with their number of nodes
_ALWAYS_PATHS = (
    ("ReportSnapshot@Major", 1),
    ("ReportSnapshot/CoIDs/CoID@Type", 3),
    ("ReportSnapshot/CoIDs/CoID", 2),
    ("ReportSnapshot/Issues/Issue@ID", 2),
    ("ReportSnapshot/Issues/Issue@Type", 2),
    ("ReportSnapshot/Issues/Issue/IssueID@Type", 4),
    ("ReportSnapshot/Issues/Issue/IssueID", 4),
    ("ReportSnapshot/Issues/Issue/Exchange@Code", 2),
    ("ReportSnapshot/Issues/Issue/Exchange@Country", 2),
    ("ReportSnapshot/Issues/Issue/Exchange", 2),
    ("ReportSnapshot/CoGeneralInfo/CoStatus@Code", 1),
    ("ReportSnapshot/CoGeneralInfo/CoStatus", 1),
    ("ReportSnapshot/CoGeneralInfo/CoType@Code", 1),
    ("ReportSnapshot/CoGeneralInfo/CoType", 1),
    ("ReportSnapshot/CoGeneralInfo/LatestAvailableAnnual", 1),
    ("ReportSnapshot/CoGeneralInfo/Employees@LastUpdated", 1),
    ("ReportSnapshot/CoGeneralInfo/Employees", 1),
    ("ReportSnapshot/CoGeneralInfo/SharesOut@Date", 1),
    ("ReportSnapshot/CoGeneralInfo/SharesOut@TotalFloat", 1),
    ("ReportSnapshot/CoGeneralInfo/SharesOut", 1),
    ("ReportSnapshot/CoGeneralInfo/ReportingCurrency@Code", 1),
    ("ReportSnapshot/CoGeneralInfo/ReportingCurrency", 1),
    ("ReportSnapshot/CoGeneralInfo/MostRecentExchange@Date", 1),
    ("ReportSnapshot/CoGeneralInfo/MostRecentExchange", 1),
    ("ReportSnapshot/TextInfo/Text@Type", 2),
    ("ReportSnapshot/TextInfo/Text", 2),
    ("ReportSnapshot/contactInfo/streetAddress@line", 3),
    ("ReportSnapshot/contactInfo/streetAddress", 1),
    ("ReportSnapshot/contactInfo/city", 1),
    ("ReportSnapshot/contactInfo/postalCode", 1),
    ("ReportSnapshot/contactInfo/country@code", 1),
    ("ReportSnapshot/contactInfo/country", 1),
    ("ReportSnapshot/contactInfo/phone/phone@type", 2),
    ("ReportSnapshot/contactInfo/phone/phone/countryPhoneCode", 2),
    ("ReportSnapshot/contactInfo/phone/phone/city-areacode", 2),
    ("ReportSnapshot/contactInfo/phone/phone/number", 2),
    ("ReportSnapshot/webLinks/webSite@mainCategory", 1),
    ("ReportSnapshot/webLinks/webSite", 1),
    ("ReportSnapshot/webLinks/eMail@mainCategory", 1),
    ("ReportSnapshot/webLinks/eMail", 1),
    ("ReportSnapshot/peerInfo/IndustryInfo/Industry@type", 5),
    ("ReportSnapshot/peerInfo/IndustryInfo/Industry@order", 5),
    ("ReportSnapshot/peerInfo/IndustryInfo/Industry@code", 5),
    ("ReportSnapshot/peerInfo/IndustryInfo/Industry", 5),
    ("ReportSnapshot/officers/officer@rank", 2),
    ("ReportSnapshot/officers/officer/firstName", 2),
    ("ReportSnapshot/officers/officer/lastName", 2),
    ("ReportSnapshot/officers/officer/title@startYear", 2),
    ("ReportSnapshot/officers/officer/title", 2),
    ("ReportSnapshot/Ratios@ExchangeRate", 1),
    ("ReportSnapshot/Ratios/Group@ID", 2),
    ("ReportSnapshot/Ratios/Group/Ratio@FieldName", 8),
    ("ReportSnapshot/Ratios/Group/Ratio@Type", 8),
    ("ReportSnapshot/Ratios/Group/Ratio", 7),
    ("ReportSnapshot/ForecastData/Ratio@FieldName", 3),
    ("ReportSnapshot/ForecastData/Ratio@Type", 3),
    ("ReportSnapshot/ForecastData/Ratio/Value@PeriodType", 2),
    ("ReportSnapshot/ForecastData/Ratio/Value", 2),
    ("ReportSnapshot/ForecastData/Ratio/Mean", 1),
)
#: distinct data fields of such a document: elements with text or attributes, ratios by code
_ALWAYS_FIELDS = 63

_ROOT = "ReportSnapshot"
_OPTIONAL_PATHS = (
    (f"{_ROOT}/CoIDs/CoID", "named"),
    (f"{_ROOT}/Issues/Issue/MostRecentSplit", "split"),
    (f"{_ROOT}/Issues/Issue/MostRecentSplit@Date", "split"),
    (f"{_ROOT}/contactInfo/streetAddress", "floor"),
    (f"{_ROOT}/officers/officer@rank", "third"),
    (f"{_ROOT}/officers/officer/firstName", "third"),
    (f"{_ROOT}/officers/officer/title", "third"),
    (f"{_ROOT}/officers/officer/title@startYear", "third"),
    (f"{_ROOT}/Ratios@PriceCurrency", "priced"),
)


PATHS_SQL = sql(
        "listings",
        """SELECT path, CAST(CASE WHEN sum(per_document) > 0 THEN max(total) ELSE max(extra) END AS BIGINT) AS documents,
                  CAST(sum(per_document * total + extra) AS BIGINT) AS nodes
           FROM (SELECT path, per_document, total, 0 AS extra FROM always, counts
                 UNION ALL
                 SELECT path, 0, total, CASE part WHEN 'split' THEN split WHEN 'floor' THEN floors
                          WHEN 'third' THEN third WHEN 'named' THEN named ELSE priced END FROM optional_paths, counts)
           GROUP BY path""",
        values_cte("always", "path, per_document", _ALWAYS_PATHS)
        + ",\n"
        + values_cte("optional_paths", "path, part", _OPTIONAL_PATHS)
        + """,
        counts AS (SELECT count(*) AS total, count(*) FILTER (balance > 5000) AS split,
                          count(*) FILTER (balance > 2000) AS floors, count(*) FILTER (balance > 3000) AS third,
                          count(*) FILTER (balance >= 1000) AS priced,
                          count(*) FILTER (balance NOT BETWEEN 4000 AND 4200) AS named
                   FROM listings WHERE balance >= -900)""",
    )


@query("xml_paths", "D-14 U-6", PATHS_SQL)
def xml_paths(spark, sf):
    return discovery.paths(tables.company_xml(spark, sf))


@query(
    "xml_field_codes",
    "D-14",
    sql(
        "listings",
        """SELECT kind, field_name, n AS nodes FROM (
             SELECT * FROM (VALUES ('ratio', 'NPRICE'), ('ratio', 'NHIG'), ('ratio', 'NLOW'), ('ratio', 'PDATE'),
               ('ratio', 'VOL10DAVG'), ('ratio', 'MKTCAP'), ('ratio', 'APEEXCLXOR'), ('ratio', 'AREV'),
               ('forecast', 'TargetPrice'), ('forecast', 'ProjPE'), ('forecast', 'ConsRecom')) t(kind, field_name))
           JOIN (SELECT count(*) AS n FROM listings WHERE balance >= -900) ON TRUE""",
    ),
)
def xml_field_codes(spark, sf):
    return discovery.field_codes(nodes(spark, sf, per_document=False))


@query(
    "xml_unique_fields",
    "D-16",
    sql(
        "listings",
        f"""SELECT ticker, {_ALWAYS_FIELDS} + CASE WHEN balance > 5000 THEN 2 ELSE 0 END
                  + CASE WHEN balance >= 1000 THEN 1 ELSE 0 END AS unique_fields
           FROM listings WHERE balance >= -900""",
    ),
)
def xml_unique_fields(spark, sf):
    found = discovery.document_counts(tables.company_xml(spark, sf))
    return found.filter("unique_fields > 0").select("ticker", "unique_fields")


@query(
    "xml_section_sizes",
    "D-16",
    sql(
        "listings",
        """SELECT section, CAST(base * n + CASE section WHEN 'Issues' THEN splits WHEN 'officers' THEN 4 * thirds
                    ELSE 0 END AS BIGINT) AS nodes
           FROM (VALUES ('CoIDs', 4), ('Issues', 9), ('CoGeneralInfo', 8), ('TextInfo', 3), ('contactInfo', 16),
                 ('webLinks', 3), ('peerInfo', 7), ('officers', 9), ('Ratios', 11), ('ForecastData', 7)) t(section, base)
           JOIN (SELECT count(*) AS n, count(*) FILTER (balance > 5000) AS splits,
                        count(*) FILTER (balance > 3000) AS thirds
                 FROM listings WHERE balance >= -900) ON TRUE""",
    ),
)
def xml_section_sizes(spark, sf):
    return discovery.section_sizes(nodes(spark, sf, per_document=False))


@query(
    "document_sizes",
    "A-20",
    """SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total_size, count(text) AS has_document,
              count(quality) AS has_quality
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def document_sizes(spark, sf):
    from lowtide.operators.reports import document_sizes as sizes

    rows = tables.load(spark, sf, "documents").join(tables.load(spark, sf, "labels"), "doc_id", "left")
    return sizes(rows, ["text"], "quality")


@query(
    "newest_document_per_source",
    "W-14",
    """SELECT source, doc_id, n_chars FROM documents
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""",
)
def newest_document_per_source(spark, sf):
    docs = tables.load(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return latest_per_key(docs, ["source"], ["doc_id"])


def _companies(spark, sf):
    discovery.register_xml_functions(spark)
    tables.company_xml(spark, sf).createOrReplaceTempView("lowtide_companies")


@query("xml_paths_sql", "D-14 S-1", PATHS_SQL)
def xml_paths_sql(spark, sf):
    """Path discovery from SQL: the table function over a table argument."""
    _companies(spark, sf)
    return parameterised_query(
        spark,
        """SELECT path, sum(documents) AS documents, sum(documents * bearing) AS nodes
           FROM xml_paths(TABLE(SELECT xml_snapshot FROM lowtide_companies))
           WHERE bearing >= :least GROUP BY path""",
        {"least": 1},
    )


@query("xml_node_counts_sql", "D-15 S-1", NODE_COUNTS_SQL)
def xml_node_counts_sql(spark, sf):
    """Node counts per document from SQL, the table argument joined laterally."""
    _companies(spark, sf)
    return parameterised_query(
        spark,
        """SELECT found.ticker, found.total_nodes, found.leaf_nodes
           FROM VALUES (1) AS once(x),
                LATERAL (SELECT * FROM xml_documents(TABLE(SELECT ticker, xml_snapshot FROM lowtide_companies))) AS found""",
    )
