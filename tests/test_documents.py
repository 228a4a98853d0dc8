"""Document flattening on small hand-made documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import Counter

from pyspark.sql import functions as F

from lowtide.sources import discovery, json_docs, xml_docs

FULL = """<?xml version="1.0" encoding="UTF-8"?>
<ReportSnapshot Major="1">
  <CoIDs><CoID Type="RepNo">A1</CoID><CoID Type="CompanyName"> Acme Ltd </CoID></CoIDs>
  <Issues>
    <Issue ID="1" Type="P"><IssueID Type="Name">No exchange here</IssueID></Issue>
    <Issue ID="2" Type="C"><IssueID Type="ISIN">IN01</IssueID><IssueID Type="RIC">ACM.NS</IssueID>
      <Exchange Code="NSE" Country="IND">x</Exchange><MostRecentSplit Date="2001-05-17">2.0</MostRecentSplit></Issue>
    <Issue ID="3" Type="C"><IssueID Type="ISIN">IN02</IssueID><Exchange Code="BOM" Country="IND">y</Exchange></Issue>
  </Issues>
  <CoGeneralInfo><CoStatus Code="1">Active</CoStatus><Employees LastUpdated="2001-01-20">523</Employees>
    <SharesOut Date="2001-02-14" TotalFloat="1,000.5">2000.0</SharesOut><ReportingCurrency Code="INR">Rupee</ReportingCurrency></CoGeneralInfo>
  <TextInfo><Text Type="Business Summary">first</Text><Text Type="Business Summary">second &amp; last</Text></TextInfo>
  <contactInfo><streetAddress line="1">One Road</streetAddress><streetAddress line="2"></streetAddress><streetAddress line="3">Floor</streetAddress>
    <city>LAKETOWN</city><country code="IND">India</country>
    <phone><phone type="mainfax"><countryPhoneCode>90</countryPhoneCode><number>1</number></phone>
           <phone type="mainphone"><countryPhoneCode>91</countryPhoneCode><city-areacode>22</city-areacode><number>35</number></phone></phone></contactInfo>
  <peerInfo><IndustryInfo><Industry type="TRBC" order="1" code="1">old</Industry><Industry type="TRBC" order="2" code="2">new</Industry>
    <Industry type="NAICS" order="2" code="4">second</Industry><Industry type="NAICS" order="1" code="3">main</Industry></IndustryInfo></peerInfo>
  <officers>
    <officer rank="1"><firstName>A</firstName><lastName>One</lastName><title abbr="x">Chair</title></officer>
    <officer rank="2"><firstName>B</firstName><title>Dir</title></officer>
    <officer rank="3"><lastName>Three</lastName></officer><officer rank="4"><firstName>D</firstName></officer>
    <officer rank="5"><firstName>E</firstName></officer><officer rank="6"><firstName>F</firstName><lastName>Six</lastName></officer>
  </officers>
  <Ratios PriceCurrency="INR"><Group ID="g1"><Ratio FieldName="MKTCAP" Type="N">1.5</Ratio><Ratio FieldName="PDATE" Type="D">2001-12-03T00:00:00</Ratio></Group>
    <Group ID="g2"><Ratio FieldName="MKTCAP" Type="N">2.5</Ratio><Ratio FieldName="APEEXCLXOR" Type="N">n/a</Ratio><Ratio FieldName="OTHER" Type="N">7</Ratio></Group></Ratios>
  <ForecastData><Ratio FieldName="TargetPrice" Type="N"><Mean>9</Mean><Value PeriodType="CURR">10.5</Value></Ratio>
    <Ratio FieldName="ProjPE" Type="N"><Value PeriodType="CURR">-99999.99000</Value></Ratio>
    <Ratio FieldName="ProjEPS" Type="N"><Value PeriodType="NEXT">3</Value><Mean>4.5</Mean></Ratio></ForecastData>
</ReportSnapshot>"""
SPARSE = '<ReportSnapshot><Ratios><Group><Ratio FieldName="EV" Type="N"> </Ratio></Group></Ratios></ReportSnapshot>'
ROWS = [("ACM.NS", FULL), ("S.HK", SPARSE), ("BAD.NS", "{}"), ("CUT.NS", FULL[:300]), ("NONE.NS", None)]


def raw(spark):
    return spark.createDataFrame(ROWS, "ticker string, xml_snapshot string").withColumn(
        "last_updated", F.lit("2026-01-13 10:00:00").cast("timestamp_ntz")
    )


def test_snapshot_fields(spark):
    good, bad = xml_docs.flatten_snapshots(raw(spark))
    rows = {r["ticker"]: r.asDict() for r in good.collect()}
    assert set(rows) == {"ACM.NS", "S.HK"}
    assert {r["ticker"] for r in bad.collect()} == {"BAD.NS", "CUT.NS"}
    assert xml_docs.flatten_counts(raw(spark)).first().asDict() == {"upserted": 2, "errors": 2}
    r = rows["ACM.NS"]
    want = {
        "company_name": "Acme Ltd", "rep_no": "A1", "org_perm_id": None, "isin": "IN01", "ric": "ACM.NS",
        "exchange_code": "NSE", "exchange_country": "IND", "most_recent_split_factor": 2.0, "employees": 523,
        "shares_out": 2000.0, "total_float": 1000.5, "reporting_currency": "INR", "co_type": None,
        "business_summary": "second & last", "address": "One Road, Floor", "city": "LAKETOWN", "postal_code": None,
        "country_code": "IND", "phone": "+90  1", "industry_trbc": "new", "industry_trbc_code": "2",
        "industry_naics": "main", "industry_naics_code": "3", "industry_sic": None,
        "officer_1_name": "A One", "officer_1_title": "Chair", "officer_2_name": "B", "officer_3_name": "Three",
        "officer_3_title": "", "officer_5_name": "E", "mkt_cap_local_mn": 2.5, "pe_ratio": None, "ev": None,
        "target_price": 10.5, "proj_pe": None, "proj_eps": 4.5, "price_currency": "INR",
    }
    assert {k: r[k] for k in want} == want
    assert str(r["xml_last_price_date"]) == "2001-12-03" and str(r["most_recent_split_date"]) == "2001-05-17"
    assert r["officers_json"].count('"n"') == 6 and '"n":"F Six"' in r["officers_json"]
    assert rows["S.HK"]["price_currency"] == "HKD"  # from the registry


def test_snapshot_schema_is_the_table_schema(spark):
    from lowtide import schemas

    from lowtide import dims

    flat, _ = xml_docs.flatten_snapshots(raw(spark))
    good = xml_docs.in_dollars(flat, dims.fx_rates(spark))
    assert good.columns == schemas.column_names(schemas.STOCK_FUNDAMENTALS) and len(good.columns) == 81
    assert good.schema.simpleString() == schemas.empty(spark, "stock_fundamentals").schema.simpleString()


def test_required_fields(spark):
    flags = {r["ticker"]: (r["well_formed"], r["has_name"], r["has_market_cap"], r["missing"]) for r in xml_docs.required_fields(raw(spark)).collect()}
    assert flags["ACM.NS"] == (True, True, True, "pe_ratio")  # stated as n/a
    assert flags["S.HK"] == (True, False, False, "name,market_cap,pe_ratio")
    assert flags["BAD.NS"] == (False, False, False, "name,market_cap,pe_ratio")


def test_one_parse_for_good_rows_and_quarantine(spark, tmp_path):
    xml_docs.write_snapshots(raw(spark), str(tmp_path / "t"))
    good, bad = xml_docs.read_snapshots(spark, str(tmp_path / "t"))
    want_good, want_bad = xml_docs.flatten_snapshots(raw(spark))
    assert sorted(map(str, good.collect())) == sorted(map(str, want_good.collect())) and good.columns == want_good.columns
    assert sorted(map(str, bad.collect())) == sorted(map(str, want_bad.collect()))
    plan = xml_docs.flatten_all(raw(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") <= 1


def _walk(node, path=""):
    here = f"{path}/{node.tag}" if path else node.tag
    found = [f"{here}@{a}" for a in node.attrib]
    if len(node) == 0 and node.text and node.text.strip():
        found.append(here)
    for child in node:
        found += _walk(child, here)
    return found


def test_discovery_against_element_tree(spark):
    nodes = discovery.xml_nodes(raw(spark)).cache()
    trees = {t: ET.fromstring(d) for t, d in ROWS[:2]}
    counts = {r["ticker"]: (r["total_nodes"], r["leaf_nodes"]) for r in discovery.node_counts(nodes).collect()}
    assert counts == {t: (len(list(x.iter())), sum(len(n) == 0 for n in x.iter())) for t, x in trees.items()}
    paths = {r["path"]: (r["documents"], r["nodes"]) for r in discovery.path_counts(nodes).collect()}
    all_paths = [(t, p) for t, x in trees.items() for p in _walk(x)]
    documents, total = Counter(p for _, p in set(all_paths)), Counter(p for _, p in all_paths)
    assert paths == {p: (documents[p], total[p]) for p in total}
    straight = {r["path"]: (r["documents"], r["nodes"]) for r in discovery.paths(raw(spark)).collect()}
    assert straight == paths
    codes = {(r["kind"], r["field_name"]) for r in discovery.field_codes(nodes).collect()}
    assert ("forecast", "ProjPE") in codes and ("ratio", "OTHER") in codes and ("ratio", "ProjPE") not in codes
    fields = {r["ticker"]: r["unique_fields"] for r in discovery.unique_fields(nodes).collect()}
    for ticker, tree in trees.items():
        want = set()
        for n in tree.iter():
            if n.text and n.text.strip():
                want.add(f"Ratio.{n.get('FieldName')}" if n.tag == "Ratio" else n.tag)
            want |= {f"{n.tag}.{a}" for a in n.attrib}
        assert fields[ticker] == len(want)
    sections = {r["section"]: r["nodes"] for r in discovery.section_sizes(nodes).collect()}
    assert sections == dict(Counter(c.tag for x in trees.values() for c in x for _ in c.iter()))
    nodes.unpersist()


def test_ratio_tags_first_value_wins(spark):
    docs = [("B", 'x <Ratio FieldName="EV" Type="N">2</Ratio>'), ("A", '<Ratio FieldName="EV" Type="N">1</Ratio><Ratio FieldName="EV" Type="N">9</Ratio>')]
    df = spark.createDataFrame(docs, "ticker string, xml_snapshot string")
    assert [tuple(r) for r in xml_docs.ratio_tags(df).collect()] == [("EV", "1", 3)]


def test_directory_forms(spark):
    docs = [
        ("A.NS", '{"A.NS": {"name": "Alpha", "state": NaN, "city": " ", "market_cap": "Large Cap"}}'),
        ("B.NS", '{"name": "Beta", "isin": "US01", "figi": NaN}'),
        ("C.NS", '{"X.NS": {"name": "other"}}'),
        ("D.NS", "not json"),
    ]
    rows = {r["ticker"]: r for r in json_docs.flatten_directory(spark.createDataFrame(docs, "ticker string, raw_data string")).collect()}
    assert len(rows) == 4 and len(rows["A.NS"].asDict()) == 20
    assert (rows["A.NS"]["company_name"], rows["A.NS"]["market_cap_category"]) == ("Alpha", "Large Cap")
    assert rows["A.NS"]["state"] is None and rows["A.NS"]["city"] is None
    assert (rows["B.NS"]["company_name"], rows["B.NS"]["isin"], rows["B.NS"]["figi"]) == ("Beta", "US01", None)
    assert rows["C.NS"]["company_name"] is None and rows["D.NS"]["company_name"] is None


def test_quote_forms(spark):
    docs = [
        ("A.NS.NS", '{"Ticker": {"last": "1,234.5", "close": 5, "volume": "7.5"}}', None, None),
        ("B", '{"last": 3, "close": 4, "high": null, "open": "x"}', None, 9),
        ("C", '{"close": 4, "Ticker": {"close": 8, "last": 6}}', 2.5, None),
        ("D", None, 1.0, 1),
        ("E", "{}", None, None),
    ]
    df = spark.createDataFrame(docs, "ticker string, market_data string, last_price double, volume bigint").withColumn(
        "last_updated", F.lit("2026-01-01").cast("timestamp_ntz")
    )
    rows = {r["ticker"]: r for r in json_docs.parse_quotes(df).collect()}
    assert set(rows) == {"A.NS", "B", "C", "E"}
    assert (rows["A.NS"]["last_price"], rows["A.NS"]["close_price"], rows["A.NS"]["volume"]) == (1234.5, 5.0, 8)
    # a flat last price is only taken from the table column; the close stands in for it
    assert (rows["B"]["last_price"], rows["B"]["open_price"], rows["B"]["volume"]) == (4.0, None, 9)
    assert (rows["C"]["last_price"], rows["C"]["close_price"]) == (2.5, 4.0)
    assert rows["E"]["last_price"] is None
    zero = {r["ticker"]: r for r in json_docs.quotes_or_zero(df).collect()}
    assert (zero["A.NS.NS"]["last_price"], zero["B"]["last_price"], zero["B"]["volume"]) == (1234.5, 0.0, 0)


def test_zero_is_a_price_and_a_negative_one_is_not(spark):
    docs = [
        ("A", '{"close": 4}', 0.0, 1),
        ("B", '{"Ticker": {"last": 0, "close": 4}}', None, 1),
        ("C", '{"close": 4}', -1.0, 1),
        ("D", '{"Ticker": {"last": -1, "close": 4}}', None, 1),
        ("E", '{"Ticker": {"last": 0}}', None, 1),
    ]
    df = spark.createDataFrame(docs, "ticker string, market_data string, last_price double, volume bigint")
    prices = lambda **o: {r["ticker"]: r["last_price"] for r in json_docs.parse_quotes(df, **o).collect()}
    assert prices() == {"A": 0.0, "B": 0.0, "C": 4.0, "D": 4.0, "E": 0.0}
    assert prices(closed_as_missing=False) == {"A": 0.0, "B": 0.0, "C": -1.0, "D": -1.0, "E": 0.0}


def test_info_documents(spark):
    docs = [("A.HK", '{"marketCap": 12.4, "sector": "X"}'), ("B", '{"sector": "X"}'), ("C", "{}"), ("D", None)]
    rows = json_docs.info_to_fundamentals(spark.createDataFrame(docs, "ticker string, info string")).collect()
    assert [(r["ticker"], r["symbol"], r["exchange"], r["market_cap_usd"], r["currency"]) for r in rows] == [("A.HK", "A", "SEHK", 12, "USD")]
