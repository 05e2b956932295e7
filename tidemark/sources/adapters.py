"""Domain tables as views over the driver tables.

Each is one SELECT in the SQL that Spark and other engines share, so that an oracle can repeat it as a common table
expression. Input tables are named in braces. Nothing here is sampled or cut: the tables grow with their input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.shared import dealt

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def pick(index: str, values: list[str | None]) -> str:
    """values[index] as SQL; NULL values are left out."""
    cases = " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values) if v is not None)
    return f"CASE {index} {cases} END"


ASSET_TYPES = ["Industrial Manufacturing", "Commercial Office", "Residential Complex", "Energy Plant", "Technology Data Center", "Chemical Storage", None]
LOCATIONS = ["California, USA", "Houston, Texas, USA", "London, UK", "Tokyo, Japan", "Miami, Florida, USA", "Nairobi, Kenya", "Dhaka, Bangladesh", "Rotterdam, Netherlands", "Santiago, Chile", "Singapore", "Sydney, Australia", "New York, USA", None, "Far Island"]
CONSTRUCTION = ["steel and concrete", "wood frame", "reinforced concrete", "masonry", "steel_concrete with sprinkler", "wood_frame", None]
OCCUPANCY = ["manufacturing facility", "office", "hazardous storage", "warehouse", "restricted zone", "retail shop", None, "data center", "hospital", "farm", "port"]
RATINGS = ["AAA", "AA", "A", "BBB+", "BBB", "BB", "B", "CCC", None]
CAUSES = ["Fire", "Theft", "Flood", "Equipment failure", "Storm"]
INSURED = ["ABC Manufacturing Ltd", "Delta Shipping Corp", "Orion Energy Inc", "Blue Lake Hotels Ltd", "North Steel Company"]
BROKERS = ["Marsh Brokers Ltd", "Aon Broking Limited", "Willis Brokerage Inc", None]
CEDANTS = ["Prime Insurance Company", "Jubilee Assurance Ltd", "Union Insurance Corp"]
PERILS = ["Fire, Flood and Explosion", "Earthquake and Wildfire", "Machinery Breakdown", "Burglary and Theft", None]
LINES = ["property damage", "marine cargo", "aviation hull", "cyber liability", "public liability"]
SUBJECTS = ["RE: follow up on placement", "Renewal of property cover", "Facultative reinsurance slip", "Amendment to policy", "New submission from broker", "Weekly report"]

#: limit_type, category, max_amount, geographic_region, industry_sector, active. Fixed values.
LIMITS = [
    ("asset_value", "standard", "100000000", None, None),
    ("asset_value", "high_value", "500000000", None, None),
    ("coverage_limit", "standard", "50000000", None, None),
    ("geographic_exposure", "regional", "200000000", "north_america", None),
    ("geographic_exposure", "regional", "150000000", "europe", None),
    ("geographic_exposure", "regional", "100000000", "asia_pacific", None),
    ("industry_sector", "restricted", "0", None, "nuclear"),
    ("industry_sector", "high_risk", "25000000", None, "energy"),
    ("industry_sector", "standard", "75000000", None, "manufacturing"),
    ("construction_type", "wood_frame", "10000000", None, None),
    ("construction_type", "steel_concrete", "100000000", None, None),
    ("occupancy_type", "hazardous", "5000000", None, None),
    ("financial_strength", "credit_rating", None, None, None),
    ("financial_strength", "minimum_assets", "10000000", None, None),
    ("regulatory_compliance", "sanctions_check", None, None, None),
    ("regulatory_compliance", "capital_requirements", None, None, None),
    ("catastrophe_exposure", "high_cat_risk", "25000000", None, None),
    ("catastrophe_exposure", "medium_cat_risk", "50000000", None, None),
    ("catastrophe_exposure", "low_cat_risk", "100000000", None, None),
    ("aggregate_exposure", "total_portfolio", "1000000000", None, None),
]


def _literal(v: str | None) -> str:
    return "CAST(NULL AS varchar(64))" if v is None else f"'{v}'"


def _limits() -> str:
    rows = ", ".join(f"({n + 1}, {_literal(t)}, {_literal(c)}, CAST({m or 'NULL'} AS decimal(15,2)), {_literal(g)}, {_literal(s)}, true)" for n, (t, c, m, g, s) in enumerate(LIMITS))
    return f"SELECT * FROM (VALUES {rows}) AS v(limit_id, limit_type, category, max_amount, geographic_region, industry_sector, active)"


VIEWS: dict[str, str] = {
    "applications": """
        SELECT CAST(o_orderkey AS varchar(20)) AS application_id, o_orderkey AS no, o_custkey AS custkey,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'completed'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'analyzed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'pending' END AS status,
               CAST(o_orderdate AS timestamp) AS created_at, CAST(o_orderdate AS timestamp) + INTERVAL '1' HOUR * CAST(o_orderkey % 72 AS int) AS updated_at
        FROM {orders}""",
    "risk_parameters": f"""
        SELECT CAST(o_orderkey AS varchar(20)) AS application_id,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN CAST(0 AS decimal(15,2)) ELSE CAST(o_totalprice * 500 AS decimal(15,2)) END AS asset_value,
               CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(o_totalprice * 400 AS decimal(15,2)) END AS coverage_limit,
               {pick('o_orderkey % 7', ASSET_TYPES)} AS asset_type, {pick('o_orderkey % 14', LOCATIONS)} AS location,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'technology' WHEN c_mktsegment = 'BUILDING' THEN 'construction' WHEN c_mktsegment = 'MACHINERY' THEN 'manufacturing'
                    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'automotive parts' WHEN c_mktsegment = 'FURNITURE' THEN 'retail' ELSE 'oil gas' END AS industry_sector,
               {pick('o_orderkey % 5 + o_orderkey % 3', CONSTRUCTION)} AS construction_type, {pick('o_orderkey % 11', OCCUPANCY)} AS occupancy
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "financial_data": f"""
        SELECT CAST(o_orderkey AS varchar(20)) AS application_id,
               CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_acctbal * 15000 + 20000000 AS decimal(15,2)) END AS revenue,
               CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(c_acctbal * 20000 + 30000000 AS decimal(15,2)) END AS assets,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_acctbal * 20000 + 30000000) * (c_custkey % 10) / 10 AS decimal(15,2)) END AS liabilities,
               {pick('c_custkey % 9', RATINGS)} AS credit_rating, {pick('c_custkey % 9', RATINGS[::-1])} AS financial_strength_rating
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "loss_events": f"""
        SELECT CAST(l_orderkey AS varchar(20)) AS application_id, CAST(l_shipdate AS timestamp) AS event_date, CAST(l_extendedprice AS decimal(15,2)) AS amount, {pick('l_partkey % 5', CAUSES)} AS cause
        FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "business_limits": _limits(),
    "rates": "SELECT * FROM (VALUES ('KES', CAST(1.0 AS double)), ('USD', CAST(150.0 AS double)), ('EUR', CAST(165.0 AS double)), ('GBP', CAST(190.0 AS double))) AS v(currency, kes_value)",
    "portfolio_limits": """
        SELECT c_nationkey * 10 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS limit_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'coverage_limit' WHEN 'BUILDING' THEN 'asset_value' WHEN 'FURNITURE' THEN 'occupancy_type' WHEN 'MACHINERY' THEN 'industry_sector' ELSE 'aggregate_exposure' END AS limit_type,
               c_mktsegment AS category, CAST(max(c_acctbal) * 10000 AS decimal(15,2)) AS max_amount, max(c_custkey) % 4 > 0 AS active
        FROM {customer} GROUP BY c_nationkey, c_mktsegment""",
    "limit_updates": """
        SELECT s_nationkey * 10 + s_suppkey % 5 + 1 AS limit_id, CASE WHEN count(*) % 2 = 0 THEN CAST(max(s_acctbal) * 10000 AS decimal(15,2)) END AS max_amount, CASE WHEN max(s_suppkey) % 5 = 0 THEN false END AS active
        FROM {supplier} GROUP BY s_nationkey * 10 + s_suppkey % 5 + 1""",
    "nation_rates": "SELECT 'C' || CAST(c_nationkey AS varchar(8)) AS currency, CAST(1 + abs(max(c_acctbal)) / 100 AS double) AS kes_value FROM {customer} GROUP BY c_nationkey",
    "supplier_rates": "SELECT 'C' || CAST(s_nationkey + 7 AS varchar(8)) AS currency, CAST(1 + abs(max(s_acctbal)) / 100 AS double) AS kes_value FROM {supplier} GROUP BY s_nationkey",
    "nation_quotes": "SELECT 'C' || CAST(c_nationkey AS varchar(8)) AS currency, CAST(CASE WHEN c_nationkey % 3 = 1 THEN min(c_acctbal) ELSE abs(max(c_acctbal)) + 1 END AS double) / 1000 AS rate FROM {customer} GROUP BY c_nationkey",
    "recommendations": """
        SELECT CAST(o_orderkey AS varchar(20)) AS application_id, CASE WHEN o_orderkey % 3 = 0 THEN 'APPROVE' WHEN o_orderkey % 3 = 1 THEN 'CONDITIONAL' ELSE 'REJECT' END AS decision,
               CAST(o_orderkey % 50 AS double) / 100 AS premium_adjustment, CAST(o_orderdate AS timestamp) + INTERVAL '1' HOUR * CAST(o_orderkey % 48 AS int) AS decided_at,
               'Recommendation for application ' || CAST(o_orderkey AS varchar(20)) || ': terms as reviewed by the underwriting team of the facultative desk' AS rationale
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "processing_logs": """
        SELECT event_id, CAST(user_id AS varchar(20)) AS application_id, event_type AS process_type, CASE WHEN event_type = 'error' OR event_id % 20 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'pending' ELSE 'completed' END AS status,
               CASE event_id % 4 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' ELSE 'ERROR' END AS level,
               CAST(value AS decimal(10,3)) AS processing_time, CAST(ts AS timestamp) AS created_at
        FROM {events}""",
    "app_documents": f"""
        SELECT l_orderkey * 10 + l_linenumber AS document_id, CAST(l_orderkey AS varchar(20)) AS application_id, CAST(l_shipdate AS timestamp) AS uploaded_at, l_quantity > 10 AS processed,
               {pick('l_partkey % 5', ['slip', 'policy', 'survey', 'loss_run', 'email'])} || '_' || CAST(l_linenumber AS varchar(8)) || {pick('l_suppkey % 4', ['.pdf', '.docx', '.xlsx', '.msg'])} AS filename,
               {pick('l_suppkey % 4', ['pdf', 'docx', 'excel', 'email'])} AS document_type
        FROM {{lineitem}}""",
    "slips": f"""
        SELECT o_orderkey AS doc_id, CAST(o_custkey AS varchar(20)) AS application_id, CAST(o_orderdate AS timestamp) AS uploaded_at,
               {pick('o_orderkey % 5', ['ri_slip.pdf', 'placement.docx', 'summary.xlsx', 'note.txt', 'mail.msg'])} AS filename, {pick('o_orderkey % 6', SUBJECTS)} AS subject,
               'desk@' || {pick('o_orderkey % 3', ['broker.co.uk', 'cedant.com', 'reinsurer.co.ke'])} AS sender,
               concat_ws(chr(10), 'Reference: FAC-' || CAST(o_orderkey AS varchar(20)) || '-A', 'Insured: ' || {pick('o_orderkey % 5', INSURED)}, 'Cedant: ' || {pick('o_orderkey % 3', CEDANTS)}, 'Broker: ' || {pick('o_orderkey % 4', BROKERS)},
                   'Sum Insured: USD ' || CAST(CAST(floor(o_totalprice) AS bigint) AS varchar(20)) || ',000', 'Premium: ' || {pick('o_orderkey % 3', ['USD', 'EUR', 'KES'])} || ' ' || CAST(CAST(floor(o_totalprice) AS bigint) % 900 + 100 AS varchar(20)) || ',500.00',
                   'Location: ' || {pick('o_orderkey % 14', LOCATIONS)}, 'Perils: ' || {pick('o_orderkey % 5', PERILS)}, 'Class: ' || {pick('o_orderkey % 5', LINES)},
                   CASE WHEN o_orderkey % 4 = 0 THEN 'PML: ' || CAST(o_orderkey % 130 AS varchar(8)) || '%' WHEN o_orderkey % 4 = 1 THEN 'The PML is estimated at ' || CAST(o_orderkey % 60 AS varchar(8)) || '.5% of the total' WHEN o_orderkey % 4 = 2 THEN 'Maximum Probable Loss ' || CAST(o_orderkey % 40 AS varchar(8)) || ' percent' END,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'Period of Insurance: From 01/0' || CAST(o_orderkey % 9 + 1 AS varchar(2)) || '/2024 to 31/12/2024' WHEN o_orderkey % 3 = 1 THEN 'Period: 12 months' END,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'Reinsurance commission: ' || CAST(o_orderkey % 70 AS varchar(8)) || '% of premium' WHEN o_orderkey % 3 = 1 THEN 'Brokerage deduction: USD ' || CAST(o_orderkey % 90 + 10 AS varchar(8)) || ',000' END,
                   CASE WHEN o_orderkey % 4 = 0 THEN 'Quota share: ' || CAST(o_orderkey % 100 AS varchar(8)) || '%' WHEN o_orderkey % 4 = 1 THEN 'Participation: 15 percent' END,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'Claims experience for the last 3 years: Nil claims reported' WHEN o_orderkey % 3 = 1 THEN 'Loss record: two losses in 2022' END,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'A survey report by the risk surveyor is attached as survey_report.pdf' END,
                   CASE WHEN o_orderkey % 5 = 1 THEN 'Flood and hurricane exposure is high, climate change adaptation per TCFD is planned' END,
                   CASE WHEN o_orderkey % 5 = 2 THEN 'ESG rating available: carbon emissions, governance policy and social responsibility reviewed' END,
                   'Retention: ' || CAST(o_orderkey % 60 AS varchar(8)) || '%', 'Excess: USD ' || CAST(o_orderkey % 50 + 1 AS varchar(8)) || ',000', 'Rate: ' || CAST(o_orderkey % 9 AS varchar(8)) || '.25%') AS text
        FROM {{orders}}""",
    "premium_rows": f"""
        SELECT o_orderkey AS row_id, {pick('o_orderkey % 5', INSURED)} AS insured_name, {pick('o_orderkey % 5', ['USD', 'KES', 'EUR', 'XYZ', None])} AS currency,
               CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_totalprice * 20 END AS tsi, CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 36 = 0 THEN 0 ELSE o_totalprice / 2 END AS premium,
               CASE WHEN o_orderkey % 13 = 0 THEN CAST(2.5 AS double) END AS premium_rate, CASE o_orderkey % 4 WHEN 0 THEN CAST(15 AS double) WHEN 1 THEN CAST(0.125 AS double) WHEN 2 THEN CAST(1 AS double) ELSE CAST(5000 AS double) END AS brokerage,
               CAST(o_orderkey % 5000 AS double) AS taxes, CAST(o_orderkey % 2000 AS double) AS levies, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS double) END AS accepted_share,
               CAST(o_custkey * 10 AS double) AS paid_losses, CAST(o_custkey * 3 AS double) AS outstanding_reserves, CAST(o_custkey AS double) AS recoveries, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice / 3 END AS earned_premium
        FROM {{orders}}""",
    "analysis_rows": f"""
        SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 < 9 THEN 'REF-' || CAST(o_orderkey AS varchar(20)) ELSE 'A' END AS reference_number, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderdate AS timestamp) END AS date_received,
               {pick('o_orderkey % 6', INSURED + [None])} AS insured_name, {pick('o_orderkey % 4', CEDANTS + [None])} AS cedant_reinsured, {pick('o_orderkey % 4', BROKERS)} AS broker_name, {pick('o_orderkey % 5', PERILS)} AS perils_covered,
               {pick('o_orderkey % 14', LOCATIONS)} AS geographical_limit, {pick('o_orderkey % 14', LOCATIONS[::-1])} AS situation_of_risk, {pick('o_orderkey % 11', OCCUPANCY)} AS occupation_of_insured, {pick('o_orderkey % 11', OCCUPANCY[::-1])} AS main_activities,
               CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_totalprice * 50 - 100000 AS decimal(15,2)) END AS total_sums_insured, {pick('o_orderkey % 5', ['USD', 'KES', 'EURO', 'GBP', None])} AS currency,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice - 1000 AS decimal(15,2)) END AS excess_retention, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 130 AS decimal(5,2)) END AS premium_rates,
               CASE WHEN o_orderkey % 3 = 0 THEN '12 months' END AS period_of_insurance, CASE WHEN o_orderkey % 4 > 1 THEN CAST(o_orderkey % 105 AS decimal(5,2)) END AS pml_percentage, CASE WHEN o_orderkey % 5 = 0 THEN 'flood zone' END AS cat_exposure,
               CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 900 AS decimal(15,2)) END AS reinsurance_deductions, CASE WHEN o_orderkey % 5 = 1 THEN 'Nil' END AS claims_experience_3_years, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 100 AS decimal(5,2)) END AS share_offered_percentage,
               CASE WHEN o_orderkey % 8 = 0 THEN 'attached' END AS surveyors_report, CASE WHEN o_orderkey % 8 = 1 THEN '' END AS climate_change_risk, CASE WHEN o_orderkey % 8 = 2 THEN 'low' END AS esg_risk_assessment, CAST(o_orderkey % 100 AS double) / 100 AS confidence_score, CAST(o_custkey AS varchar(20)) AS source_document
        FROM {{orders}}""",
    "predictions": """
        SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS truth, CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS predicted FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL""",
    "messages": """
        SELECT c.conv_id AS message_id, CAST(c.turn AS int) AS turn, c.role, c.text, 'user' || CAST(c.conv_id % 50 AS varchar(8)) || CASE WHEN c.conv_id % 3 = 0 THEN '@broker.co.uk' WHEN c.conv_id % 3 = 1 THEN '@cedant.com' ELSE '@spam.biz' END AS sender,
               CASE WHEN c.conv_id % 4 = 0 THEN 'Facultative reinsurance offer' WHEN c.conv_id % 4 = 1 THEN 'Fac placement request' WHEN c.conv_id % 4 = 2 THEN 'Lunch' ELSE 'Claims note' END AS subject,
               CASE WHEN c.turn % 3 = 0 THEN 'ri_slip.pdf' WHEN c.turn % 3 = 1 THEN 'survey_report.docx' ELSE 'photo.png' END AS attachment
        FROM {conversations} c""",
}


#: Views whose rows cost more to compute than their columns to send, and the table that is dealt out for it.
DEALT_VIEWS = {"slips": "orders", "risk_parameters": "orders"}


def inputs(view: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", VIEWS[view]))


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in inputs(name)}
    if name in DEALT_VIEWS:
        tables[DEALT_VIEWS[name]] = dealt(tables[DEALT_VIEWS[name]])
    return spark.sql(VIEWS[name], **tables)


class Tables:
    """The domain tables (and the driver tables) of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return _view(self.spark, self.sf_dir, name)
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)
