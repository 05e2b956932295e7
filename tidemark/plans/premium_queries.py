"""Queries of premium arithmetic, validation and merging, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import consolidate, premium
from tidemark.plans.oracle import STEPS, oracle
from tidemark.plans.risk_queries import SQL4, R4, risk_of

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]  # noqa: E731  products of money have five decimals at most
SQL6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
DERIVED = ("rate_percent", "rate_permille", "calculated_premium", "incurred", "loss_ratio", "accepted_premium", "accepted_liability", "accepted_loss_ratio", "tsi_kes", "premium_kes")
STEPS["premium_base"] = """
    SELECT p.*, upper(coalesce(p.currency, 'KES')) AS original_currency, coalesce(r.kes_value, 1.0) AS rate, coalesce(tsi, 0) AS t, coalesce(premium, 0) AS g, coalesce(accepted_share, 0) AS s, coalesce(nullif(earned_premium, 0), premium, 0) AS e,
           coalesce(paid_losses, 0) + coalesce(outstanding_reserves, 0) - coalesce(recoveries, 0) AS inc, coalesce(brokerage, 0) AS b
    FROM premium_rows p LEFT JOIN rates r ON r.currency = upper(coalesce(p.currency, 'KES'))"""
STEPS["premium_full"] = """
    SELECT *, CASE WHEN t > 0 AND g > 0 THEN g / t * 100 END AS rate_percent, CASE WHEN t > 0 AND g > 0 THEN g / t * 1000 END AS rate_permille, CASE WHEN NOT (t > 0 AND g > 0) AND t > 0 AND premium_rate > 0 THEN t * (premium_rate / 100) END AS calculated_premium,
           CASE WHEN e > 0 THEN inc END AS incurred, CASE WHEN e > 0 THEN inc / e * 100 END AS loss_ratio, CASE WHEN s > 0 AND g > 0 THEN g * (s / 100) END AS accepted_premium, CASE WHEN s > 0 AND t > 0 THEN t * (s / 100) END AS accepted_liability,
           CASE WHEN s > 0 AND e > 0 THEN inc / e * 100 END AS accepted_loss_ratio, t * rate AS tsi_kes, g * rate AS premium_kes,
           greatest(0, g - CASE WHEN b > 0 AND b < 1 THEN g * b WHEN b > 1 AND b < 100 THEN g * (b / 100) ELSE b END - coalesce(taxes, 0) - coalesce(levies, 0)) AS net_premium,
           CASE WHEN t >= 1000000000 THEN 'High' WHEN t >= 100000000 THEN 'Medium' ELSE 'Low' END AS liability
    FROM premium_base"""
STEPS["premium_scored"] = """
    SELECT *, greatest(1, least(10, 5.0::DOUBLE + CASE WHEN lr > 100 THEN 3 WHEN lr > 75 THEN 2 WHEN lr > 50 THEN 1 WHEN lr < 25 THEN -1 ELSE 0 END + CASE liability WHEN 'High' THEN 1 WHEN 'Low' THEN -0.5 ELSE 0 END)) AS risk_score
    FROM (SELECT *, coalesce(round(loss_ratio, 2), 0) AS lr FROM premium_full)"""
_there = lambda f: f"coalesce({f}::VARCHAR, '') <> ''"
_list = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {a} THEN '{b}' END" for a, b in pairs) + "], lambda x: x IS NOT NULL)"
_errors = [(f"{f} < 0", f"{f} cannot be negative") for f in premium.AMOUNTS] + [(f"{f} < 0 OR {f} > 100", f"{f} must be between 0 and 100") for f in premium.PERCENTS] + [("length(currency) <> 3", "Currency code must be 3 characters")] + [(f"length({f}) > {n}", f"{f} exceeds {n} characters") for f, n in premium.LENGTHS.items()]
STEPS["row_checked"] = f"""
    SELECT *, list_concat({_list([('length(reference_number) < 3', 'Reference number seems too short'), ('done < 11.5', 'Low data completeness'), ('done >= 11.5 AND done < 18.4', 'Moderate data completeness')])}, list_transform(missing, lambda f: 'Missing critical field: ' || f)) AS warnings,
           (10 - len(missing)) / 10.0::DOUBLE AS completeness, len(errors) = 0 AS valid
    FROM (SELECT *, {_list([(f"NOT ({_there(f)})", f) for f in premium.CRITICAL])} AS missing, {_list(_errors)} AS errors, {' + '.join(f"CASE WHEN {_there(f)} THEN 1 ELSE 0 END" for f in premium.FIELDS)} AS done FROM analysis_rows)"""
STEPS["field_flags"] = " UNION ALL ".join(f"SELECT '{f}' AS field, {_there(f)} AS done, CASE WHEN {_there(f)} THEN least(1, round(confidence_score * {premium.FIELD_CONFIDENCE[f]}, 6)) ELSE 0 END AS confidence FROM analysis_rows" for f in premium.FIELDS)
MERGED = ["insured_name", "broker_name", "perils_covered", "total_sums_insured", "currency"]
STEPS["slip_keys"] = "SELECT *, coalesce('r:' || nullif(reference_number, ''), 'i:' || nullif(insured_name, ''), 'u:' || row_id) AS merge_key FROM analysis_rows"
_consistent = "SELECT row_id, tsi, premium, premium_rate, accepted_share, CAST(row_id % 80 AS double) AS retention, CAST(row_id % 7 AS int) AS period_from, CAST(row_id % 5 AS int) AS period_to FROM {premium_rows}"
_cells = "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 4 AS int) AS row, CASE o_orderkey % 5 WHEN 0 THEN 'Sum Insured' WHEN 1 THEN 'Gross Premium' WHEN 2 THEN 'Deductible' WHEN 3 THEN 'Insured Name' ELSE 'Broker' END AS column, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_custkey AS varchar(20)) END AS value, o_custkey AS custkey FROM {orders}"
WANTED = {"sum_insured": ["sum insured"], "premium": ["premium"], "deductible": ["deductible", "excess"], "insured": ["insured name"], "broker": ["broker"]}


def rows_of(t):
    return premium.derived(t.premium_rows, t.rates)


def checked_of(t):
    return premium.validated(t.analysis_rows)


def cells_of(t):
    return t.spark.sql(_cells, orders=t.orders).withColumn("doc_id", F.col("custkey"))


QUERIES = {
    "s4_normalised_headers": lambda t: premium.normalised(t.premium_rows.select("row_id", F.col("tsi").alias("Sum-Insured Total"), F.col("currency").alias(" Currency "))),
    "s7_rates_upsert": lambda t: premium.rates_upsert(t.nation_rates, t.supplier_rates).select("currency", F.round("kes_value", 6).alias("kes_value")),
    "s8_cross_rates": lambda t: premium.cross_rates(t.nation_quotes, "C0").select("currency", F.round("kes_value", 6).alias("kes_value")),
    "j13_rate_lookup": lambda t: premium.with_rates(t.premium_rows, t.rates).select("row_id", "original_currency", "rate"),
    "k19_derived": lambda t: rows_of(t).select("row_id", *R6(*DERIVED)),
    "k20_net_and_score": lambda t: premium.narrative(rows_of(t)).select("row_id", *R6("net_premium"), "liability", "risk_score", "narrative"),
    "a37_calculations": lambda t: premium.calculations(rows_of(t)).select("row_id", "metric", "formula", *R6("result")),
    "k21_validation": lambda t: premium.validation_summary(checked_of(t), "row_id", "valid").select("row_id", "n_errors", "n_warnings", "error_text", "valid"),
    "a22_validation_text": lambda t: premium.validation_summary(checked_of(t), "row_id"),
    "k22_completeness": lambda t: checked_of(t).select("row_id", "completeness", F.array_join("missing", "|").alias("missing")),
    "k23_field_confidence": lambda t: premium.field_confidence(t.analysis_rows).select("row_id", F.explode("field_confidence").alias("field", "confidence")).groupBy("row_id").agg(F.round(F.sum("confidence"), 4).alias("total"), F.count_if(F.col("confidence") > 0).alias("n")),
    "a20_field_completeness": lambda t: premium.completeness_by_field(t.analysis_rows),
    "a21_confidence_by_field": lambda t: premium.confidence_by_field(t.analysis_rows),
    "a23_notes": lambda t: premium.notes(checked_of(t), "row_id"),
    "k24_consistency": lambda t: premium.consistency(t.spark.sql(_consistent, premium_rows=t.premium_rows)).select("row_id", "rate_fits", "shares_fit", "period_fits"),
    "k25_summary": lambda t: premium.executive_summary(risk_of(t)),
    "k26_accepted_share": lambda t: premium.accepted(rows_of(t)).select("row_id", *[F.round(n, 5).alias(n) for n in ("share_liability_kes", "share_premium_kes")]),
    "k28_defaults": lambda t: premium.report_row(rows_of(t)).select("row_id", "insured", F.when(F.col("loss_ratio_text") == "NIL", "NIL").otherwise("given").alias("ratio_kind"), F.when(F.col("share_text") == "Open", "Open").otherwise("given").alias("share_kind")),
    "f14_report_fields": lambda t: premium.report_fields(t.analysis_rows),
    "a24_merged_slips": lambda t: consolidate.merged_slips(checked_of(t).withColumn("reference_number", F.when(F.col("row_id") % 3 > 0, F.concat(F.lit("R"), (F.col("row_id") % 500).cast("string")))), MERGED, notes="warnings").select("merge_key", *(F.col(m).cast("string").alias(m) for m in MERGED), "n_slips", "sources", *R4("confidence"), F.array_join("notes", "; ").alias("notes")),
    "j19_merge_passes": lambda t: consolidate.merge_passes(t.analysis_rows.select("row_id", "insured_name", "currency"), t.analysis_rows.select("row_id", F.when(F.col("row_id") % 2 == 0, "TBD").otherwise("second").alias("insured_name"), F.lit(None).cast("string").alias("currency")), "row_id", ["insured_name", "currency"]),
    "j20_last_values": lambda t: consolidate.last_values(t.analysis_rows, "source_document", ["date_received", "row_id"], ["insured_name", "currency"]),
    "x21_table_columns": lambda t: consolidate.pivoted_first(cells_of(t), WANTED),
}
_first = lambda f: f"arg_min({f}, row_id) FILTER ({_there(f)})::VARCHAR AS {f}"
_cols = lambda ws: " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in ws)
ORACLE = {
    "s4_normalised_headers": "SELECT row_id, tsi AS sum_insured_total, currency FROM premium_rows",
    "s7_rates_upsert": "SELECT currency, round(coalesce(s.kes_value, n.kes_value), 6) AS kes_value FROM nation_rates n FULL JOIN supplier_rates s USING (currency)",
    "s8_cross_rates": "SELECT currency, round(CASE WHEN currency = 'C0' THEN 1.0 ELSE (SELECT max(rate) FROM nation_quotes WHERE currency = 'C0' AND rate > 0) / rate END, 6)::DOUBLE AS kes_value FROM nation_quotes WHERE rate > 0",
    "j13_rate_lookup": "SELECT row_id, original_currency, rate FROM premium_base",
    "k19_derived": f"SELECT row_id, {SQL6(*DERIVED)} FROM premium_full",
    "k20_net_and_score": f"SELECT row_id, {SQL6('net_premium')}, liability, risk_score, CASE WHEN risk_score >= 8 OR loss_ratio > 100 THEN 'DECLINE' WHEN risk_score >= 6 OR loss_ratio > 75 THEN 'REFER' ELSE 'ACCEPT' END || ': risk score ' || format('{{:.1f}}', risk_score) || ', liability ' || liability AS narrative FROM premium_scored",
    "a37_calculations": "SELECT row_id, metric, formula, round(result, 6) AS result FROM (" + " UNION ALL ".join(f"SELECT row_id, '{m}' AS metric, '{f}' AS formula, {m} AS result FROM premium_full" for m, f in {"rate_percent": "premium / tsi * 100", "rate_permille": "premium / tsi * 1000", "loss_ratio": "incurred / earned premium * 100", "accepted_premium": "premium * share / 100", "accepted_liability": "tsi * share / 100", "net_premium": "premium - brokerage - taxes - levies"}.items()) + ") WHERE result IS NOT NULL",
    "k21_validation": "SELECT row_id, len(errors) AS n_errors, len(warnings) AS n_warnings, array_to_string(errors, '; ') AS error_text, valid FROM row_checked",
    "a22_validation_text": "SELECT row_id, len(errors) AS n_errors, len(warnings) AS n_warnings, array_to_string(errors, '; ') AS error_text, array_to_string(warnings, '; ') AS warning_text FROM row_checked",
    "k22_completeness": "SELECT row_id, completeness, array_to_string(missing, '|') AS missing FROM row_checked",
    "k23_field_confidence": "SELECT row_id, round(" + " + ".join(f"CASE WHEN {_there(f)} THEN least(1, round(confidence_score * {w}, 6)) ELSE 0 END" for f, w in premium.FIELD_CONFIDENCE.items()) + ", 4) AS total, " + " + ".join(f"CASE WHEN {_there(f)} AND confidence_score > 0 THEN 1 ELSE 0 END" for f in premium.FIELDS) + " AS n FROM analysis_rows",
    "a20_field_completeness": "SELECT field, count(*) FILTER (done) AS completed, count(*) AS total, round(count(*) FILTER (done) * 100.0 / count(*), 4) AS percent FROM field_flags GROUP BY 1",
    "a21_confidence_by_field": "SELECT field, round(avg(confidence), 4) AS mean, min(confidence) AS least, max(confidence) AS most, count(*) FILTER (confidence > 0) AS with_data, count(*) AS total FROM field_flags GROUP BY 1",
    "a23_notes": "SELECT row_id, note, CASE WHEN note IS NULL THEN 'None' WHEN contains(lower(note), 'error') OR contains(lower(note), 'must be') THEN 'Error' WHEN contains(lower(note), 'missing') THEN 'Missing' WHEN contains(lower(note), 'completeness') THEN 'Completeness' ELSE 'Info' END AS kind FROM (SELECT row_id, unnest(CASE WHEN len(warnings) = 0 THEN [NULL] ELSE warnings END) AS note FROM row_checked)",
    "k24_consistency": "SELECT row_id, abs(premium - tsi * premium_rate / 100) <= 0.01 * abs(tsi * premium_rate / 100) AS rate_fits, row_id % 80 + coalesce(accepted_share, 0) <= 100 AS shares_fit, row_id % 7 <= row_id % 5 AS period_fits FROM premium_rows",
    "k25_summary": "SELECT application_id, 'Application ' || application_id || ' has ' || lower(risk_level) || ' risk. ' || remark AS summary, remark, CASE risk_level WHEN 'HIGH' THEN 'Accept with conditions' WHEN 'CRITICAL' THEN 'Decline' ELSE 'Accept' END AS proposal FROM (SELECT *, CASE risk_level WHEN 'LOW' THEN 'Risk is well within appetite.' WHEN 'MEDIUM' THEN 'Risk is within appetite on standard terms.' WHEN 'HIGH' THEN 'Risk needs enhanced terms.' ELSE 'Risk is outside appetite.' END AS remark FROM risk_full)",
    "k26_accepted_share": "SELECT row_id, round(tsi_kes * (coalesce(nullif(accepted_share, 0), 1.0) / 100), 5) AS share_liability_kes, round(premium_kes * (coalesce(nullif(accepted_share, 0), 1.0) / 100), 5) AS share_premium_kes FROM premium_full",
    "k28_defaults": "SELECT row_id, coalesce(insured_name, 'TBA') AS insured, CASE WHEN loss_ratio IS NULL THEN 'NIL' ELSE 'given' END AS ratio_kind, CASE WHEN accepted_share IS NULL THEN 'Open' ELSE 'given' END AS share_kind FROM premium_full",
    "f14_report_fields": "SELECT row_id, " + ", ".join({"date": f"coalesce(strftime({f}, '%Y-%m-%d'), 'TBA')", "money": f"coalesce(coalesce(currency || ' ', '') || format('{{:,.2f}}', {f}::DOUBLE), 'TBA')", "percent": f"coalesce({f}::VARCHAR || '%', 'TBA')", "text": f"coalesce(nullif({f}, ''), 'TBA')"}[k] + f" AS {f}" for f, k in premium.REPORT_FIELDS.items()) + " FROM analysis_rows",
    "a24_merged_slips": f"SELECT merge_key, {', '.join(map(_first, MERGED))}, count(*) AS n_slips, string_agg(DISTINCT source_document, '|' ORDER BY source_document) AS sources, round(avg(confidence_score) FILTER (confidence_score > 0), 4) AS confidence, concat_ws('; ', nullif(string_agg(nullif(array_to_string(warnings, '; '), ''), '; ' ORDER BY row_id), ''), CASE WHEN count(*) > 1 THEN 'Merged data from ' || count(*) || ' documents' END) AS notes FROM (SELECT *, coalesce(CASE WHEN row_id % 3 > 0 THEN 'r:R' || row_id % 500 END, 'i:' || nullif(insured_name, ''), 'u:' || row_id) AS merge_key FROM row_checked) GROUP BY 1",
    "j19_merge_passes": "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN insured_name ELSE 'second' END AS insured_name, currency FROM analysis_rows",
    "j20_last_values": "SELECT source_document, arg_max(insured_name, (coalesce(date_received, '0001-01-01'::TIMESTAMP), row_id)) FILTER (insured_name IS NOT NULL) AS insured_name, arg_max(currency, (coalesce(date_received, '0001-01-01'::TIMESTAMP), row_id)) FILTER (currency IS NOT NULL) AS currency FROM analysis_rows GROUP BY 1",
    "x21_table_columns": "SELECT o_custkey AS doc_id, " + ", ".join(f"arg_min(value, (r, \"column\", value)) FILTER (({_cols(ws)}) AND value IS NOT NULL) AS {f}" for f, ws in WANTED.items()) + " FROM (SELECT o_custkey, o_orderkey % 4 AS r, CASE o_orderkey % 5 WHEN 0 THEN 'Sum Insured' WHEN 1 THEN 'Gross Premium' WHEN 2 THEN 'Deductible' WHEN 3 THEN 'Insured Name' ELSE 'Broker' END AS \"column\", CASE WHEN o_orderkey % 6 > 0 THEN o_custkey::VARCHAR END AS value FROM orders) GROUP BY 1",
}
ORACLE_SQL = {k: oracle(v) for k, v in ORACLE.items()}
