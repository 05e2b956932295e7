"""Queries of limits and decisions, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sqltext as S
from tidemark.operators import decision, limits
from tidemark.plans.oracle import STEPS, oracle
from tidemark.plans.risk_queries import SQL4, R4, risk_of

_searched = "lower(concat_ws(' ', coalesce(location, ''), coalesce(p.industry_sector, ''), coalesce(occupancy, '')))"
STEPS["limit_detected"] = f"""
    SELECT *, {S.first_class(S.low('location'), limits.REGIONS)} AS region, {S.first_class(S.low('industry_sector'), limits.SECTORS)} AS sector,
           CASE WHEN coalesce(location, '') <> '' THEN {S.first_class(S.low('location'), limits.CAT_CLASSES, 'low_cat_risk')} END AS cat_class
    FROM risk_parameters"""
_over = "nullif(asset_value, 0) > nullif(max_amount, 0)"
_weak = "(nullif(assets, 0) IS NULL OR nullif(liabilities, 0) IS NULL OR (assets - liabilities)::DOUBLE / assets::DOUBLE < 0.1)"
STEPS["limit_found"] = f"""
    SELECT application_id, limit_id, limit_type,
           CASE limit_type WHEN 'asset_value' THEN 'ERROR' WHEN 'coverage_limit' THEN 'ERROR' WHEN 'industry_sector' THEN CASE WHEN max_amount = 0 THEN 'CRITICAL' ELSE 'WARNING' END
                WHEN 'construction_type' THEN CASE WHEN max_amount = 0 THEN 'ERROR' ELSE 'WARNING' END WHEN 'occupancy_type' THEN CASE WHEN max_amount = 0 THEN 'ERROR' ELSE 'WARNING' END
                WHEN 'regulatory_compliance' THEN CASE WHEN category = 'sanctions_check' THEN 'CRITICAL' ELSE 'ERROR' END WHEN 'aggregate_exposure' THEN 'ERROR' ELSE 'WARNING' END AS severity,
           CASE limit_type WHEN 'asset_value' THEN 'Asset value ' || asset_value || ' exceeds maximum limit of ' || max_amount WHEN 'coverage_limit' THEN 'Coverage limit ' || coverage_limit || ' exceeds maximum limit of ' || max_amount
                WHEN 'geographic_exposure' THEN 'Asset value ' || asset_value || ' in region ''' || region || ''' exceeds regional limit of ' || max_amount
                WHEN 'industry_sector' THEN CASE WHEN max_amount = 0 THEN 'Industry sector ''' || sector || ''' is restricted' ELSE 'Asset value ' || asset_value || ' in sector ''' || sector || ''' exceeds sector limit of ' || max_amount END
                WHEN 'construction_type' THEN 'Construction type ''' || construction_type || ''' exceeds limit of ' || max_amount WHEN 'occupancy_type' THEN 'Occupancy ''' || occupancy || ''' exceeds limit of ' || max_amount
                WHEN 'financial_strength' THEN CASE WHEN category = 'credit_rating' THEN 'Credit rating ''' || credit_rating || ''' may not meet minimum requirements' ELSE 'Assets ' || assets || ' below minimum requirement of ' || max_amount END
                WHEN 'regulatory_compliance' THEN CASE WHEN category = 'sanctions_check' THEN 'Potential sanctions or restricted entity detected' ELSE 'May not meet regulatory capital requirements' END
                WHEN 'catastrophe_exposure' THEN 'Asset value ' || asset_value || ' in ' || cat_class || ' catastrophe zone exceeds limit of ' || max_amount ELSE 'Aggregate exposure ' || asset_value || ' exceeds limit of ' || max_amount END AS message
    FROM limit_detected p JOIN financial_data f USING (application_id), business_limits l
    WHERE active AND CASE limit_type WHEN 'asset_value' THEN {_over} WHEN 'coverage_limit' THEN nullif(coverage_limit, 0) > nullif(max_amount, 0) WHEN 'geographic_exposure' THEN region = geographic_region AND {_over}
        WHEN 'industry_sector' THEN sector = l.industry_sector AND (max_amount = 0 OR {_over}) WHEN 'construction_type' THEN contains(lower(construction_type), category) AND (max_amount = 0 OR {_over})
        WHEN 'occupancy_type' THEN contains(lower(occupancy), category) AND (max_amount = 0 OR {_over})
        WHEN 'financial_strength' THEN (category = 'credit_rating' AND credit_rating IS NOT NULL AND {S.lookup('upper(credit_rating)', limits.RATING_RANK, -10)} < 2) OR (category = 'minimum_assets' AND nullif(assets, 0) < nullif(max_amount, 0))
        WHEN 'regulatory_compliance' THEN (category = 'sanctions_check' AND {S.has(_searched, *limits.SANCTIONS)}) OR (category = 'capital_requirements' AND {_weak})
        WHEN 'catastrophe_exposure' THEN cat_class = category AND {_over} WHEN 'aggregate_exposure' THEN {_over} END"""
STEPS["limit_count"] = "SELECT application_id, count(*) AS n FROM limit_found GROUP BY 1"
_moving = "CASE trend WHEN 'decreasing' THEN {} WHEN 'stable' THEN {} ELSE {} END"
_often = "CASE WHEN frequency < 0.5 THEN {} WHEN frequency < 1 THEN {} WHEN frequency < 2 THEN {} ELSE {} END"
STEPS["decision_base"] = f"""
    SELECT * EXCLUDE (total), round(greatest(0, 100 - overall_score), 6) AS s0, round(CASE credit_risk WHEN 'LOW' THEN least(100, fin * 1.1) WHEN 'HIGH' THEN fin * 0.8 WHEN 'CRITICAL' THEN fin * 0.6 ELSE fin END, 6) AS s1,
           round(greatest(0, least(100, 70.0::DOUBLE + {_often.format(20, 10, -10, -25)} + {_moving.format(15, 0, -20)} + greatest(-15, -volatility * 10))), 6) AS s2,
           round(greatest(0, least(100, greatest(0, 100 - cat_score * 10) + {S.lookup('zone', decision.ZONE_SHIFT, 0.0)}::DOUBLE)), 6) AS s3, CASE WHEN nv > 0 THEN 0.0 ELSE 100.0 END::DOUBLE AS s4,
           {S.lookup('risk_level', decision.LEVEL_TEXT, None)} AS t0, {S.lookup('credit_risk', decision.CREDIT_TEXT, None)} AS t1,
           'Loss history shows ' || {_often.format("'low loss frequency'", "'moderate loss frequency'", "'high loss frequency'", "'very high loss frequency'")} || ' and ' || {_moving.format("'improving loss trend'", "'stable loss pattern'", "'worsening loss trend'")} AS t2,
           'Catastrophe exposure in ' || zone || ' risk zone' || CASE WHEN cat_score > 7 THEN ' raises significant concerns' WHEN cat_score < 3 THEN ' is manageable' ELSE ' requires monitoring' END AS t3,
           CASE WHEN nv > 0 THEN 'Business limit violations: ' || nv ELSE 'All business limits satisfied' END AS t4
    FROM (SELECT *, least(100, financial_score * 1.2) AS fin, coalesce(n2, 0) AS nv FROM risk_full LEFT JOIN (SELECT application_id, n AS n2 FROM limit_count) USING (application_id))"""
_names, _weights = list(decision.WEIGHTS), list(decision.WEIGHTS.values())
_scores = ["s0", "s1", "s2", "s3", "s4", "85.0::DOUBLE", "70.0::DOUBLE", "79.0::DOUBLE"]
_sure = ["risk_confidence", "0.8", "0.9", "0.8", "0.95", "0.7", "0.6", "0.5"]
_texts = ["t0", "t1", "t2", "t3", "t4", "'Standard regulatory requirements apply'", "'Market conditions are neutral with 75% capacity utilization'", "'Portfolio shows moderate concentration risk'"]
STEPS["decision_factors"] = " UNION ALL ".join(f"SELECT application_id, {k} AS place, '{_names[k]}' AS factor, {_scores[k]} AS score, {_weights[k]}::DOUBLE AS weight, {_sure[k]}::DOUBLE AS confidence, {_texts[k]} AS rationale FROM decision_base" for k in range(8))
STEPS["decision_total"] = "SELECT application_id, sum(score * weight) AS total, sum(confidence * weight) AS sure, var_pop(score) AS variance FROM decision_factors GROUP BY 1"
STEPS["decision_full"] = """
    SELECT *, greatest(0, least(1, round(sure + CASE decision WHEN 'APPROVE' THEN CASE WHEN total >= 80 THEN 0.1 WHEN total >= 70 THEN 0.05 ELSE -0.1 END WHEN 'REJECT' THEN CASE WHEN total <= 20 THEN 0.1 WHEN total <= 30 THEN 0.05 ELSE -0.1 END ELSE -0.05 END
             + CASE WHEN variance < 100 THEN 0.1 WHEN variance > 400 THEN -0.1 ELSE 0 END, 6))) AS confidence,
           list_filter([CASE WHEN s1 < 60 THEN 'premium_adjustment:Premium loading of 15% for financial risk' END, CASE WHEN s2 < 60 THEN 'deductible:Increased deductible to 5% of sum insured' END, CASE WHEN s3 < 60 THEN 'coverage_limit:Catastrophe exposure limit of 80% of total sum insured' END,
                        CASE WHEN risk_level IN ('HIGH', 'CRITICAL') THEN 'exclusion:Exclude coverage for acts of terrorism' END], lambda x: x IS NOT NULL) AS terms,
           CASE WHEN raised > 0.01 THEN raised END AS premium_adjustment
    FROM (SELECT *, CASE WHEN nv > 0 THEN 'REJECT' WHEN total >= 70 THEN 'APPROVE' WHEN total <= 30 THEN 'REJECT' ELSE 'CONDITIONAL' END AS decision,
                 round(least(0.5, CASE WHEN s1 < 60 THEN 0.15 ELSE 0 END + CASE WHEN overall_score > 60 THEN (overall_score - 50) * 0.01 ELSE 0 END), 6) AS raised FROM decision_base JOIN decision_total USING (application_id))"""
STEPS["decision_ranked"] = "SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY score * weight DESC, place) AS rn FROM decision_factors"
STEPS["decision_lists"] = """
    SELECT application_id, list(rationale ORDER BY rn) FILTER (rn <= 2) AS primary_reasons, list(rationale ORDER BY rn) FILTER (rn IN (3, 4) AND score >= 60) AS supporting, list(rationale ORDER BY rn) FILTER (score >= 80) AS mitigating,
           list(rationale ORDER BY rn) FILTER (score < 50) AS addressed, list('High confidence in ' || factor ORDER BY place) FILTER (confidence >= 0.8) AS confidence_factors, list(factor ORDER BY rn) FILTER (rn <= 3) AS top,
           list(rationale ORDER BY place) FILTER (score >= 70) AS good, list(rationale ORDER BY place) FILTER (score < 50) AS bad
    FROM decision_ranked GROUP BY 1"""


def found_of(t):
    return limits.violations(t.risk_parameters, t.financial_data, t.business_limits)


def decided_of(t):
    return decision.decided(risk_of(t), limits.summary(t.applications, found_of(t)))


def _one_type(name):
    return lambda t: found_of(t).where(F.col("limit_type") == name).select("application_id", "limit_id", "severity", "message")


J_TYPES = dict(zip(("j3_asset_limit", "j4_coverage_limit", "j5_geographic_limit", "j6_industry_limit", "j7_construction_limit", "j8_occupancy_limit", "j9_financial_limit", "j10_regulatory_limit", "j11_catastrophe_limit", "j12_aggregate_limit"), limits.TYPES, strict=True))
_pipe = lambda c: F.array_join(c, "|").alias(c)
_p = lambda c: f"coalesce(array_to_string({c}, '|'), '') AS {c}"
LISTS = ("primary_reasons", "supporting", "mitigating", "addressed", "confidence_factors")

QUERIES = {name: _one_type(kind) for name, kind in J_TYPES.items()} | {
    "u1_all_violations": lambda t: found_of(t).select("application_id", "limit_id", "limit_type", "severity"),
    "k27_detected": lambda t: limits.detected(t.risk_parameters).select("application_id", "region", "sector", "cat_class"),
    "a3_violation_summary": lambda t: limits.summary(t.applications, found_of(t)),
    "a3_violations_by_type": lambda t: limits.by_type(found_of(t)),
    "a4_check_type": lambda t: limits.check_type(found_of(t), "asset_value"),
    "a5_limit_configuration": lambda t: limits.configuration(t.portfolio_limits),
    "a6_limit_advice": lambda t: limits.advice(found_of(t)),
    "f7_limits_lookup": lambda t: t.portfolio_limits.where("active AND limit_type = 'asset_value'").select("limit_id", "category", F.col("max_amount").cast("double").alias("max_amount")),
    "f15_limit_updates": lambda t: limits.updated(t.portfolio_limits, t.limit_updates).select("limit_id", "limit_type", F.col("max_amount").cast("double").alias("max_amount"), "active"),
    "k14_factors": lambda t: decided_of(t).select("application_id", F.explode("factors").alias("f")).select("application_id", "f.factor", "f.score", "f.weight", F.round("f.confidence", 4).alias("confidence"), "f.rationale"),
    "k15_decision": lambda t: decided_of(t).select("application_id", F.round("total", 8).alias("total"), "decision"),
    "k16_decision_confidence": lambda t: decided_of(t).select("application_id", "confidence", (F.col("variance") > 400).alias("disagree")),
    "k17_terms": lambda t: decided_of(t).select("application_id", _pipe("terms"), *R4("premium_adjustment")),
    "k18_rationale": lambda t: decision.explained(decided_of(t)).select("application_id", "rationale", *map(_pipe, LISTS)),
    "w2_top_factors": lambda t: decision.explained(decided_of(t)).select("application_id", F.array_join(F.transform("top", lambda f: f["factor"]), "|").alias("top")),
}

_some = lambda xs, n, head: f"CASE WHEN len({xs}) > 0 THEN '{head}' || array_to_string({xs}[1:{n}], '; ') || '. ' ELSE '' END"
_advice = " UNION ALL ".join(
    f"SELECT application_id, {k} AS place, " + (f"replace('{w}', '{{}}', count(*)::VARCHAR)") + f" AS w, '{r}' AS r FROM limit_found WHERE limit_type = '{t}'" + (" AND severity = 'CRITICAL'" if t == "industry_sector" else "") + " GROUP BY 1" for k, (t, (w, r)) in enumerate(limits.ADVICE.items()))
ORACLE = {name: f"SELECT application_id, limit_id, severity, message FROM limit_found WHERE limit_type = '{kind}'" for name, kind in J_TYPES.items()} | {
    "u1_all_violations": "SELECT application_id, limit_id, limit_type, severity FROM limit_found",
    "k27_detected": "SELECT application_id, region, sector, cat_class FROM limit_detected",
    "a3_violation_summary": "SELECT application_id, count(limit_id) AS n, count(*) FILTER (severity = 'WARNING') AS n_warning, count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'CRITICAL') AS n_critical, coalesce(string_agg(DISTINCT limit_type, '|' ORDER BY limit_type), '') AS types, count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) = 0 AS passed FROM applications LEFT JOIN limit_found USING (application_id) GROUP BY application_id",
    "a3_violations_by_type": "SELECT limit_type, severity, count(*) AS n, count(DISTINCT application_id) AS applications FROM limit_found GROUP BY 1, 2",
    "a4_check_type": "SELECT application_id, count(*) AS n, max(message) AS message FROM limit_found WHERE limit_type = 'asset_value' GROUP BY 1",
    "a5_limit_configuration": "SELECT limit_type, count(*) AS n, count(*) FILTER (active) AS n_active, max(max_amount)::DOUBLE AS most FROM portfolio_limits GROUP BY 1",
    "a6_limit_advice": f"SELECT application_id, string_agg(w, '|' ORDER BY place) AS warnings, string_agg(r, '|' ORDER BY place) AS recommendations FROM ({_advice}) GROUP BY 1",
    "f7_limits_lookup": "SELECT limit_id, category, max_amount::DOUBLE AS max_amount FROM portfolio_limits WHERE active AND limit_type = 'asset_value'",
    "f15_limit_updates": "SELECT limit_id, limit_type, coalesce(u.max_amount, p.max_amount)::DOUBLE AS max_amount, coalesce(u.active, p.active) AS active FROM portfolio_limits p LEFT JOIN limit_updates u USING (limit_id)",
    "k14_factors": "SELECT application_id, factor, score, weight, round(confidence, 4) AS confidence, rationale FROM decision_factors",
    "k15_decision": "SELECT application_id, round(total, 8) AS total, decision FROM decision_full",
    "k16_decision_confidence": "SELECT application_id, confidence, variance > 400 AS disagree FROM decision_full",
    "k17_terms": f"SELECT application_id, {_p('terms')}, {SQL4('premium_adjustment')} FROM decision_full",
    "k18_rationale": f"""SELECT application_id, CASE decision WHEN 'APPROVE' THEN 'Recommendation: APPROVE. ' || {_some('good', 2, 'Strong supporting factors include: ')} || {_some('bad', 1, 'Minor concerns: ')} || 'Overall risk profile is acceptable for standard terms.'
        WHEN 'REJECT' THEN 'Recommendation: REJECT. ' || {_some('bad', 2, 'Significant concerns include: ')} || 'Risk profile exceeds acceptable thresholds.'
        ELSE 'Recommendation: CONDITIONAL APPROVAL. Mixed risk profile requires specific terms and conditions. ' || {_some('good', 1, 'Supporting factors: ')} || {_some('bad', 1, 'Areas of concern: ')} || 'Conditional terms can mitigate identified risks.' END AS rationale,
        {', '.join(map(_p, LISTS))} FROM decision_full JOIN decision_lists USING (application_id)""",
    "w2_top_factors": "SELECT application_id, array_to_string(top, '|') AS top FROM decision_lists",
}
ORACLE_SQL = {k: oracle(v) for k, v in ORACLE.items()}
