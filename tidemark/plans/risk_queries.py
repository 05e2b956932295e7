"""Queries of loss history and risk, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sqltext as S
from tidemark.operators import loss, risk
from tidemark.plans.oracle import STEPS, oracle
from tidemark.sources.adapters import Tables

R4 = lambda *names: [F.round(n, 4).alias(n) for n in names]
SQL4 = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)

STEPS["loss_base"] = """
    SELECT application_id, count(*) AS n_events, sum(amount::DOUBLE) AS total, max(amount::DOUBLE) AS largest, avg(amount::DOUBLE) AS mean, stddev_pop(amount::DOUBLE) AS std,
           quantile_cont(amount::DOUBLE, 0.5) AS median, quantile_cont(amount::DOUBLE, 0.95) AS p95, quantile_cont(amount::DOUBLE, 0.99) AS p99, kurtosis_pop(amount::DOUBLE) AS kurtosis,
           greatest(floor(epoch(max(event_date) - min(event_date)) / 86400) / 365.25, 1.0) AS years,
           count(*) AS n, regr_slope(amount::DOUBLE, epoch(event_date) / 86400.0 - 10000.0) AS slope0, corr(amount::DOUBLE, epoch(event_date) / 86400.0 - 10000.0) AS r0, max(event_date) > min(event_date) AS spread
    FROM loss_events GROUP BY application_id"""
STEPS["loss_cubes"] = "SELECT application_id, sum(((amount::DOUBLE - mean) / std) ** 3) / count(*) AS skew FROM loss_events JOIN loss_base USING (application_id) WHERE std > 0 GROUP BY application_id"
STEPS["loss_p"] = """
    SELECT *, CASE WHEN r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0 WHEN df % 2 = 0
             THEN 1 - sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * k)))
             ELSE 1 - 2 / pi() * (th + coalesce(sin(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos(th), 2 * k + 1))), 0)) END AS p
    FROM (SELECT *, n - 2 AS df, CASE WHEN abs(r) < 1 THEN atan(abs(r) / sqrt(1 - r * r)) END AS th
          FROM (SELECT *, CASE WHEN n >= 3 AND spread AND NOT isnan(r0) THEN greatest(-1.0, least(1.0, r0)) END AS r, CASE WHEN n >= 3 AND spread AND NOT isnan(r0) THEN slope0 END AS slope FROM loss_base))"""
STEPS["loss_full"] = """
    SELECT application_id, coalesce(n_events, 0) AS n_events, coalesce(total, 0) AS total, coalesce(largest, 0) AS largest, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, coalesce(total / years, 0) AS annual, coalesce(n_events / years, 0) AS frequency,
           coalesce(vol, 0) AS volatility, coalesce(trend, 'stable') AS trend,
           CASE WHEN n_events > 0 THEN least(1, least(1, n_events / 10.0::DOUBLE) * 0.4 + least(1, years / 5) * 0.3 + greatest(0.1, 1 - least(vol, 1)) * 0.2 + coalesce(abs(r), 0) * 0.1) ELSE 0 END AS loss_confidence,
           CASE WHEN n_events IS NULL THEN 10.0 ELSE greatest(0, least(100, least(50, n_events / years * 10) + least(30, vol * 30) + CASE trend WHEN 'increasing' THEN 20 WHEN 'decreasing' THEN -10 ELSE 0 END)) END AS loss_score
    FROM applications LEFT JOIN (SELECT *, CASE WHEN n_events > 1 AND mean > 0 THEN std / mean ELSE 0 END AS vol, CASE WHEN p < 0.05 THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'stable' END AS trend FROM loss_p) USING (application_id)"""

_place, _asset, _built = S.low("location"), S.low("asset_type"), S.low("construction_type")
STEPS["cat_base"] = f"""
    SELECT *, {S.first_key(_place, risk.ZONES, 'moderate')} AS zone, {S.first_key(_asset, risk.ASSET_MODIFIER, 1.0)} AS modifier,
           list_sort(list_distinct(list_concat(CASE {' '.join(f"WHEN contains({_place}, '{k}') THEN {v!r}" for k, v in risk.PERILS.items())} ELSE ['flood'] END,
               {S.listed((S.has(_asset, 'technology', 'data'), "'cyber'"), (S.has(_asset, 'chemical', 'oil'), "'terrorism'"))}))) AS perils,
           {S.listed((S.has(_built, 'concrete', 'steel'), "'Fire-resistant construction'"), (S.has(_built, 'sprinkler'), "'Sprinkler system'"), (S.has(_asset, 'technology'), "'Cyber security measures'"), (S.has(_asset, 'industrial'), "'Industrial safety protocols'"))} AS mitigations
    FROM risk_parameters"""
STEPS["cat_full"] = f"""
    SELECT *, greatest(0, base * modifier - len(mitigations) * 0.05) AS cat_score,
           round(CASE WHEN coalesce(asset_value, 0) <> 0 THEN asset_value::DOUBLE * least(1, {S.lookup('zone', risk.ZONE_PML, 0.2)}::DOUBLE * modifier) ELSE 0 END, 2) AS pml, 0.5 + {S.lookup('zone', risk.ZONE_CONCENTRATION, 0.0)}::DOUBLE AS concentration,
           least(1, 0.5::DOUBLE + CASE WHEN length(coalesce(location, '')) > 10 THEN 0.2 ELSE 0 END + CASE WHEN coalesce(asset_type, '') <> '' THEN 0.2 ELSE 0 END + CASE WHEN coalesce(construction_type, '') <> '' THEN 0.1 ELSE 0 END) AS cat_confidence,
           flatten(list_filter([{', '.join(f"CASE WHEN contains({_asset}, '{k}') THEN {v!r} END" for k, v in risk.ASSET_RISKS.items())}], lambda x: x IS NOT NULL)) AS asset_risks
    FROM (SELECT *, {S.lookup('zone', risk.ZONE_SCORE, 4.0)}::DOUBLE * (1 + (len(perils) - 1) * 0.2::DOUBLE) AS base FROM (SELECT * REPLACE (modifier::DOUBLE AS modifier) FROM cat_base))"""
STEPS["fin_ratios"] = """
    SELECT *, d / a AS debt_to_asset, (a - d) / a AS equity_ratio, r / a AS asset_turnover, r / d AS revenue_to_debt
    FROM (SELECT *, nullif(assets::DOUBLE, 0) AS a, nullif(liabilities::DOUBLE, 0) AS d, nullif(revenue::DOUBLE, 0) AS r FROM financial_data)"""
STEPS["fin_scores"] = f"""
    SELECT *, round(least(100, (liquidity * 0.2 + solvency * 0.3 + profitability * 0.2 + stability * 0.2 + 0.5 * 0.1) * 100), 6) AS financial_score
    FROM (SELECT *, CASE WHEN equity_ratio IS NULL THEN 0.5 ELSE least(1, equity_ratio * 2) END AS liquidity, CASE WHEN debt_to_asset IS NULL THEN 0.5 ELSE greatest(0, 1 - debt_to_asset) END AS solvency, CASE WHEN asset_turnover IS NULL THEN 0.5 ELSE least(1, asset_turnover) END AS profitability, ({S.lookup('credit_rating', risk.STABILITY, 0.5)})::DOUBLE AS stability FROM fin_ratios)"""


def _bands(steps: list, last: str) -> str:
    return "CASE " + " ".join(f"WHEN financial_score >= {a} THEN '{n}'" for a, n in steps) + f" ELSE '{last}' END"


STEPS["fin_full"] = f"""
    SELECT *, {_bands(risk.RATING_STEPS, 'D')} AS rating, {_bands(risk.CREDIT_STEPS, 'CRITICAL')} AS credit_risk,
           {S.listed(('financial_score < 50', "'Overall financial strength is below acceptable levels'"), ('debt_to_asset > 0.7', "'High debt-to-asset ratio indicates leverage risk'"), ("coalesce(credit_rating, '') = ''", "'No credit rating available for assessment'"), ("credit_rating IN ('CCC', 'D')", "'Poor credit rating indicates high default risk'"))} AS financial_concerns,
           least(1, round(0.3::DOUBLE + CASE WHEN coalesce(revenue, 0) <> 0 THEN 0.15 ELSE 0 END + CASE WHEN coalesce(assets, 0) <> 0 THEN 0.15 ELSE 0 END + CASE WHEN coalesce(liabilities, 0) <> 0 THEN 0.15 ELSE 0 END + CASE WHEN credit_rating IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN financial_strength_rating IS NOT NULL THEN 0.1 ELSE 0 END, 4)) AS financial_confidence
    FROM fin_scores"""
STEPS["component_full"] = f"""
    SELECT application_id, least(100, 50.0::DOUBLE * {S.lookup("replace(" + S.low("industry_sector") + ", ' ', '_')", risk.SECTOR_FACTOR, 1.0)} * CASE WHEN {S.has(_built, 'concrete', 'steel')} THEN 0.8 WHEN {S.has(_built, 'wood')} THEN 1.2 ELSE 1.0 END) AS asset_score,
           CASE WHEN coalesce(location, '') = '' THEN 50.0 ELSE {S.lookup('zone', risk.ZONE_RISK, 40.0)} END::DOUBLE AS geographic_score FROM cat_base"""
STEPS["risk_full"] = """
    SELECT *, round(raw, 2) AS overall_score, round(loss_confidence * 0.25 + cat_confidence * 0.30 + financial_confidence * 0.20 + 0.8::DOUBLE * 0.15 + 0.7::DOUBLE * 0.10, 3) AS risk_confidence,
           CASE WHEN raw <= 25 THEN 'LOW' WHEN raw <= 50 THEN 'MEDIUM' WHEN raw <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
    FROM (SELECT *, loss_score::DOUBLE * 0.25 + cat_risk * 0.30 + financial_risk * 0.20 + asset_score * 0.15 + geographic_score * 0.10 AS raw
          FROM (SELECT *, least(100, cat_score * 10) AS cat_risk, 100.0 - financial_score AS financial_risk FROM loss_full JOIN cat_full USING (application_id) JOIN fin_full USING (application_id) JOIN component_full USING (application_id)))"""
_recommend = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in risk.RECOMMEND.items())
STEPS["advice_full"] = f"""
    SELECT application_id, risk_level,
           list_concat(CASE risk_level {_recommend} END, {S.listed(("trend = 'increasing'", "'Address increasing loss trend before approval'"), ('cat_score > 8', "'High catastrophe exposure - consider aggregate limits'"), ('financial_score < 60', "'Financial strength concerns - require guarantees'"))}) AS recommendations,
           list_concat({S.listed(('overall_score > 75', "'Overall risk score exceeds acceptable thresholds'"), ('frequency > 2', "'High loss frequency indicates systemic issues'"), ('volatility > 1', "'High loss volatility creates unpredictable exposure'"), ('cat_score > 8', "'Extreme catastrophe exposure in high-risk zone'"), ("credit_risk IN ('HIGH', 'CRITICAL')", "'Financial strength raises solvency concerns'"))}, financial_concerns) AS concerns,
           list_concat(CASE WHEN cat_score > 6 THEN ['Implement catastrophe risk reduction measures', 'Consider catastrophe insurance or reinsurance'] ELSE [] END,
               list_filter(list_transform(perils, lambda p: {S.lookup('p', risk.PERIL_ADVICE, None)}), lambda x: x IS NOT NULL),
               CASE WHEN financial_score < 70 THEN ['Improve financial position through debt reduction', 'Consider financial guarantees or collateral'] ELSE [] END,
               {S.listed((S.has(_built, 'wood'), "'Upgrade to fire-resistant construction materials'"))}) AS suggestions
    FROM risk_full"""


def risk_of(t: Tables):
    return risk.overall_risk(t.applications, t.loss_events, t.risk_parameters, t.financial_data)


STATS = ("total", "largest", "mean", "median", "std", "skew", "kurtosis", "p95", "p99", "years", "annual", "frequency", "volatility")
REPORT = ("loss_score", "cat_risk", "financial_risk", "asset_score", "geographic_score")
_joined = lambda c: F.array_join(c, "|").alias(c)
_listsql = lambda c: f"array_to_string({c}, '|') AS {c}"
CAT = ("base", "modifier", "cat_score", "concentration", "cat_confidence")

QUERIES = {
    "a1_loss_stats": lambda t: loss.loss_stats(t.loss_events).select("application_id", "n_events", *R4(*STATS)),
    "a2_loss_trend": lambda t: loss.loss_trend(t.loss_events).select("application_id", "n_events", *R4("slope", "r", "p"), "trend"),
    "k1_loss_confidence": lambda t: loss.loss_analysis(t.applications, t.loss_events).select("application_id", *R4("loss_confidence")),
    "j2_loss_join": lambda t: loss.loss_analysis(t.applications, t.loss_events).select("application_id", "n_events", "trend", *R4("total", "annual", "frequency", "volatility")),
    "k2_zone": lambda t: t.risk_parameters.select("application_id", risk.zone(F.col("location")).alias("zone")),
    "k3_perils": lambda t: t.risk_parameters.select("application_id", risk.perils(F.col("location"), F.col("asset_type")).alias("perils")).select("application_id", _joined("perils")),
    "k4_cat_score": lambda t: risk.catastrophe_exposure(t.risk_parameters).select("application_id", *R4("base", "modifier", "cat_score")),
    "k5_pml": lambda t: risk.catastrophe_exposure(t.risk_parameters).select("application_id", "pml"),
    "k6_cat_details": lambda t: risk.catastrophe_exposure(t.risk_parameters).select("application_id", *R4("concentration", "cat_confidence"), _joined("mitigations"), _joined("asset_risks"), F.array_join(F.array_sort(F.map_keys("seasons")), "|").alias("seasons")),
    "k7_ratios": lambda t: risk.financial_strength(t.financial_data).select("application_id", *R4("debt_to_asset", "equity_ratio", "asset_turnover", "revenue_to_debt", "liquidity", "solvency", "profitability", "stability")),
    "k8_financial_score": lambda t: risk.financial_strength(t.financial_data).select("application_id", "financial_score"),
    "k9_rating": lambda t: risk.financial_strength(t.financial_data).select("application_id", "rating", "credit_risk", _joined("financial_concerns"), *R4("financial_confidence")),
    "k10_component_scores": lambda t: risk.component_scores(t.risk_parameters).join(loss.loss_analysis(t.applications, t.loss_events), "application_id").select("application_id", *R4("loss_score", "asset_score", "geographic_score")),
    "k11_overall_risk": lambda t: risk_of(t).select("application_id", "overall_score", "risk_level", "risk_confidence"),
    "k12_advice": lambda t: risk.risk_advice(risk_of(t), t.risk_parameters).select("application_id", _joined("recommendations"), _joined("concerns"), _joined("suggestions")),
    "k13_risk_report": lambda t: risk.risk_report(t.applications, t.loss_events, t.risk_parameters, t.financial_data).select("application_id", "overall_score", "risk_level", "risk_confidence", *R4(*REPORT), "n_recommendations", "n_concerns", "n_suggestions"),
    "j1_children": lambda t: t.applications.join(t.risk_parameters, "application_id", "left").join(t.financial_data, "application_id", "left").join(t.recommendations, "application_id", "left").select("application_id", "status", F.col("asset_value").cast("double").alias("asset_value"), F.col("assets").cast("double").alias("assets"), "decision"),
}

_seasons = "list_sort(list_filter([" + ", ".join(f"CASE WHEN list_contains(perils, '{p}') THEN '{n}' END" for p, (n, _) in risk.SEASONS.items()) + "], lambda x: x IS NOT NULL))"
ORACLE = {
    "a1_loss_stats": f"SELECT application_id, n_events, {SQL4(*[s for s in STATS if s not in ('annual', 'frequency', 'volatility')])}, round(total / years, 4) AS annual, round(n_events / years, 4) AS frequency, round(CASE WHEN n_events > 1 AND mean > 0 THEN std / mean ELSE 0 END, 4) AS volatility FROM (SELECT b.* REPLACE (CASE WHEN std > 0 THEN kurtosis END AS kurtosis), skew FROM loss_base b LEFT JOIN loss_cubes USING (application_id))",
    "a2_loss_trend": f"SELECT application_id, n_events, {SQL4('slope', 'r', 'p')}, CASE WHEN p < 0.05 THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'stable' END AS trend FROM loss_p",
    "k1_loss_confidence": f"SELECT application_id, {SQL4('loss_confidence')} FROM loss_full",
    "j2_loss_join": f"SELECT application_id, n_events, trend, {SQL4('total', 'annual', 'frequency', 'volatility')} FROM loss_full",
    "k2_zone": "SELECT application_id, zone FROM cat_base",
    "k3_perils": f"SELECT application_id, {_listsql('perils')} FROM cat_base",
    "k4_cat_score": f"SELECT application_id, {SQL4('base', 'modifier', 'cat_score')} FROM cat_full",
    "k5_pml": "SELECT application_id, pml FROM cat_full",
    "k6_cat_details": f"SELECT application_id, {SQL4('concentration', 'cat_confidence')}, {_listsql('mitigations')}, coalesce(array_to_string(asset_risks, '|'), '') AS asset_risks, array_to_string({_seasons}, '|') AS seasons FROM cat_full",
    "k7_ratios": f"SELECT application_id, {SQL4('debt_to_asset', 'equity_ratio', 'asset_turnover', 'revenue_to_debt', 'liquidity', 'solvency', 'profitability', 'stability')} FROM fin_full",
    "k8_financial_score": "SELECT application_id, financial_score FROM fin_full",
    "k9_rating": f"SELECT application_id, rating, credit_risk, {_listsql('financial_concerns')}, {SQL4('financial_confidence')} FROM fin_full",
    "k10_component_scores": f"SELECT application_id, {SQL4('loss_score', 'asset_score', 'geographic_score')} FROM component_full JOIN loss_full USING (application_id)",
    "k11_overall_risk": "SELECT application_id, overall_score, risk_level, risk_confidence FROM risk_full",
    "k12_advice": f"SELECT application_id, {_listsql('recommendations')}, {_listsql('concerns')}, {_listsql('suggestions')} FROM advice_full",
    "k13_risk_report": f"SELECT application_id, overall_score, risk_full.risk_level, risk_confidence, {SQL4(*REPORT)}, len(recommendations) AS n_recommendations, len(concerns) AS n_concerns, len(suggestions) AS n_suggestions FROM risk_full JOIN advice_full USING (application_id)",
    "j1_children": "SELECT application_id, status, asset_value::DOUBLE AS asset_value, assets::DOUBLE AS assets, decision FROM applications LEFT JOIN risk_parameters USING (application_id) LEFT JOIN financial_data USING (application_id) LEFT JOIN recommendations USING (application_id)",
}
ORACLE_SQL = {k: oracle(v) for k, v in ORACLE.items()}
