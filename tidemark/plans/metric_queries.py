"""Queries of dashboards, statistics and lists, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.plans.oracle import STEPS, oracle
from tidemark.plans.risk_queries import SQL4, R4, risk_of

STEPS["full_view"] = "SELECT a.*, asset_value, asset_type, location, industry_sector, occupancy, overall_score, risk_level, decision, premium_adjustment, decided_at FROM applications a LEFT JOIN risk_parameters USING (application_id) LEFT JOIN (SELECT application_id, overall_score, risk_level FROM risk_full) USING (application_id) LEFT JOIN recommendations USING (application_id)"
_rates = "count(*) AS n, round(coalesce(count(*) FILTER (decision = 'APPROVE') / nullif(count(decision), 0), 0), 4) AS approval_rate, round(avg(overall_score), 4) AS avg_score, round(sum(asset_value::DOUBLE), 2) AS insured_value, round(avg(premium_adjustment), 4) AS avg_adjustment"
STEPS["market_rates"] = "SELECT location, count(*) AS n, coalesce(count(*) FILTER (decision = 'APPROVE') / nullif(count(decision), 0), 0) AS rate FROM full_view WHERE location IS NOT NULL GROUP BY 1"
STEPS["market_years"] = "SELECT location, year(created_at) AS y, count(*) AS k FROM full_view WHERE location IS NOT NULL GROUP BY ALL"
STEPS["market_growth"] = "SELECT location, arg_max(g, y) FILTER (g IS NOT NULL) AS growth FROM (SELECT *, (k - lag(k) OVER (PARTITION BY location ORDER BY y)) / lag(k) OVER (PARTITION BY location ORDER BY y) AS g FROM market_years) GROUP BY 1"
STEPS["best_markets"] = "SELECT string_agg(location, '|' ORDER BY place) AS top FROM (SELECT *, row_number() OVER (ORDER BY rate DESC, n DESC, location) AS place FROM market_rates) WHERE place <= 5"
STEPS["new_markets"] = "SELECT string_agg(location, '|' ORDER BY place) AS emerging FROM (SELECT *, row_number() OVER (ORDER BY growth DESC, n DESC, location) AS place FROM market_rates JOIN market_growth USING (location) WHERE growth > 0) WHERE place <= 5"
STEPS["task_metrics"] = "SELECT process_type, count(*) AS n, avg(processing_time::DOUBLE) AS avg_s, min(processing_time)::DOUBLE AS min_s, max(processing_time)::DOUBLE AS max_s, count(*) FILTER (status = 'failed') AS errors, count(*) FILTER (status = 'completed') / count(*) AS success_rate, count(*) / greatest((floor(epoch(max(created_at))) - floor(epoch(min(created_at)))) / 3600, 1) AS per_hour, max(created_at) AS last_run FROM processing_logs GROUP BY 1"


def view(t):
    return m.with_decisions(t.applications, t.recommendations).join(t.risk_parameters, "application_id", "left").join(risk_of(t).select("application_id", "overall_score", "risk_level"), "application_id", "left")


def tasks(t):
    return m.processing(t.processing_logs, "process_type")


def points(t):
    return t.processing_logs.select(F.col("process_type").alias("metric"), F.col("processing_time").cast("double").alias("value"), "created_at")


def _rated(df, *keys):
    return m.rates(df, *keys).select(*keys, "n", *R4("approval_rate", "avg_score"), F.round("insured_value", 2).alias("insured_value"), *R4("avg_adjustment"))


def as_of(t):
    return t.applications.agg(F.max("created_at").alias("as_of"))


AS_OF = "1999-06-15"
GRAINS = ("hour", "day", "week", "month")
TASK = ("avg_s", "min_s", "max_s", "success_rate", "per_hour")

QUERIES = {
    "a13_dashboard": lambda t: m.dashboard(view(t)).select("n", "pending", "high_risk", *R4("approval_rate", "avg_hours"), F.round("insured_value", 2).alias("insured_value")),
    "a14_processing": lambda t: tasks(t).select("process_type", "n", "errors", *R4("avg_s", "success_rate", "per_hour")),
    "a15_model_performance": lambda t: m.confusion(t.predictions).select("n", *R4("accuracy", "precision", "recall", "f1")),
    "a16_risk_distribution": lambda t: m.distribution(view(t), "risk_level").select("risk_level", "n", *R4("percent"), F.round("avg_asset", 2).alias("avg_asset")),
    "a17_geographic": lambda t: _rated(view(t), "location"),
    "a18_industry": lambda t: m.histogram(view(t), "industry_sector", "risk_level"),
    "a18_industry_rates": lambda t: _rated(view(t), "industry_sector"),
    "a19_application_stats": lambda t: m.status_counts(t.applications, F.lit(AS_OF).cast("timestamp")).select("n", "pending", "processing", "analyzed", "completed", "rejected", *R4("avg_hours"), "this_month", "last_month"),
    "a27_task_metrics": lambda t: tasks(t).select("process_type", "n", "errors", *R4(*TASK), "last_run"),
    "a28_system_stats": lambda t: m.system_rollup(tasks(t)).select("n", "errors", *R4("avg_of_avg", "max_s", "rate")),
    "a29_batch_progress": lambda t: m.batch_progress(t.processing_logs, "application_id").select("application_id", "total", "ok", "failed", "pending", *R4("success_rate")),
    "a30_metric_stats": lambda t: m.metric_stats(points(t), "metric").select("metric", "n", *R4("least", "most", "mean", "p50", "p95", "p99")),
    "a30_metric_stats_empty": lambda t: m.metric_stats(points(t).where("value < -1e9")),
    "a33_market_kpis": lambda t: m.market_groups(view(t), "industry_sector").where("industry_sector IS NOT NULL").select("industry_sector", "n", *R4("approval_rate", "avg_adjustment", "market_share", "growth")),
    "a34_market_trend": lambda t: m.market_trend(view(t), "location").select("period", "n", *R4("approval_rate", "avg_score", "concentration"), F.round("insured_value", 2).alias("insured_value")),
    "a35_market_stats": lambda t: _rated(view(t), "location").orderBy(F.desc("n"), F.col("location").asc_nulls_last()).limit(5),
    "a35_market_statistics": lambda t: m.market_statistics(view(t), "location").select("markets", "n", *R4("approval_rate"), F.round("insured_value", 2).alias("insured_value"), "low", "medium", "high", "critical", "top", "emerging"),
    "a36_quick_summary": lambda t: m.quick_summary(t.applications, t.app_documents, t.recommendations),
    "w5_period_change": lambda t: m.trend(t.applications.withColumn("value", F.col("no").cast("double")), "created_at", "month").select("period", "n", "change", *R4("growth")),
    "w6_latest_kept": lambda t: m.latest_kept(t.processing_logs).select("event_id"),
    "f1_application_list": lambda t: m.page(m.listed_applications(t.applications, t.app_documents, risk_of(t), "completed", "survey"), [F.desc("overall_score"), F.asc("application_id")], 2, 20).select("application_id", "overall_score", "total", "has_previous", "has_next"),
    "f2_search": lambda t: m.searched(view(t), since="1995-01-01", until="1999-01-01", least=5e7, most=2e8, sector="manufacturing", place="usa", text="office").select("application_id", F.col("asset_value").cast("double").alias("asset_value")),
    "f3_document_list": lambda t: t.app_documents.where("application_id = '4'").orderBy("uploaded_at", "document_id").offset(1).limit(3).select("document_id", "filename"),
    "f4_logs": lambda t: m.log_query(t.processing_logs, "WARNING", "2024-01-02", "2024-01-20", 50).select("event_id", "level", "created_at"),
    "f5_audit": lambda t: t.processing_logs.where("application_id = '7' AND process_type IN ('click', 'view')").orderBy(F.desc("created_at"), "event_id").limit(20).select("event_id", "process_type", "status"),
    "f6_alerts": lambda t: m.alerts(tasks(t)),
    "f8_processed_documents": lambda t: t.app_documents.where("processed").join(t.applications.where("status = 'completed'"), "application_id", "left_semi").select("document_id"),
    "f11_active_workflows": lambda t: t.applications.where(F.col("status").isin("pending", "processing")).select("application_id", m.mapped("status", m.WORKFLOW, "UNKNOWN").alias("workflow")),
    "f12_failed_tasks": lambda t: t.processing_logs.where("status = 'failed' AND created_at >= timestamp '2024-01-25'").select("event_id", "process_type"),
    "f13_recovery": lambda t: t.processing_logs.where("status = 'failed'").select("event_id", m.mapped("process_type", m.RECOVERY, "manual_review").alias("action")),
    "f16_document_dashboard": lambda t: m.document_dashboard(t.app_documents),
    "u2_history": lambda t: m.history(t.applications, t.app_documents, t.recommendations),
} | {f"w4_six_metrics_{g}": (lambda t, g=g: m.metric_trends(view(t), g).select("metric", "period", *R4("value"), "n")) for g in GRAINS} | {f"w4_trend_{g}": (lambda t, g=g: m.trend(points(t), "created_at", g).select("period", "n", *R4("mean"))) for g in GRAINS}

_case = lambda c, t, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE '{d}' END"
_page = "SELECT application_id, coalesce(overall_score, 0) AS overall_score FROM applications LEFT JOIN risk_full USING (application_id) WHERE status = 'completed' AND (contains(application_id, 'survey') OR application_id IN (SELECT application_id FROM app_documents WHERE contains(lower(filename), 'survey')))"
ORACLE = {
    "a13_dashboard": "SELECT count(*) AS n, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high_risk, round(count(*) FILTER (decision = 'APPROVE') / count(decision), 4) AS approval_rate, round(avg(epoch(decided_at - created_at) / 3600), 4) AS avg_hours, round(sum(asset_value::DOUBLE), 2) AS insured_value FROM full_view",
    "a14_processing": f"SELECT process_type, n, errors, {SQL4('avg_s', 'success_rate', 'per_hour')} FROM task_metrics",
    "a15_model_performance": "SELECT n, round((tp + tn) / n, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (SELECT count(*) AS n, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM predictions))",
    "a16_risk_distribution": "SELECT risk_level, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent, round(avg(asset_value::DOUBLE), 2) AS avg_asset FROM full_view GROUP BY 1",
    "a17_geographic": f"SELECT location, {_rates} FROM full_view GROUP BY 1",
    "a18_industry": "SELECT industry_sector, string_agg(risk_level || ':' || n, '|' ORDER BY risk_level || ':' || n) AS levels FROM (SELECT industry_sector, risk_level, count(*) AS n FROM full_view GROUP BY 1, 2) GROUP BY 1",
    "a18_industry_rates": f"SELECT industry_sector, {_rates} FROM full_view GROUP BY 1",
    "a19_application_stats": "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "processing", "analyzed", "completed", "rejected")) + f", round(avg(epoch(updated_at - created_at) / 3600), 4) AS avg_hours, count(*) FILTER (date_trunc('month', created_at) = '1999-06-01') AS this_month, count(*) FILTER (date_trunc('month', created_at) = '1999-05-01') AS last_month FROM applications",
    "a27_task_metrics": f"SELECT process_type, n, errors, {SQL4(*TASK)}, last_run FROM task_metrics",
    "a28_system_stats": "SELECT sum(n)::BIGINT AS n, sum(errors)::BIGINT AS errors, round(avg(avg_s), 4) AS avg_of_avg, round(max(max_s), 4) AS max_s, round((sum(n) - sum(errors)) / sum(n), 4) AS rate FROM task_metrics",
    "a29_batch_progress": "SELECT application_id, count(*) AS total, count(*) FILTER (status = 'completed') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, round(count(*) FILTER (status = 'completed') / count(*), 4) AS success_rate FROM processing_logs GROUP BY 1",
    "a30_metric_stats": "SELECT process_type AS metric, count(*) AS n, round(min(v), 4) AS least, round(max(v), 4) AS most, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99 FROM (SELECT process_type, processing_time::DOUBLE AS v FROM processing_logs) GROUP BY 1",
    "a30_metric_stats_empty": "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS least, 0.0::DOUBLE AS most, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS p50, 0.0::DOUBLE AS p95, 0.0::DOUBLE AS p99",
    "a33_market_kpis": "SELECT s AS industry_sector, n, approval_rate, avg_adjustment, round(n / (SELECT count(*) FROM full_view), 4) AS market_share, round(growth, 4) AS growth FROM (SELECT industry_sector AS s, " + _rates + " FROM full_view WHERE industry_sector IS NOT NULL GROUP BY 1) JOIN (SELECT s, arg_max(growth, y) AS growth FROM (SELECT s, y, (c - lag(c) OVER w) / lag(c) OVER w AS growth FROM (SELECT industry_sector AS s, year(created_at) AS y, count(*) AS c FROM full_view GROUP BY 1, 2) WINDOW w AS (PARTITION BY s ORDER BY y)) GROUP BY 1) USING (s)",
    "a34_market_trend": "SELECT period, sum(n)::BIGINT AS n, round(coalesce(sum(ok) / nullif(sum(d), 0), 0), 4) AS approval_rate, round(sum(sc) / sum(n), 4) AS avg_score, round(sum(n * n) / (sum(n) * sum(n)), 4) AS concentration, round(sum(v), 2) AS insured_value FROM (SELECT date_trunc('quarter', created_at)::TIMESTAMP AS period, location, count(*) AS n, count(*) FILTER (decision = 'APPROVE') AS ok, count(decision) AS d, sum(overall_score) AS sc, sum(asset_value::DOUBLE) AS v FROM full_view GROUP BY 1, 2) GROUP BY 1",
    "a35_market_statistics": """
    SELECT count(DISTINCT location) AS markets, count(*) AS n, round(coalesce(count(*) FILTER (decision = 'APPROVE') / nullif(count(decision), 0), 0), 4) AS approval_rate, round(sum(asset_value::DOUBLE), 2) AS insured_value, count(*) FILTER (upper(risk_level) = 'LOW') AS low, count(*) FILTER (upper(risk_level) = 'MEDIUM') AS medium,
           count(*) FILTER (upper(risk_level) = 'HIGH') AS high, count(*) FILTER (upper(risk_level) = 'CRITICAL') AS critical, coalesce(any_value(best_markets.top), '') AS top, coalesce(any_value(new_markets.emerging), '') AS emerging FROM full_view, best_markets, new_markets WHERE location IS NOT NULL""",
    "a35_market_stats": f"SELECT location, {_rates} FROM full_view GROUP BY 1 ORDER BY n DESC, location NULLS LAST LIMIT 5",
    "a36_quick_summary": "SELECT a.application_id, status, coalesce(d.n, 0) AS documents, coalesce(d.p, 0) AS processed, decision, CASE WHEN length(rationale) > 60 THEN rationale[1:60] || '...' ELSE rationale END AS rationale FROM applications a LEFT JOIN (SELECT application_id, count(*) AS n, count(*) FILTER (processed) AS p FROM app_documents GROUP BY 1) d USING (application_id) LEFT JOIN recommendations USING (application_id)",
    "w5_period_change": "SELECT period, n, n - lag(n) OVER w AS change, round((n - lag(n) OVER w) / lag(n) OVER w, 4) AS growth FROM (SELECT date_trunc('month', created_at)::TIMESTAMP AS period, count(*) AS n FROM applications GROUP BY 1) WINDOW w AS (ORDER BY period)",
    "w6_latest_kept": "SELECT event_id FROM processing_logs ORDER BY created_at DESC, event_id LIMIT 1000",
    "f1_application_list": f"SELECT application_id, overall_score, (SELECT count(*) FROM ({_page})) AS total, true AS has_previous, (SELECT count(*) FROM ({_page})) > 40 AS has_next FROM ({_page}) ORDER BY overall_score DESC, application_id LIMIT 20 OFFSET 20",
    "f2_search": "SELECT application_id, asset_value::DOUBLE AS asset_value FROM full_view WHERE created_at >= '1995-01-01' AND created_at < '1999-01-01' AND asset_value BETWEEN 5e7 AND 2e8 AND industry_sector = 'manufacturing' AND contains(lower(location), 'usa') AND contains(lower(concat_ws(' ', application_id, occupancy, asset_type)), 'office')",
    "f3_document_list": "SELECT document_id, filename FROM app_documents WHERE application_id = '4' ORDER BY uploaded_at, document_id LIMIT 3 OFFSET 1",
    "f4_logs": "SELECT event_id, level, created_at FROM processing_logs WHERE level IN ('WARNING', 'ERROR') AND created_at >= '2024-01-02' AND created_at < '2024-01-20' ORDER BY created_at DESC, event_id LIMIT 50",
    "f5_audit": "SELECT event_id, process_type, status FROM processing_logs WHERE application_id = '7' AND process_type IN ('click', 'view') ORDER BY created_at DESC, event_id LIMIT 20",
    "f6_alerts": "SELECT source, category, severity, value FROM (SELECT process_type AS source, 'reliability' AS category, CASE WHEN success_rate < 0.5 THEN 'critical' ELSE 'warning' END AS severity, round(success_rate, 4) AS value FROM task_metrics WHERE success_rate < 0.9 UNION ALL SELECT process_type, 'latency', 'info', round(avg_s, 4) FROM task_metrics WHERE avg_s > 50) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, category, source LIMIT 10",
    "f8_processed_documents": "SELECT document_id FROM app_documents WHERE processed AND application_id IN (SELECT application_id FROM applications WHERE status = 'completed')",
    "f11_active_workflows": f"SELECT application_id, {_case('status', m.WORKFLOW, 'UNKNOWN')} AS workflow FROM applications WHERE status IN ('pending', 'processing')",
    "f12_failed_tasks": "SELECT event_id, process_type FROM processing_logs WHERE status = 'failed' AND created_at >= '2024-01-25'",
    "f13_recovery": f"SELECT event_id, {_case('process_type', m.RECOVERY, 'manual_review')} AS action FROM processing_logs WHERE status = 'failed'",
    "f16_document_dashboard": "SELECT document_id, filename, (SELECT count(*) FROM app_documents) AS total, (SELECT count(*) FROM app_documents WHERE processed) AS processed, (SELECT count(*) FROM app_documents WHERE NOT processed) AS pending FROM app_documents ORDER BY uploaded_at DESC, document_id LIMIT 5",
    "u2_history": "SELECT application_id, created_at AS at, 'created' AS kind, '' AS detail FROM applications UNION ALL SELECT application_id, updated_at, 'status', status FROM applications UNION ALL SELECT application_id, uploaded_at, 'upload', filename FROM app_documents UNION ALL SELECT application_id, decided_at, 'decision', decision FROM recommendations",
} | {f"w4_six_metrics_{g}": f"""
    SELECT metric, period, round(value, 4) AS value, n FROM (SELECT period, unnest([{{'metric': 'applications', 'value': a::DOUBLE, 'n': a}}, {{'metric': 'approvals', 'value': ok::DOUBLE, 'n': ok}}, {{'metric': 'rejections', 'value': no::DOUBLE, 'n': no}},
        {{'metric': 'processing_time', 'value': h, 'n': nh}}, {{'metric': 'risk_scores', 'value': s, 'n': ns}}, {{'metric': 'premium_adjustments', 'value': p, 'n': np}}], recursive := true)
      FROM (SELECT date_trunc('{g}', created_at)::TIMESTAMP AS period, count(*) AS a, count(*) FILTER (decision = 'APPROVE') AS ok, count(*) FILTER (decision = 'REJECT') AS no, avg((floor(epoch(decided_at)) - floor(epoch(created_at))) / 3600) AS h, count(decided_at) AS nh,
            avg(overall_score) AS s, count(overall_score) AS ns, avg(premium_adjustment) AS p, count(premium_adjustment) AS np FROM full_view GROUP BY 1))""" for g in GRAINS} | {f"w4_trend_{g}": f"SELECT date_trunc('{g}', created_at)::TIMESTAMP AS period, count(*) AS n, round(avg(processing_time::DOUBLE), 4) AS mean FROM processing_logs GROUP BY 1" for g in GRAINS}
ORACLE_SQL = {k: oracle(v) for k, v in ORACLE.items()}
