"""Underwriting decision from eight factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import lookup

# Fixed values.
WEIGHTS = {"risk_score": 0.25, "financial_strength": 0.20, "loss_history": 0.15, "catastrophe_exposure": 0.15, "business_limits": 0.10, "regulatory_compliance": 0.08, "market_conditions": 0.04, "portfolio_concentration": 0.03}
ZONE_SHIFT = {"very_low": 10.0, "low": 5.0, "moderate": 0.0, "high": -15.0, "very_high": -25.0, "extreme": -40.0}
SENTIMENT = {"very_positive": 90.0, "positive": 80.0, "neutral": 70.0, "negative": 50.0, "very_negative": 30.0}
CONCENTRATION = {"low": 90.0, "moderate": 75.0, "high": 50.0, "very_high": 25.0}
LEVEL_TEXT = {"LOW": "Low overall risk profile supports favorable decision", "MEDIUM": "Moderate risk profile requires careful consideration", "HIGH": "High risk profile raises significant concerns", "CRITICAL": "Critical risk level strongly indicates rejection"}
CREDIT_TEXT = {"LOW": "Strong financial position supports approval", "HIGH": "Weak financial position raises concerns", "CRITICAL": "Critical financial weakness strongly opposes approval", "MEDIUM": "Moderate financial strength requires monitoring"}
#: The standing context, where a caller gives none.
CONTEXT = {"sentiment": "neutral", "utilization": 0.75, "concentration": "moderate", "diversification": 0.7, "requirements": ("standard_compliance", "kyc_verification", "sanctions_screening")}


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def factors(risk: DataFrame, limits: DataFrame, context: dict = CONTEXT) -> DataFrame:
    """Adds factors: an array of (factor, score, weight, confidence, rationale), in the order of WEIGHTS. limits: application_id, n (violations)."""
    c = F.col
    both = risk.join(limits.select("application_id", F.col("n").alias("n_violations")), "application_id", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    fin = F.least(F.lit(100.0), c("financial_score") * 1.2)
    fin = F.when(c("credit_risk") == "LOW", F.least(F.lit(100.0), fin * 1.1)).when(c("credit_risk") == "HIGH", fin * 0.8).when(c("credit_risk") == "CRITICAL", fin * 0.6).otherwise(fin)
    often = c("frequency")
    by_often = lambda *v: F.when(often < 0.5, v[0]).when(often < 1.0, v[1]).when(often < 2.0, v[2]).otherwise(v[3])
    moving = lambda *v: F.when(c("trend") == "decreasing", v[0]).when(c("trend") == "stable", v[1]).otherwise(v[2])
    loss = clip(70.0 + by_often(20.0, 10.0, -10.0, -25.0) + moving(15.0, 0.0, -20.0) + F.greatest(F.lit(-15.0), -c("volatility") * 10))
    loss_text = F.concat(F.lit("Loss history shows "), by_often("low loss frequency", "moderate loss frequency", "high loss frequency", "very high loss frequency"), F.lit(" and "), moving("improving loss trend", "stable loss pattern", "worsening loss trend"))
    cat = clip(F.greatest(F.lit(0.0), 100 - c("cat_score") * 10) + lookup(c("zone"), ZONE_SHIFT, 0.0))
    cat_text = F.concat(F.lit("Catastrophe exposure in "), c("zone"), F.lit(" risk zone"), F.when(c("cat_score") > 7, " raises significant concerns").when(c("cat_score") < 3, " is manageable").otherwise(" requires monitoring"))
    limit_text = F.when(c("n_violations") > 0, F.concat(F.lit("Business limit violations: "), c("n_violations").cast("string"))).otherwise("All business limits satisfied")
    asked = context["requirements"]
    law, law_text = (65.0, "High-risk jurisdiction requires additional scrutiny") if "high_risk_jurisdiction" in asked else (75.0, "Sanctions screening required") if "sanctions_check_required" in asked else (85.0, "Standard regulatory requirements apply")
    market = min(100.0, max(0.0, SENTIMENT.get(context["sentiment"], 70.0) + (-10 if context["utilization"] > 0.9 else 10 if context["utilization"] < 0.5 else 0)))
    book = min(100.0, max(0.0, CONCENTRATION.get(context["concentration"], 75.0) + (context["diversification"] - 0.5) * 20))
    rows = [
        (F.greatest(F.lit(0.0), 100 - c("overall_score")), c("risk_confidence"), lookup(c("risk_level"), LEVEL_TEXT, None)),
        (fin, F.lit(0.8), lookup(c("credit_risk"), CREDIT_TEXT, None)),
        (loss, F.lit(0.9), loss_text),
        (cat, F.lit(0.8), cat_text),
        (F.when(c("n_violations") > 0, 0.0).otherwise(100.0), F.lit(0.95), limit_text),
        (F.lit(law), F.lit(0.7), F.lit(law_text)),
        (F.lit(market), F.lit(0.6), F.lit(f"Market conditions are {context['sentiment']} with {context['utilization']:.0%} capacity utilization")),
        (F.lit(round(book, 6)), F.lit(0.5), F.lit(f"Portfolio shows {context['concentration']} concentration risk")),
    ]
    items = [F.struct(F.lit(n).alias("place"), F.lit(name).alias("factor"), F.round(s, 6).alias("score"), F.lit(w).alias("weight"), k.cast("double").alias("confidence"), t.alias("rationale")) for n, ((name, w), (s, k, t)) in enumerate(zip(WEIGHTS.items(), rows, strict=True))]
    return both.withColumn("factors", F.array(*items))


def total(x: str, value) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, f: a + value(f))


def decided(risk: DataFrame, limits: DataFrame, context: dict = CONTEXT) -> DataFrame:
    """Total, decision, confidence, terms, premium adjustment and texts; the factors stay in their row, so nothing is shuffled again."""
    c = F.col
    out = factors(risk, limits, context).withColumn("total", total("factors", lambda f: f["score"] * f["weight"]))
    decision = F.when(c("n_violations") > 0, "REJECT").when(c("total") >= 70, "APPROVE").when(c("total") <= 30, "REJECT").otherwise("CONDITIONAL")
    out = out.withColumn("decision", decision)
    sure = total("factors", lambda f: f["confidence"] * f["weight"])
    clear = F.when(c("decision") == "APPROVE", F.when(c("total") >= 80, 0.1).when(c("total") >= 70, 0.05).otherwise(-0.1)).when(c("decision") == "REJECT", F.when(c("total") <= 20, 0.1).when(c("total") <= 30, 0.05).otherwise(-0.1)).otherwise(-0.05)
    mean = total("factors", lambda f: f["score"]) / 8
    out = out.withColumn("mean_score", mean)
    out = out.withColumn("variance", total("factors", lambda f: (f["score"] - c("mean_score")) * (f["score"] - c("mean_score"))) / 8)
    agree = F.when(c("variance") < 100, 0.1).when(c("variance") > 400, -0.1).otherwise(0.0)
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(sure + clear + agree, 6))))
    score = lambda n: F.get("factors", F.lit(n))["score"]
    terms = F.array_compact(F.array(
        F.when(score(1) < 60, "premium_adjustment:Premium loading of 15% for financial risk"), F.when(score(2) < 60, "deductible:Increased deductible to 5% of sum insured"),
        F.when(score(3) < 60, "coverage_limit:Catastrophe exposure limit of 80% of total sum insured"), F.when(c("risk_level").isin("HIGH", "CRITICAL"), "exclusion:Exclude coverage for acts of terrorism")))
    raised = F.when(score(1) < 60, 0.15).otherwise(0.0) + F.when(c("overall_score") > 60, (c("overall_score") - 50) * 0.01).otherwise(0.0)
    raised = F.round(F.least(F.lit(0.5), F.greatest(F.lit(0.0), raised)), 6)
    return out.withColumns({"terms": terms, "premium_adjustment": F.when(raised > 0.01, raised)}).drop("mean_score")


def explained(decisions: DataFrame) -> DataFrame:
    """Rationale, and the lists of the explanation: factors sorted by what they weigh in (ties in their order)."""
    c = F.col
    # sorted as structs: a comparator would weigh both factors anew at each comparison
    by_weight = F.transform(F.array_sort(F.transform("factors", lambda x: F.struct((-(x["score"] * x["weight"])).alias("by"), x["place"].alias("place"), x.alias("factor")))), lambda x: x["factor"])
    out = decisions.withColumn("ranked", by_weight)
    text = lambda xs: F.transform(xs, lambda f: f["rationale"])
    good, bad = text(F.filter("factors", lambda f: f["score"] >= 70)), text(F.filter("factors", lambda f: f["score"] < 50))
    some = lambda xs, n, head, tail=". ": F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(F.slice(xs, 1, n), "; "), F.lit(tail))).otherwise("")
    rationale = F.when(c("decision") == "APPROVE", F.concat(F.lit("Recommendation: APPROVE. "), some(good, 2, "Strong supporting factors include: "), some(bad, 1, "Minor concerns: "), F.lit("Overall risk profile is acceptable for standard terms.")))
    rationale = rationale.when(c("decision") == "REJECT", F.concat(F.lit("Recommendation: REJECT. "), some(bad, 2, "Significant concerns include: "), F.lit("Risk profile exceeds acceptable thresholds.")))
    rationale = rationale.otherwise(F.concat(F.lit("Recommendation: CONDITIONAL APPROVAL. Mixed risk profile requires specific terms and conditions. "), some(good, 1, "Supporting factors: "), some(bad, 1, "Areas of concern: "), F.lit("Conditional terms can mitigate identified risks.")))
    return out.select(
        "application_id", "decision", rationale.alias("rationale"), text(F.slice("ranked", 1, 2)).alias("primary_reasons"), text(F.filter(F.slice("ranked", 3, 2), lambda f: f["score"] >= 60)).alias("supporting"),
        text(F.filter("ranked", lambda f: f["score"] >= 80)).alias("mitigating"), text(F.filter("ranked", lambda f: f["score"] < 50)).alias("addressed"), F.transform(F.filter("factors", lambda f: f["confidence"] >= 0.8), lambda f: F.concat(F.lit("High confidence in "), f["factor"])).alias("confidence_factors"),
        F.slice("ranked", 1, 3).alias("top"),
    )
