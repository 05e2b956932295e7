"""Catastrophe exposure, financial strength and overall risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import first_key, has, listed, lookup, low
from tidemark.operators.loss import loss_analysis

# Fixed values.
ZONES = {"california": "very_high", "japan": "extreme", "turkey": "high", "chile": "high", "new zealand": "high", "florida": "very_high", "gulf coast": "high", "caribbean": "very_high", "bahamas": "very_high", "bangladesh": "extreme", "netherlands": "high", "louisiana": "high"}
PERILS = {"california": ["earthquake", "wildfire"], "florida": ["hurricane", "flood"], "japan": ["earthquake", "flood"], "caribbean": ["hurricane"], "bangladesh": ["flood", "tornado"]}
ZONE_SCORE = {"moderate": 4.0, "high": 7.0, "very_high": 9.0, "extreme": 10.0}
ZONE_PML = {"moderate": 0.20, "high": 0.40, "very_high": 0.60, "extreme": 0.80}
ZONE_CONCENTRATION = {"moderate": 0.0, "high": 0.2, "very_high": 0.3, "extreme": 0.4}
ZONE_RISK = {"moderate": 40.0, "high": 70.0, "very_high": 85.0, "extreme": 95.0}
ASSET_MODIFIER = {"residential": 0.8, "commercial": 1.0, "industrial": 1.3, "infrastructure": 1.5, "energy": 1.4}
SECTOR_FACTOR = {"oil_gas": 1.8, "chemical": 1.7, "mining": 1.6, "construction": 1.4, "manufacturing": 1.2, "technology": 0.8, "services": 0.9, "retail": 1.0, "healthcare": 0.7, "education": 0.6}
STABILITY = {"AAA": 1.0, "AA": 0.9, "A": 0.8, "BBB": 0.7, "BB": 0.6, "B": 0.4, "CCC": 0.2, "D": 0.0}
WEIGHTS = {"loss": 0.25, "cat": 0.30, "financial": 0.20, "asset": 0.15, "geographic": 0.10}
SEASONS = {"hurricane": ("hurricane_season", 1.5), "wildfire": ("fire_season", 1.3), "flood": ("flood_season", 1.2)}
ASSET_RISKS = {"technology": ["Cyber attacks", "Equipment failure", "Data loss"], "industrial": ["Fire", "Explosion", "Equipment breakdown"], "residential": ["Fire", "Theft", "Natural disasters"]}
PERIL_ADVICE = {"earthquake": "Seismic retrofitting and building reinforcement", "flood": "Flood barriers and drainage improvements", "wildfire": "Defensible space and fire-resistant materials", "cyber": "Enhanced cybersecurity measures and backup systems"}


def zone(location: Column) -> Column:
    return first_key(low(location), ZONES, "moderate")


def perils(location: Column, asset_type: Column) -> Column:
    """Sorted; flood where no place is known, whatever was asked before."""
    place, asset = low(location), low(asset_type)
    own = None
    for key, names in PERILS.items():
        value = F.array(*map(F.lit, names))
        own = F.when(place.contains(key), value) if own is None else own.when(place.contains(key), value)
    more = listed((has(asset, "technology", "data"), "cyber"), (has(asset, "chemical", "oil"), "terrorism"))
    return F.array_sort(F.array_distinct(F.concat(own.otherwise(F.array(F.lit("flood"))), more)))


def asset_modifier(asset_type: Column) -> Column:
    return first_key(low(asset_type), ASSET_MODIFIER, 1.0)


def mitigations(construction: Column, asset_type: Column) -> Column:
    built, asset = low(construction), low(asset_type)
    return listed((has(built, "concrete", "steel"), "Fire-resistant construction"), (has(built, "sprinkler"), "Sprinkler system"), (has(asset, "technology"), "Cyber security measures"), (has(asset, "industrial"), "Industrial safety protocols"))


def catastrophe_exposure(params: DataFrame) -> DataFrame:
    """Zone, perils, score, probable maximum loss, concentration, mitigations and confidence of each application."""
    c = F.col
    out = params.withColumns({"zone": zone(c("location")), "perils": perils(c("location"), c("asset_type")), "modifier": asset_modifier(c("asset_type")), "mitigations": mitigations(c("construction_type"), c("asset_type"))})
    out = out.withColumn("base", lookup(c("zone"), ZONE_SCORE, 4.0) * (1 + (F.size("perils") - 1) * 0.2))
    share = F.least(F.lit(1.0), lookup(c("zone"), ZONE_PML, 0.2) * c("modifier"))
    pml = F.when(F.coalesce(c("asset_value"), F.lit(0)) != 0, c("asset_value").cast("double") * share).otherwise(0.0)
    sure = 0.5 + F.when(F.length(F.coalesce("location", F.lit(""))) > 10, 0.2).otherwise(0.0) + F.when(F.coalesce("asset_type", F.lit("")) != "", 0.2).otherwise(0.0) + F.when(F.coalesce("construction_type", F.lit("")) != "", 0.1).otherwise(0.0)
    risks = F.flatten(listed(*((has(low("asset_type"), k), F.array(*map(F.lit, v))) for k, v in ASSET_RISKS.items())))
    seasons = F.map_from_entries(F.array_compact(F.array(*(F.when(F.array_contains("perils", p), F.struct(F.lit(n), F.lit(v))) for p, (n, v) in SEASONS.items()))))
    return out.select(
        "application_id", "zone", "perils", "base", "modifier", "mitigations", F.greatest(F.lit(0.0), c("base") * c("modifier") - F.size("mitigations") * 0.05).alias("cat_score"), F.round(pml, 2).alias("pml"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + lookup(c("zone"), ZONE_CONCENTRATION, 0.0))).alias("concentration"), F.least(F.lit(1.0), sure).alias("cat_confidence"), risks.alias("asset_risks"), seasons.alias("seasons"),
    )


def financial_ratios(fin: DataFrame) -> DataFrame:
    """Ratios are null where a figure is missing or zero."""
    num = lambda x: F.nullif(F.col(x).cast("double"), F.lit(0.0))
    assets, debts, revenue = num("assets"), num("liabilities"), num("revenue")
    return fin.withColumns({"debt_to_asset": debts / assets, "equity_ratio": (assets - debts) / assets, "asset_turnover": revenue / assets, "revenue_to_debt": revenue / debts})


def bands(score: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first step that the score reaches."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for at, name in steps[1:]:
        out = out.when(score >= at, name)
    return out.otherwise(last)


RATING_STEPS = [(90, "AAA"), (80, "AA"), (70, "A"), (60, "BBB"), (50, "BB"), (40, "B"), (30, "CCC")]
CREDIT_STEPS = [(80, "LOW"), (60, "MEDIUM"), (40, "HIGH")]


def financial_strength(fin: DataFrame, sentiment: str | None = None) -> DataFrame:
    """sentiment: a column of model scores; 0.5 without one."""
    c = F.col
    out = financial_ratios(fin)
    rated = F.coalesce("credit_rating", F.lit("")) != ""
    out = out.withColumns({
        "liquidity": F.least(F.lit(1.0), F.coalesce(c("equity_ratio") * 2, F.lit(0.5))), "solvency": F.greatest(F.lit(0.0), F.coalesce(1 - c("debt_to_asset"), F.lit(0.5))),
        "profitability": F.least(F.lit(1.0), F.coalesce(c("asset_turnover"), F.lit(0.5))), "stability": lookup(c("credit_rating"), STABILITY, 0.5), "sentiment": F.coalesce(c(sentiment), F.lit(0.5)) if sentiment else F.lit(0.5),
    })
    score = F.least(F.lit(100.0), (c("liquidity") * 0.2 + c("solvency") * 0.3 + c("profitability") * 0.2 + c("stability") * 0.2 + c("sentiment") * 0.1) * 100)
    out = out.withColumn("financial_score", F.round(score, 6))
    concerns = listed(
        (c("financial_score") < 50, "Overall financial strength is below acceptable levels"), (c("debt_to_asset") > 0.7, "High debt-to-asset ratio indicates leverage risk"),
        (~rated, "No credit rating available for assessment"), (c("credit_rating").isin("CCC", "D"), "Poor credit rating indicates high default risk"),
    )
    there = lambda x, w: F.when(F.coalesce(c(x), F.lit(0)) != 0, w).otherwise(0.0)
    sure = 0.3 + there("revenue", 0.15) + there("assets", 0.15) + there("liabilities", 0.15) + F.when(rated, 0.15).otherwise(0.0) + F.when(F.coalesce("financial_strength_rating", F.lit("")) != "", 0.1).otherwise(0.0)
    return out.withColumns({"rating": bands(c("financial_score"), RATING_STEPS, "D"), "credit_risk": bands(c("financial_score"), CREDIT_STEPS, "CRITICAL"), "financial_concerns": concerns, "financial_confidence": F.least(F.lit(1.0), F.round(sure, 4))}).drop("sentiment")


def component_scores(params: DataFrame) -> DataFrame:
    """Asset and geographic risk scores."""
    factor = lookup(F.regexp_replace(low("industry_sector"), " ", "_"), SECTOR_FACTOR, 1.0)
    built = low("construction_type")
    material = F.when(has(built, "concrete", "steel"), 0.8).when(has(built, "wood"), 1.2).otherwise(1.0)
    geo = F.when(F.coalesce("location", F.lit("")) == "", 50.0).otherwise(lookup(zone(F.col("location")), ZONE_RISK, 40.0))
    return params.select("application_id", F.least(F.lit(100.0), 50.0 * factor * material).alias("asset_score"), geo.alias("geographic_score"))


def risk_level(score: Column) -> Column:
    return F.when(score <= 25, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")


def overall_risk(applications: DataFrame, events: DataFrame, params: DataFrame, fin: DataFrame) -> DataFrame:
    """One row an application with all components; children are joined one to one, events summed up before."""
    c = F.col
    loss = loss_analysis(applications, events)
    joined = loss.join(catastrophe_exposure(params), "application_id").join(financial_strength(fin), "application_id").join(component_scores(params), "application_id")
    joined = joined.withColumns({"cat_risk": F.least(F.lit(100.0), c("cat_score") * 10), "financial_risk": 100.0 - c("financial_score")})
    score = c("loss_score") * 0.25 + c("cat_risk") * 0.30 + c("financial_risk") * 0.20 + c("asset_score") * 0.15 + c("geographic_score") * 0.10
    sure = c("loss_confidence") * 0.25 + c("cat_confidence") * 0.30 + c("financial_confidence") * 0.20 + 0.8 * 0.15 + 0.7 * 0.10
    return joined.withColumns({"overall_score": F.round(score, 2), "risk_confidence": F.round(sure, 3), "risk_level": risk_level(score)})


RECOMMEND = {
    "LOW": ["Risk profile is acceptable for standard terms", "Consider competitive pricing"],
    "MEDIUM": ["Risk profile is acceptable with standard terms", "Monitor for changes in risk factors"],
    "HIGH": ["Consider conditional approval with enhanced terms", "Require additional risk mitigation measures", "Implement enhanced monitoring"],
    "CRITICAL": ["High risk - consider rejection or substantial premium adjustment", "Require comprehensive risk mitigation plan", "Consider co-insurance or risk sharing"],
}


def risk_advice(risk: DataFrame, params: DataFrame) -> DataFrame:
    """Recommendations, concerns and mitigation suggestions."""
    c = F.col
    both = risk.join(params.select("application_id", "construction_type"), "application_id")
    general = F.flatten(listed(*((c("risk_level") == k, F.array(*map(F.lit, v))) for k, v in RECOMMEND.items())))
    recommend = F.concat(general, listed((c("trend") == "increasing", "Address increasing loss trend before approval"), (c("cat_score") > 8.0, "High catastrophe exposure - consider aggregate limits"), (c("financial_score") < 60, "Financial strength concerns - require guarantees")))
    concerns = F.concat(
        listed((c("overall_score") > 75, "Overall risk score exceeds acceptable thresholds"), (c("frequency") > 2.0, "High loss frequency indicates systemic issues"), (c("volatility") > 1.0, "High loss volatility creates unpredictable exposure"),
               (c("cat_score") > 8.0, "Extreme catastrophe exposure in high-risk zone"), (c("credit_risk").isin("HIGH", "CRITICAL"), "Financial strength raises solvency concerns")),
        c("financial_concerns"),
    )
    by_peril = F.array_compact(F.transform("perils", lambda p: lookup(p, PERIL_ADVICE, None)))
    suggest = F.concat(
        F.when(c("cat_score") > 6.0, F.array(F.lit("Implement catastrophe risk reduction measures"), F.lit("Consider catastrophe insurance or reinsurance"))).otherwise(F.array().cast("array<string>")), by_peril,
        F.when(c("financial_score") < 70, F.array(F.lit("Improve financial position through debt reduction"), F.lit("Consider financial guarantees or collateral"))).otherwise(F.array().cast("array<string>")),
        listed((has(low("construction_type"), "wood"), "Upgrade to fire-resistant construction materials")),
    )
    return both.select("application_id", "risk_level", recommend.alias("recommendations"), concerns.alias("concerns"), suggest.alias("suggestions"))


def risk_report(applications: DataFrame, events: DataFrame, params: DataFrame, fin: DataFrame) -> DataFrame:
    """The report row: scores, level, confidence and how much advice there is."""
    risk = overall_risk(applications, events, params, fin)
    advice = risk_advice(risk, params).select("application_id", F.size("recommendations").alias("n_recommendations"), F.size("concerns").alias("n_concerns"), F.size("suggestions").alias("n_suggestions"))
    return risk.join(advice, "application_id").select("application_id", "overall_score", "risk_level", "risk_confidence", "loss_score", "cat_risk", "financial_risk", "asset_score", "geographic_score", "n_recommendations", "n_concerns", "n_suggestions")
