"""Premium arithmetic, currencies, and validation of analysis rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import small_side


def normalised(df: DataFrame) -> DataFrame:
    """Headers in lower case, blanks and dashes as underscores."""
    return df.toDF(*(re.sub(r"[ -]", "_", c.strip().lower()) for c in df.columns))


def rates_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """currency, kes_value: new values win, other currencies stay."""
    fresh = new.select("currency", F.col("kes_value").alias("new_value"))
    return old.join(fresh, "currency", "full_outer").select("currency", F.coalesce("new_value", "kes_value").alias("kes_value"))


def cross_rates(quotes: DataFrame, base: str = "KES") -> DataFrame:
    """quotes: currency, rate (units per a common currency). Values in the base currency; rates of zero or below are left out."""
    own = quotes.where((F.col("currency") == base) & (F.col("rate") > 0)).agg(F.max("rate").alias("per_base"))  # one row
    out = quotes.where(F.col("rate") > 0).crossJoin(F.broadcast(own))
    return out.select("currency", F.when(F.col("currency") == base, 1.0).otherwise(F.col("per_base") / F.col("rate")).alias("kes_value"))


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds original_currency (KES if missing) and rate (1.0 if unknown)."""
    known = rates.select(F.col("currency").alias("rate_currency"), F.col("kes_value"))
    own = rows.withColumn("original_currency", F.upper(F.coalesce("currency", F.lit("KES"))))
    return own.join(small_side(known), F.col("original_currency") == F.col("rate_currency"), "left").withColumn("rate", F.coalesce("kes_value", F.lit(1.0))).drop("rate_currency", "kes_value")


def derived(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """All calculated fields of a premium row; what cannot be calculated is null."""
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0.0))
    out = with_rates(rows, rates)
    tsi, premium, share, earned = zero("tsi"), zero("premium"), zero("accepted_share"), F.coalesce(F.nullif("earned_premium", F.lit(0.0)), zero("premium"))
    incurred = zero("paid_losses") + zero("outstanding_reserves") - zero("recoveries")
    brokerage = zero("brokerage")
    brokerage = F.when((brokerage > 0) & (brokerage < 1), premium * brokerage).when((brokerage > 1) & (brokerage < 100), premium * (brokerage / 100)).otherwise(brokerage)
    both, shared = (tsi > 0) & (premium > 0), share > 0
    ratio = F.when(earned > 0, incurred / F.nullif(earned, F.lit(0.0)) * 100)
    liability = F.when(tsi >= 1_000_000_000, "High").when(tsi >= 100_000_000, "Medium").otherwise("Low")
    known = F.coalesce(F.round(ratio, 2), F.lit(0.0))
    score = 5.0 + F.when(known > 100, 3.0).when(known > 75, 2.0).when(known > 50, 1.0).when(known < 25, -1.0).otherwise(0.0) + F.when(liability == "High", 1.0).when(liability == "Low", -0.5).otherwise(0.0)
    return out.withColumns({
        "rate_percent": F.when(both, premium / F.nullif(tsi, F.lit(0.0)) * 100), "rate_permille": F.when(both, premium / F.nullif(tsi, F.lit(0.0)) * 1000), "calculated_premium": F.when(~both & (tsi > 0) & (zero("premium_rate") > 0), tsi * (c("premium_rate") / 100)),
        "incurred": F.when(earned > 0, incurred), "loss_ratio": ratio, "accepted_premium": F.when(shared & (premium > 0), premium * (share / 100)), "accepted_liability": F.when(shared & (tsi > 0), tsi * (share / 100)), "accepted_loss_ratio": F.when(shared, ratio),
        "tsi_kes": tsi * c("rate"), "premium_kes": premium * c("rate"), "net_premium": F.greatest(F.lit(0.0), premium - brokerage - zero("taxes") - zero("levies")), "liability": liability, "risk_score": F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)),
    })


def narrative(rows: DataFrame) -> DataFrame:
    """A decision in words from the risk score and the loss ratio (ours for rows without a model)."""
    ratio = F.coalesce("loss_ratio", F.lit(0.0))
    verdict = F.when((F.col("risk_score") >= 8) | (ratio > 100), "DECLINE").when((F.col("risk_score") >= 6) | (ratio > 75), "REFER").otherwise("ACCEPT")
    return rows.withColumn("narrative", F.concat(verdict, F.lit(": risk score "), F.format_number("risk_score", 1), F.lit(", liability "), F.col("liability")))


def calculations(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """One (metric, formula, result) row for each value that could be calculated."""
    formulas = {"rate_percent": "premium / tsi * 100", "rate_permille": "premium / tsi * 1000", "loss_ratio": "incurred / earned premium * 100", "accepted_premium": "premium * share / 100", "accepted_liability": "tsi * share / 100", "net_premium": "premium - brokerage - taxes - levies"}
    items = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(f).alias("formula"), F.col(m).alias("result")) for m, f in formulas.items()))
    return rows.select(key, F.inline(items)).where("result IS NOT NULL")


# Fields, their kinds and lengths.
FIELDS = ["reference_number", "date_received", "insured_name", "cedant_reinsured", "broker_name", "perils_covered", "geographical_limit", "situation_of_risk", "occupation_of_insured", "main_activities", "total_sums_insured", "currency", "excess_retention", "premium_rates",
          "period_of_insurance", "pml_percentage", "cat_exposure", "reinsurance_deductions", "claims_experience_3_years", "share_offered_percentage", "surveyors_report", "climate_change_risk", "esg_risk_assessment"]
CRITICAL = ["reference_number", "insured_name", "cedant_reinsured", "broker_name", "perils_covered", "total_sums_insured", "currency", "period_of_insurance", "pml_percentage", "share_offered_percentage"]
AMOUNTS = ["total_sums_insured", "excess_retention", "reinsurance_deductions"]
PERCENTS = ["premium_rates", "pml_percentage", "share_offered_percentage"]
LENGTHS = {"reference_number": 50, "insured_name": 200, "cedant_reinsured": 200, "broker_name": 200, "perils_covered": 500, "geographical_limit": 300, "situation_of_risk": 500, "occupation_of_insured": 200, "main_activities": 500, "period_of_insurance": 100, "cat_exposure": 300, "surveyors_report": 500, "climate_change_risk": 500, "esg_risk_assessment": 500}
FIELD_CONFIDENCE = {"reference_number": 0.9, "insured_name": 0.9, "cedant_reinsured": 0.9, "broker_name": 0.9, "total_sums_insured": 0.8, "currency": 0.8, "perils_covered": 0.8, "situation_of_risk": 0.8, "period_of_insurance": 0.8, "date_received": 0.7, "geographical_limit": 0.7, "occupation_of_insured": 0.7, "main_activities": 0.7, "excess_retention": 0.7,
                    "premium_rates": 0.6, "pml_percentage": 0.5, "cat_exposure": 0.5, "reinsurance_deductions": 0.5, "claims_experience_3_years": 0.5, "share_offered_percentage": 0.6, "surveyors_report": 0.4, "climate_change_risk": 0.3, "esg_risk_assessment": 0.3}


def there(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit("")) != ""


def validated(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Adds errors, warnings, completeness (0 to 1 over the critical fields), missing, and valid."""
    c = F.col
    errors = [(c(f) < 0, F.lit(f"{f} cannot be negative")) for f in AMOUNTS] + [((c(f) < 0) | (c(f) > 100), F.lit(f"{f} must be between 0 and 100")) for f in PERCENTS]
    errors += [((F.length("currency") != 3) & there("currency"), F.lit("Currency code must be 3 characters"))] + [(F.length(f) > n, F.lit(f"{f} exceeds {n} characters")) for f, n in LENGTHS.items()]
    missing = F.array_compact(F.array(*(F.when(~there(f), F.lit(f)) for f in CRITICAL)))
    warnings = [(F.col("date_received") > as_of, F.lit("Date received is in the future"))] if as_of is not None else []
    warnings += [((F.length("reference_number") < 3) & there("reference_number"), F.lit("Reference number seems too short"))]
    share = sum((F.when(there(f), 1).otherwise(0) for f in FIELDS), F.lit(0)) / len(FIELDS)
    warnings += [(share < 0.5, F.lit("Low data completeness")), ((share >= 0.5) & (share < 0.8), F.lit("Moderate data completeness"))]
    gather = lambda pairs: F.array_compact(F.array(*(F.when(a, b) for a, b in pairs)))
    out = rows.withColumns({"missing": missing, "errors": gather(errors), "share_complete": F.round(share, 4)})
    out = out.withColumn("warnings", F.concat(gather(warnings), F.transform("missing", lambda f: F.concat(F.lit("Missing critical field: "), f))))
    return out.withColumns({"completeness": (len(CRITICAL) - F.size("missing")) / len(CRITICAL), "valid": F.size("errors") == 0})


def field_confidence(rows: DataFrame) -> DataFrame:
    """Adds field_confidence: base confidence times the field's weight, 0 for missing fields."""
    items = F.map_from_arrays(F.array(*map(F.lit, FIELD_CONFIDENCE)), F.array(*(F.when(there(f), F.least(F.lit(1.0), F.round(F.col("confidence_score") * w, 6))).otherwise(0.0) for f, w in FIELD_CONFIDENCE.items())))
    return rows.withColumn("field_confidence", items)


def completeness_by_field(rows: DataFrame) -> DataFrame:
    """Completed, total and percentage of each of the fields."""
    flags = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), there(f).alias("done")) for f in FIELDS))).alias("x"))
    return flags.groupBy("x.field").agg(F.count_if("x.done").alias("completed"), F.count(F.lit(1)).alias("total")).withColumn("percent", F.round(F.col("completed") * 100.0 / F.col("total"), 4))


def confidence_by_field(rows: DataFrame) -> DataFrame:
    long = field_confidence(rows).select(F.explode("field_confidence").alias("field", "confidence"))
    with_data = F.col("confidence") > 0
    return long.groupBy("field").agg(F.round(F.avg("confidence"), 4).alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.count_if(with_data).alias("with_data"), F.count(F.lit(1)).alias("total"))


def validation_summary(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """rows: as validated. Counts and texts of errors and warnings, and more of the rows' columns."""
    return rows.select(key, *more, F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), F.array_join("errors", "; ").alias("error_text"), F.array_join("warnings", "; ").alias("warning_text"))


def notes(rows: DataFrame, key: str, column: str = "warnings") -> DataFrame:
    """One row a note, with its kind; a row without notes keeps one empty row."""
    text = F.lower("note")
    kind = F.when(F.col("note").isNull(), "None").when(text.contains("error") | text.contains("must be"), "Error").when(text.contains("missing"), "Missing").when(text.contains("completeness"), "Completeness").otherwise("Info")
    return rows.select(key, F.explode_outer(column).alias("note")).withColumn("kind", kind)


def consistency(rows: DataFrame) -> DataFrame:
    """Cross-field checks: premium against rate times sum insured (1 %), retention and share together, order of the period."""
    c = F.col
    expected = c("tsi") * c("premium_rate") / 100
    return rows.withColumns({"rate_fits": F.abs(c("premium") - expected) <= 0.01 * F.abs(expected), "shares_fit": F.coalesce("retention", F.lit(0.0)) + F.coalesce("accepted_share", F.lit(0.0)) <= 100, "period_fits": c("period_from") <= c("period_to")})


def report_row(rows: DataFrame) -> DataFrame:
    """Formatted report fields with the customary defaults for missing text."""
    money = lambda x: F.coalesce(F.format_number(F.col(x), 2), F.lit("TBA"))
    return rows.select("row_id", F.coalesce("insured_name", F.lit("TBA")).alias("insured"), F.concat(F.col("original_currency"), F.lit(" "), money("tsi")).alias("sum_insured"), money("premium").alias("premium"), F.when(F.col("loss_ratio").isNull(), "NIL").otherwise(F.concat(F.format_number("loss_ratio", 1), F.lit("%"))).alias("loss_ratio_text"), F.coalesce(F.concat(F.format_number("accepted_share", 2), F.lit("%")), F.lit("Open")).alias("share_text"))


#: The 23 fields of a report in their order, and how each is written.
REPORT_FIELDS = {
    "reference_number": "text", "date_received": "date", "insured_name": "text", "cedant_reinsured": "text", "broker_name": "text", "perils_covered": "text", "geographical_limit": "text", "situation_of_risk": "text", "occupation_of_insured": "text",
    "main_activities": "text", "total_sums_insured": "money", "currency": "text", "excess_retention": "money", "premium_rates": "percent", "period_of_insurance": "text", "pml_percentage": "percent", "cat_exposure": "text",
    "reinsurance_deductions": "money", "claims_experience_3_years": "text", "share_offered_percentage": "percent", "surveyors_report": "text", "climate_change_risk": "text", "esg_risk_assessment": "text",
}


def report_fields(rows: DataFrame) -> DataFrame:
    """row_id and the 23 report fields as texts; what is missing or empty is TBA."""
    prefix = F.coalesce(F.concat(F.col("currency"), F.lit(" ")), F.lit(""))
    written = {
        "date": lambda f: F.date_format(f, "yyyy-MM-dd"), "money": lambda f: F.concat(prefix, F.format_number(f, 2)), "percent": lambda f: F.concat(F.col(f).cast("string"), F.lit("%")), "text": lambda f: F.nullif(F.col(f), F.lit("")),
    }
    return rows.select("row_id", *(F.coalesce(written[kind](f), F.lit("TBA")).alias(f) for f, kind in REPORT_FIELDS.items()))


def accepted(rows: DataFrame, default_share: float = 1.0) -> DataFrame:
    """Liability, premium and PML text in KES of the accepted share, 1 % where none is given."""
    share = F.coalesce(F.nullif("accepted_share", F.lit(0.0)), F.lit(default_share)) / 100
    out = rows.withColumns({"share_liability_kes": F.col("tsi_kes") * share, "share_premium_kes": F.col("premium_kes") * share})
    return out.withColumn("share_text", F.concat(F.lit("KES "), F.format_number("share_liability_kes", 2), F.lit(" at "), F.format_number(share * 100, 2), F.lit("%")))


def executive_summary(risk: DataFrame) -> DataFrame:
    """Summary, remark and proposal of an application by its risk level."""
    remark = {"LOW": "Risk is well within appetite.", "MEDIUM": "Risk is within appetite on standard terms.", "HIGH": "Risk needs enhanced terms.", "CRITICAL": "Risk is outside appetite."}
    proposal = {"LOW": "Accept", "MEDIUM": "Accept", "HIGH": "Accept with conditions", "CRITICAL": "Decline"}
    by = lambda t: F.element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), F.col("risk_level"))
    text = F.concat(F.lit("Application "), F.col("application_id"), F.lit(" has "), F.lower("risk_level"), F.lit(" risk. "), by(remark))
    return risk.select("application_id", text.alias("summary"), by(remark).alias("remark"), by(proposal).alias("proposal"))
