"""Business limits: one join of applications with a small table of limits, and its summaries."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import saved
from tidemark.functions.text import first_class, has, lookup, low

# Fixed values.
REGIONS = {
    "north_america": ["usa", "canada", "mexico", "united states", "north america"],
    "europe": ["uk", "germany", "france", "italy", "spain", "netherlands", "europe", "european union"],
    "asia_pacific": ["japan", "australia", "singapore", "hong kong", "china", "asia", "pacific"],
    "middle_east": ["uae", "saudi arabia", "qatar", "kuwait", "middle east"],
    "africa": ["south africa", "egypt", "nigeria", "africa"],
    "latin_america": ["brazil", "argentina", "chile", "colombia", "latin america", "south america"],
}
SECTORS = {
    "energy": ["oil", "gas", "petroleum", "energy", "power", "electricity", "renewable"],
    "manufacturing": ["manufacturing", "automotive", "steel", "chemicals", "pharmaceuticals"],
    "construction": ["construction", "infrastructure", "building", "civil engineering"],
    "marine": ["marine", "shipping", "cargo", "vessel", "port", "offshore"],
    "aviation": ["aviation", "aircraft", "airline", "airport", "aerospace"],
    "technology": ["technology", "software", "telecommunications", "data center"],
    "healthcare": ["healthcare", "hospital", "medical", "pharmaceutical"],
    "financial": ["bank", "financial", "insurance", "investment"],
    "retail": ["retail", "shopping", "commercial", "warehouse"],
    "agriculture": ["agriculture", "farming", "crop", "livestock"],
}
CAT_CLASSES = {"high_cat_risk": ["california", "florida", "japan", "caribbean", "philippines"], "medium_cat_risk": ["texas", "new york", "italy", "turkey", "chile"]}
RATING_RANK = {"AAA": 10, "AA+": 9, "AA": 8, "AA-": 7, "A+": 6, "A": 5, "A-": 4, "BBB+": 3, "BBB": 2, "BBB-": 1, "BB+": 0, "BB": -1, "BB-": -2}
SANCTIONS = ["sanctioned", "restricted", "blocked", "prohibited"]
TYPES = ["asset_value", "coverage_limit", "geographic_exposure", "industry_sector", "construction_type", "occupancy_type", "financial_strength", "regulatory_compliance", "catastrophe_exposure", "aggregate_exposure"]


def detected(params: DataFrame) -> DataFrame:
    """Adds region, sector and cat_class (null for an empty location)."""
    place = low("location")
    cat = F.when(place != "", first_class(place, CAT_CLASSES, "low_cat_risk"))
    return params.withColumns({"region": first_class(place, REGIONS), "sector": first_class(low("industry_sector"), SECTORS), "cat_class": cat})


#: Limits of a block, which is broadcast.
BLOCK_LIMITS = 100_000


def violations(params: DataFrame, fin: DataFrame, limits: DataFrame) -> DataFrame:
    """A row for each application and active limit that it violates; a missing or zero asset value violates no amount. Limits are broadcast, BLOCK_LIMITS or so at a time."""
    c = F.col
    apps = detected(params).join(fin.select("application_id", "assets", "liabilities", "credit_rating"), "application_id", "left")
    asset = F.nullif("asset_value", F.lit(0))
    kind = lambda t: c("limit_type") == t
    over = asset > F.nullif("max_amount", F.lit(0))
    banned = c("max_amount") == 0
    about = lambda column: low(column).contains(F.lower("category"))
    searched = F.lower(F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("industry_sector", F.lit("")), F.coalesce("occupancy", F.lit(""))))
    weak = (F.nullif("assets", F.lit(0)).isNull() | F.nullif("liabilities", F.lit(0)).isNull()) | ((c("assets") - c("liabilities")).cast("double") / c("assets").cast("double") < 0.1)
    checks: dict[str, tuple[Column, Column, Column]] = {  # condition, severity, message
        "asset_value": (over, F.lit("ERROR"), F.concat(F.lit("Asset value "), c("asset_value"), F.lit(" exceeds maximum limit of "), c("max_amount"))),
        "coverage_limit": (F.nullif("coverage_limit", F.lit(0)) > F.nullif("max_amount", F.lit(0)), F.lit("ERROR"), F.concat(F.lit("Coverage limit "), c("coverage_limit"), F.lit(" exceeds maximum limit of "), c("max_amount"))),
        "geographic_exposure": ((c("region") == c("geographic_region")) & over, F.lit("WARNING"), F.concat(F.lit("Asset value "), c("asset_value"), F.lit(" in region '"), c("region"), F.lit("' exceeds regional limit of "), c("max_amount"))),
        "industry_sector": ((c("sector") == c("limit_sector")) & (banned | over), F.when(banned, "CRITICAL").otherwise("WARNING"), F.when(banned, F.concat(F.lit("Industry sector '"), c("sector"), F.lit("' is restricted"))).otherwise(F.concat(F.lit("Asset value "), c("asset_value"), F.lit(" in sector '"), c("sector"), F.lit("' exceeds sector limit of "), c("max_amount")))),
        "construction_type": (about("construction_type") & (banned | over), F.when(banned, "ERROR").otherwise("WARNING"), F.concat(F.lit("Construction type '"), c("construction_type"), F.lit("' exceeds limit of "), c("max_amount"))),
        "occupancy_type": (about("occupancy") & (banned | over), F.when(banned, "ERROR").otherwise("WARNING"), F.concat(F.lit("Occupancy '"), c("occupancy"), F.lit("' exceeds limit of "), c("max_amount"))),
        "financial_strength": (
            ((c("category") == "credit_rating") & (F.coalesce("credit_rating", F.lit("")) != "") & (lookup(F.upper("credit_rating"), RATING_RANK, -10) < 2)) | ((c("category") == "minimum_assets") & (F.nullif("assets", F.lit(0)) < F.nullif("max_amount", F.lit(0)))),
            F.lit("WARNING"), F.when(c("category") == "credit_rating", F.concat(F.lit("Credit rating '"), c("credit_rating"), F.lit("' may not meet minimum requirements"))).otherwise(F.concat(F.lit("Assets "), c("assets"), F.lit(" below minimum requirement of "), c("max_amount")))),
        "regulatory_compliance": (
            ((c("category") == "sanctions_check") & has(searched, *SANCTIONS)) | ((c("category") == "capital_requirements") & weak),
            F.when(c("category") == "sanctions_check", "CRITICAL").otherwise("ERROR"), F.when(c("category") == "sanctions_check", "Potential sanctions or restricted entity detected").otherwise("May not meet regulatory capital requirements")),
        "catastrophe_exposure": ((c("cat_class") == c("category")) & over, F.lit("WARNING"), F.concat(F.lit("Asset value "), c("asset_value"), F.lit(" in "), c("cat_class"), F.lit(" catastrophe zone exceeds limit of "), c("max_amount"))),
        "aggregate_exposure": (over, F.lit("ERROR"), F.concat(F.lit("Aggregate exposure "), c("asset_value"), F.lit(" exceeds limit of "), c("max_amount"))),
    }
    matched, severity, message = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, (when, level, text) in checks.items():
        matched = matched | (kind(t) & F.coalesce(when, F.lit(False)))
        severity = F.when(kind(t), level).otherwise(severity)
        message = F.when(kind(t), text).otherwise(message)
    active = limits.where("active").withColumnRenamed("industry_sector", "limit_sector")
    blocks = max(1, ceil(active.count() / BLOCK_LIMITS))
    apps, out = (saved(apps, "limit-apps") if blocks > 1 else apps), None
    for block in range(blocks):  # most conditions are no equalities, so a block of limits goes to all applications
        some = active if blocks == 1 else active.where(F.pmod(F.xxhash64("limit_id"), F.lit(blocks)) == block)
        found = apps.join(F.broadcast(some), matched).select("application_id", "limit_id", "limit_type", severity.alias("severity"), message.alias("message"))
        out = found if out is None else out.unionByName(found)
    return out


def summary(applications: DataFrame, found: DataFrame) -> DataFrame:
    """Counts by severity and type and whether the application passes (no ERROR or CRITICAL); clean ones pass."""
    by = found.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("WARNING", "ERROR", "CRITICAL")), F.array_join(F.array_sort(F.collect_set("limit_type")), "|").alias("types"))
    out = applications.select("application_id").join(by, "application_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return out.select("application_id", zero("n"), zero("n_warning"), zero("n_error"), zero("n_critical"), F.coalesce("types", F.lit("")).alias("types"), (F.coalesce("n_error", F.lit(0)) + F.coalesce("n_critical", F.lit(0)) == 0).alias("passed"))


def by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("limit_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("application_id").alias("applications"))


def check_type(found: DataFrame, limit_type: str) -> DataFrame:
    return found.where(F.col("limit_type") == limit_type).groupBy("application_id").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("message"))


def configuration(limits: DataFrame) -> DataFrame:
    return limits.groupBy("limit_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("n_active"), F.max(F.col("max_amount").cast("double")).alias("most"))


#: Warning (with the number of cases) and recommendation of a type, in the order of the types. Fixed values.
ADVICE = {
    "asset_value": ("Asset value limits exceeded in {} cases", "Consider risk mitigation strategies or senior approval"),
    "geographic_exposure": ("Geographic exposure concerns in {} regions", "Review regional diversification strategy"),
    "industry_sector": ("Restricted industry sectors detected: {} cases", "These industry sectors are not acceptable for reinsurance"),
    "regulatory_compliance": ("Regulatory compliance issues detected", "Perform detailed compliance review before proceeding"),
}


def advice(found: DataFrame) -> DataFrame:
    """Warnings and recommendations of each application, by type; sectors only if restricted."""
    counted = (F.col("limit_type") != "industry_sector") | (F.col("severity") == "CRITICAL")
    n = found.where(F.col("limit_type").isin(*ADVICE)).where(counted).groupBy("application_id", "limit_type").agg(F.count(F.lit(1)).alias("n"))
    place = lookup(F.col("limit_type"), {t: k for k, t in enumerate(ADVICE)}, 99)
    warning, recommend = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, (w, r) in ADVICE.items():
        head, _, tail = w.partition("{}")
        warning = F.when(F.col("limit_type") == t, F.concat(F.lit(head), F.col("n").cast("string"), F.lit(tail)) if "{}" in w else F.lit(w)).otherwise(warning)
        recommend = F.when(F.col("limit_type") == t, r).otherwise(recommend)
    rows = n.select("application_id", F.struct(place.alias("place"), warning.alias("w"), recommend.alias("r")).alias("x"))
    both = rows.groupBy("application_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # one item a type at most
    return both.select("application_id", F.array_join("x.w", "|").alias("warnings"), F.array_join("x.r", "|").alias("recommendations"))


def updated(limits: DataFrame, updates: DataFrame) -> DataFrame:
    """A new snapshot: fields given in updates (limit_id, max_amount, active) replace the old ones; active false is a soft delete."""
    new = updates.select("limit_id", F.col("max_amount").alias("new_amount"), F.col("active").alias("new_active"))
    return limits.join(new, "limit_id", "left").withColumns({"max_amount": F.coalesce("new_amount", "max_amount"), "active": F.coalesce("new_active", "active")}).drop("new_amount", "new_active")
