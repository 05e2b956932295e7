"""Field extraction over slip texts: one pass of column expressions, no Python in it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import has, hits, let, low

# Patterns (in the syntax that Java and RE2 share) and keyword lists.
COMPANY = r"^(.*\b(?:Ltd|Inc|Corp|Company|Insurance|Reinsurance|Group|plc|LLC|AG|SA|SE|NV|BV)\b)"
PATTERNS = {
    "reference": r"(?i)\b(?:policy|ref|reference|slip)(?: number| no)?\s*[:#]\s*([A-Z0-9/-]+)",
    "date": r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    "email": r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b",
    "location": r"(?i)\b(?:located|situated|location)\s*:?\s*([A-Z][A-Za-z, ]+)",
    "insured": r"(?i)\b(?:insured|assured)\s*:\s*([A-Z][A-Za-z &.,()-]+)",
    "cedant": r"(?i)\b(?:cedant|reinsured|ceding company)\s*:\s*([A-Z][A-Za-z &.,()-]+)",
    "broker": r"(?i)\b(?:broker|intermediary)\s*:\s*([A-Z][A-Za-z &.,()-]+)",
    "perils": r"(?i)\bperils?(?: covered)?\s*:\s*([A-Za-z ,&/()-]+)",
    "geo_limit": r"(?i)\b(?:geographical limit|territory)\s*:\s*([A-Za-z ,&/()-]+)",
    "situation": r"(?i)\b(?:situation|location|premises)\s*:\s*([A-Za-z0-9 ,&/().-]+)",
    "sum_insured": r"(?i)\b(?:total sum insured|sum insured|tsi)\s*:\s*(?:[A-Z]{3})?\s*([0-9][0-9,]*(?:\.[0-9]+)?)",
    "premium": r"(?i)\bpremium\s*:\s*(?:[A-Z]{3})?\s*([0-9][0-9,]*(?:\.[0-9]+)?)",
    "excess": r"(?i)\b(?:excess|deductible)\s*:\s*(?:[A-Z]{3})?\s*([0-9][0-9,]*(?:\.[0-9]+)?)",
    "retention": r"(?i)\bretention\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*%",
    "rate": r"(?i)\brate\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*%",
    "period": r"(?i)\bperiod(?: of insurance)?\s*:\s*([^\n]+)",
    "pml": r"(?i)(?:\bPML|maximum probable loss|probable maximum loss)\s*:?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent)",
    "percent": r"([0-9]+(?:\.[0-9]+)?)%",
    "share": r"(?i)\b(?:quota share|participation|share offered|line size|share)\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent)",
    "deduction": r"(?i)\b(?:commission|deduction|brokerage deduction)\s*:\s*(?:[A-Z]{3})?\s*([0-9][0-9,]*(?:\.[0-9]+)?)",
    "claims": r"(?i)((?:claims experience|loss record|claims history)[^\n]*)",
    "survey": r"(?i)([^\n]*\bsurvey(?:or)?[^\n]*)",
    "amount": r"\b(?:USD|EUR|GBP|KES)\s*[0-9][0-9,]*(?:\.[0-9]+)?",
}
CURRENCIES = ["USD", "EUR", "GBP", "KES"]
COVERAGES = [
    "property", "casualty", "marine", "aviation", "energy", "cyber", "political risk", "credit", "surety", "life", "health", "accident", "motor", "fire", "flood", "earthquake", "cat", "catastrophe", "wind", "storm", "terrorism",
]
TREATIES = ["quota share", "surplus", "excess of loss", "stop loss", "aggregate excess", "catastrophe", "per risk", "per occurrence", "working excess", "clash", "aggregate", "cat xl", "working xl"]
PERIL_WORDS = [
    "fire", "explosion", "earthquake", "flood", "windstorm", "hurricane", "typhoon", "tornado", "hail", "lightning", "theft", "burglary", "vandalism", "malicious damage", "terrorism", "war", "civil commotion", "riot", "strike", "impact", "aircraft",
    "vehicle", "smoke", "water damage", "leakage", "burst pipes", "sprinkler leakage", "subsidence", "landslide", "volcanic eruption", "tsunami", "storm surge", "business interruption", "machinery breakdown", "boiler explosion", "cyber attack",
    "data breach", "system failure", "power outage", "contamination", "pollution",
]
OCCUPATIONS = [
    "manufacturing", "retail", "wholesale", "distribution", "logistics", "transportation", "construction", "real estate", "hospitality", "restaurant", "hotel", "healthcare", "education", "technology", "software", "telecommunications", "energy", "utilities",
    "mining", "agriculture", "forestry", "fishing", "banking", "finance", "insurance", "consulting", "professional services", "government", "non-profit", "entertainment", "media", "publishing", "pharmaceutical", "chemical", "automotive", "aerospace",
    "defense", "oil and gas", "renewable energy", "waste management", "recycling",
]
PML_WORDS = [
    "pml", "probable maximum loss", "maximum probable loss", "mpl", "worst case scenario", "maximum foreseeable loss", "mfl", "estimated maximum loss", "eml", "maximum possible loss", "catastrophe loss", "single event loss", "aggregate loss", "occurrence loss",
]
CAT_WORDS = [
    "catastrophe exposure", "cat exposure", "natural catastrophe", "nat cat", "peril exposure", "earthquake", "flood", "hurricane", "windstorm", "typhoon", "cyclone", "tsunami", "volcanic eruption", "wildfire", "hailstorm", "tornado", "storm surge", "landslide",
    "subsidence", "drought", "freeze", "winter storm", "severe weather", "climate peril", "catastrophe zone", "hazard zone", "exposure zone", "risk zone", "peril zone", "rms model", "air model", "eqecat model", "karen clark model", "catastrophe model",
]
CAT_MODELS = ["rms", "air", "eqecat", "karen clark", "model"]
CLIMATE_WORDS = [
    "climate change", "climate risk", "global warming", "carbon footprint", "greenhouse gas", "emissions", "sustainability", "environmental impact", "physical climate risk", "transition risk", "stranded assets", "carbon pricing", "renewable energy",
    "green technology", "climate adaptation", "climate resilience", "climate mitigation", "carbon neutral", "net zero", "decarbonization", "climate scenario", "tcfd",
]
CLIMATE_LEVELS = ["low", "medium", "high", "significant", "minimal", "moderate", "severe"]
CLIMATE_FRAMES = ["tcfd", "task force", "scenario analysis", "physical risk", "transition risk"]
ESG_WORDS = [
    "esg", "environmental social governance", "environmental social and governance", "sustainability", "corporate responsibility", "csr", "social responsibility", "governance risk", "environmental risk", "social risk", "ethical risk",
    "reputation risk", "stakeholder risk", "regulatory risk", "compliance risk", "diversity", "inclusion", "human rights", "labor practices", "supply chain", "board composition", "executive compensation", "transparency", "accountability",
    "anti-corruption", "data privacy", "cybersecurity", "business ethics",
]
ESG_SIGNS = ["assessed", "evaluated", "rating", "score", "compliance", "framework"]
ESG_PARTS = ["environmental", "social", "governance", "sustainability", "diversity"]
DOCUMENT_TYPES = {
    "property_survey": ["property survey", "survey report", "property inspection", "building survey"],
    "ri_slip": ["ri slip", "reinsurance slip", "facultative slip", "treaty slip"],
    "risk_placement": ["placement slip", "contract wording", "policy wording", "terms and conditions"],
    "inspection_report": ["inspection report", "loss inspection", "claim inspection", "site inspection"],
    "supporting_document": ["certificate", "valuation", "financial statement", "loss history"],
}
PRIMARY = ["ri slip", "reinsurance slip", "facultative slip", "fac slip", "treaty slip", "placement slip", "line slip", "open cover", "facultative certificate", "facultative reinsurance", "reinsurance placement", "risk placement", "cover note", "binding authority", "reinsurance contract", "ri contract", "reinsurance slip", "facultative placement", "treaty placement", "reinsurance offer", "facultative offer", "ri offer"]
SECONDARY = ["cedant", "reinsured", "ceding company", "original insurer", "reinsurer", "accepting office", "lead underwriter", "quota share", "surplus", "excess of loss", "stop loss", "sum insured", "policy limit", "attachment point", "retention", "deductible", "excess", "coverage limit", "indemnity limit", "perils covered", "risks covered", "coverage territory", "geographical limit", "policy period", "period of insurance"]
SLIP_TYPES = ["facultative", "treaty", "placement", "cover note", "binding authority", "line slip", "open cover"]
FORMATS = {"pdf": ["pdf"], "docx": ["docx", "doc"], "excel": ["xlsx", "xls", "xlsm", "csv"], "powerpoint": ["pptx", "ppt"], "image": ["png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif"]}
SECONDS = {"pdf": 30, "docx": 20, "excel": 15, "powerpoint": 25, "image": 45, "other": 10}


#: Patterns that Java's engine is slow on, in forms that find the same: a line is searched from its start only, not from each of its characters; amounts are tried where one of their letters stands.
QUICK = {"survey": r"(?i)(?<![^\n])([^\n]*?\bsurvey[^\n]*)", "amount": r"(?=[UEGK])\b(?:USD|EUR|GBP|KES)\s*[0-9][0-9,]*+(?:\.[0-9]+)?"}


def quick(name: str) -> str:
    return QUICK.get(name, PATTERNS[name])


def led(pattern: str) -> str:
    """A pattern (?i)(?:words)rest that is tried only where a first letter of its words stands."""
    words = re.match(r"\(\?i\)\(\?:(.*?)\)", pattern)[1].split("|")
    return f"(?i)(?=[{''.join(sorted({w[0] for w in words}))}]){pattern[4:]}"


def first(text: Column, name: str) -> Column:
    """The first match of a pattern's group, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, quick(name), 1)), F.lit(""))


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def parsed_money(text: Column) -> Column:
    """A number in US or European notation: of a comma and a point the later one marks decimals; a lone comma does if at most two digits follow."""
    digits = F.regexp_replace(text, r"[^0-9.,]+", "")
    plain = F.translate(digits, ",", "")
    comma, point = F.length(F.substring_index(digits, ",", -1)), F.length(F.substring_index(digits, ".", -1))
    european = F.when(digits.contains(",") & digits.contains("."), comma < point).when(digits.contains(","), (comma <= 2) & (F.length(digits) - F.length(plain) == 1)).otherwise(False)
    return F.when(european, F.translate(digits, ",.", ".")).otherwise(plain).try_cast("double")


def percentage(text: str) -> Column:
    """The first percentage of a text, if it lies between 0 and 100."""
    value = number(F.nullif(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), PATTERNS["percent"], 1), F.lit("")))
    return F.when(value.between(0, 100), value)


def currency_of(text: Column) -> Column:
    """An ISO code, else a symbol."""
    code = F.regexp_extract(F.upper(text), r"\b(USD|EUR|GBP|KES|JPY)\b", 1)
    return F.when(code != "", code).when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("£"), "GBP")


def basic_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """Reference, date, mails, location, amounts with their currency (the last of those named wins), by order of appearance."""
    t = F.coalesce(F.col(text), F.lit(""))
    amounts = F.regexp_extract_all(t, F.lit(quick("amount")), F.lit(0))
    named = F.filter(F.array(*map(F.lit, CURRENCIES)), lambda c: t.contains(c))
    at = lambda n: number(F.regexp_replace(F.get("amounts", F.lit(n)), "[A-Z ]", ""))
    out = docs.withColumns({"amounts": amounts, "reference": first(t, "reference"), "first_date": first(t, "date"), "location": first(t, "location"), "currency": F.get(F.reverse(named), F.lit(0)), "mails": F.array_join(F.regexp_extract_all(t, F.lit(PATTERNS["email"]), F.lit(1)), "|")})
    return out.withColumns({"amount_1": at(0), "amount_2": at(1), "amount_3": at(2)})


#: In the order in which they are tried.
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy"]


def parsed_date(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))


def first_keyword(text: Column, words: list[str]) -> Column:
    return F.get(hits(text, words), F.lit(0))


def labelled_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    t, lower = F.coalesce(F.col(text), F.lit("")), low(text)
    columns = {n: first(t, n) for n in ("insured", "cedant", "broker", "perils", "geo_limit", "situation", "period")}
    columns |= {f"{n}_company": F.nullif(F.regexp_extract(F.coalesce(columns[n], F.lit("")), COMPANY, 1), F.lit("")) for n in ("insured", "cedant", "broker")}
    columns |= {n: number(first(t, n)) for n in ("sum_insured", "premium", "excess", "retention")}
    rate = number(first(t, "rate"))
    columns |= {"rate": F.when(rate.between(0, 100), rate), "coverage": first_keyword(lower, COVERAGES), "line_of_business": first_keyword(lower, COVERAGES), "treaty": first_keyword(lower, TREATIES)}
    columns |= {"peril_words": F.array_join(F.slice(hits(lower, PERIL_WORDS), 1, 10), "|"), "occupation": first_keyword(lower, OCCUPATIONS)}
    return docs.withColumns(columns)


def clean_name(text: Column) -> Column:
    """Blanks joined, outer punctuation off, words with a capital letter; letters after any non-letter are capitals."""
    joined = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[ ,.;:-]+|[ ,;:-]+$", "")
    parts = F.regexp_extract_all(joined, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(2, 10_000)))), "")


def pml(docs: DataFrame, text: str = "text") -> DataFrame:
    """PML percentage and confidence: 0.9 by pattern, 0.7 near a keyword (50 characters before to 100 after), above 100 capped at 0.3; up 0.1 in the usual range, down 0.2 below 1."""
    t, lower = F.coalesce(F.col(text), F.lit("")), low(text)
    near_word = lambda low_text, w: let(F.position(w, low_text), lambda at: number(F.nullif(F.regexp_extract(t.substr(F.greatest(F.lit(1), at - 50), F.when(at > 50, 150).otherwise(at + 99)), PATTERNS["percent"], 1), F.lit(""))))
    found = let(lower, lambda x: F.transform(F.filter(F.array(*map(F.lit, PML_WORDS)), lambda w: x.contains(w)), lambda w: near_word(x, w)))
    # each is computed once: later steps look at a column
    docs = docs.withColumn("_pml", F.array(number(first(t, "pml")), F.get(F.array_compact(found), F.lit(0))))
    by_pattern, near = F.get("_pml", F.lit(0)), F.get("_pml", F.lit(1))
    given = F.nullif(by_pattern, F.lit(0.0))
    value = F.coalesce(given, near, by_pattern)
    base = F.when(given > 100, 0.3).when(given.isNotNull(), 0.9).when(near.isNotNull(), 0.7).when(by_pattern.isNotNull(), 0.9).otherwise(0.0)
    sure = F.when((base > 0.5) & (value >= 1), F.least(base + 0.1, F.lit(1.0))).when((base > 0.5) & (value < 1) & (value > 0), F.greatest(base - 0.2, F.lit(0.1))).otherwise(base)
    return docs.withColumns({"pml": F.when(value.isNotNull(), F.least(value, F.lit(100.0))), "pml_confidence": F.round(sure, 4)}).drop("_pml")


def share_offered(docs: DataFrame, text: str = "text") -> DataFrame:
    """Share in percent (a fraction below 1 counts as such) and confidence."""
    value = number(first(F.coalesce(F.col(text), F.lit("")), "share"))
    value = F.when((value > 0) & (value < 1), value * 100).otherwise(value)
    sure = F.when(value.isNull(), 0.0).when(value > 100, 0.3).when(value >= 1, 1.0).otherwise(0.7)
    return docs.withColumns({"share": F.when(value.isNotNull(), F.least(value, F.lit(100.0))), "share_confidence": sure})


def period(docs: DataFrame, text: str = "text") -> DataFrame:
    """Period text and confidence: both dates 0.9, one 0.8, a number of months 0.7, any other text 0.6; 0.1 more for usual terms."""
    p = first(F.coalesce(F.col(text), F.lit("")), "period")
    dates = F.regexp_count(p, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"))
    base = F.when(p.isNull(), 0.0).when(dates >= 2, 0.9).when(dates == 1, 0.8).when(p.rlike(r"(?i)\d+ months?"), 0.7).otherwise(0.6)
    usual = F.when(F.coalesce(p.rlike("(?i)12 months|annual|from"), F.lit(False)), 0.1).otherwise(0.0)
    return docs.withColumns({"period": p, "period_confidence": F.when(p.isNull(), 0.0).otherwise(F.round(F.least(F.lit(1.0), base + usual), 4))})


def deductions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Commission or deduction and confidence by its range: up to 50, up to 100, an amount above."""
    v = number(first(F.coalesce(F.col(text), F.lit("")), "deduction"))
    return docs.withColumns({"deduction": v, "deduction_confidence": F.when(v.isNull(), 0.0).when(v <= 50, 0.9).when(v <= 100, 0.7).otherwise(0.8)})


def claims(docs: DataFrame, text: str = "text") -> DataFrame:
    c = first(F.coalesce(F.col(text), F.lit("")), "claims")
    return docs.withColumns({"claims": F.substring(c, 1, 1000), "claims_confidence": F.when(c.isNull(), 0.0).when(c.rlike("(?i)nil|no claims"), 0.9).otherwise(0.8)})


def joined(text: Column) -> Column:
    """Blanks joined, outer ones off."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def topic(docs: DataFrame, name: str, words: list[str], before: int, after: int, most: int, extra: list[tuple[list[str], int, float]], text: str = "text") -> DataFrame:
    """What stands around the first three keywords of a topic, and confidence: 0.6, 0.1 more for each further keyword, and for each kind of evidence (words, how many of them at least, weight) that the result holds."""
    t, lower = F.coalesce(F.col(text), F.lit("")), low(text)
    cut = lambda x, k: let(F.position(k, x), lambda at: t.substr(F.greatest(F.lit(1), at - before), F.least(at - 1, F.lit(before)) + after))
    around = let(lower, lambda x: F.transform(F.slice(F.filter(F.array(*map(F.lit, words)), lambda k: x.contains(k)), 1, 3), lambda k: F.regexp_replace(cut(x, k), r"^\s+|\s+$", "")))
    docs = docs.withColumn("_around", around)
    whole = joined(F.array_join("_around", "; "))
    docs = docs.withColumn(name, F.when(F.size("_around") > 0, F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)))
    sure = F.lit(0.5) + 0.1 * F.size("_around")
    for keywords, least, weight in extra:
        sure = F.least(F.lit(1.0), sure + F.when(F.size(hits(low(name), keywords)) >= least, weight).otherwise(0.0))
    return docs.withColumn(f"{name}_confidence", F.when(F.size("_around") > 0, F.round(sure, 4)).otherwise(0.0)).drop("_around")


def survey(docs: DataFrame, text: str = "text") -> DataFrame:
    """The line on a survey, and the attachment that it names."""
    s = first(F.coalesce(F.col(text), F.lit("")), "survey")
    linked = F.nullif(F.regexp_extract(F.coalesce(s, F.lit("")), r"(?i)([a-z0-9_]+\.(?:pdf|docx|xlsx))", 1), F.lit(""))
    return docs.withColumns({"survey": F.substring(s, 1, 500), "survey_file": linked, "survey_confidence": F.when(s.isNull(), 0.0).when(linked.isNotNull(), 0.9).otherwise(0.7)})


EXTRACT_WEIGHTS = {"reference": 0.15, "insured": 0.15, "cedant": 0.1, "broker": 0.1, "sum_insured": 0.15, "premium": 0.1, "period": 0.1, "perils": 0.05, "location": 0.05, "currency": 0.05}


def extraction_confidence(docs: DataFrame) -> DataFrame:
    """Weighted share of the fields that were found, and the names of those that weren't."""
    score = sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in EXTRACT_WEIGHTS.items()), F.lit(0.0))
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in EXTRACT_WEIGHTS))), "|")
    return docs.withColumns({"extraction_confidence": F.round(score, 4), "missing_fields": missing})


def all_fields(docs: DataFrame) -> DataFrame:
    """Every extractor over the whole corpus in one pass."""
    out = labelled_fields(basic_fields(docs))
    for step in (pml, share_offered, deductions, claims, survey):
        out = step(out)
    return extraction_confidence(out)


def document_format(filename: str) -> Column:
    ext = F.lower(F.substring_index(filename, ".", -1))
    out = None
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out.otherwise("other")


def document_type(text: str, filename: str) -> Column:
    """The first type of which the text or the file's name holds a keyword."""
    both = F.concat_ws("\n", low(text), low(filename))
    found = let(both, lambda t: F.filter(F.array(*(F.struct(F.lit(k).alias("type"), F.array(*map(F.lit, ws)).alias("words")) for k, ws in DOCUMENT_TYPES.items())), lambda d: F.exists(d["words"], lambda w: t.contains(w))))
    return F.coalesce(F.get(found, F.lit(0))["type"], F.lit("supporting_document"))


def largest_amount(docs: DataFrame, text: str = "text", least: float = 1000.0, window: int = 80) -> DataFrame:
    """The largest number above `least` and the currency code that stands within so many characters of it."""
    t = F.coalesce(F.col(text), F.lit(""))
    given = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))
    numbers = F.filter(F.transform(given, lambda g, i: F.struct(number(g).alias("value"), (-i).alias("i"), g.alias("given"))), lambda x: x["value"] > least)
    docs = docs.withColumn("_largest", F.array_max(numbers))
    at = F.position(F.col("_largest.given"), t)
    near = t.substr(F.greatest(F.lit(1), at - window), F.least(at - 1, F.lit(window)) + F.length("_largest.given") + window)
    code = F.nullif(F.regexp_extract(near, r"\b(USD|EUR|GBP|KES)\b", 1), F.lit(""))
    return docs.withColumns({"largest": F.col("_largest.value"), "largest_currency": code}).drop("_largest")


NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
SLIP_PATTERNS = {
    "reference": r"(?i)(?:ref|reference|policy|slip|fac|ri)[\s#:-]*([A-Z0-9/-]+)", "percentage": r"(?i)(?:share|percentage|%|quota|surplus)[\s:]*(\d+(?:\.\d+)?%?)", "sum_insured": r"(?i)(?:sum insured|limit|coverage|indemnity)[\s:]*([A-Z]{3}[\s$]*[\d,]+(?:\.\d{2})?)",
    "period": r"(?i)(?:period|from|effective)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", "cedant": r"(?i)(?:cedant|reinsured|ceding company|original insurer)[\s:]*([A-Z][a-zA-Z\s&.,]+)",
}

#: More than 50 words.
MORE_WORDS = r"\A\s*+(?:\S++\s++){50}\S"


def slips(docs: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """Indicators, confidence, type, quality, issues, priority and validity of each document as a reinsurance slip. A primary phrase that the list holds twice scores twice."""
    c = F.col
    lower, whole = low(text), F.coalesce(c(text), F.lit(""))
    # matches are counted for the columns n_ only; all else needs the first one
    columns = {f"n_{n}": F.regexp_count(whole, F.lit(led(p))) for n, p in SLIP_PATTERNS.items()} | {f"has_{n}": whole.rlike(led(p)) for n, p in SLIP_PATTERNS.items()}
    out = docs.withColumns(columns | {"primary": hits(lower, PRIMARY), "secondary": hits(lower, SECONDARY), "format": document_format(filename)})
    patterns = sum((F.when(c(f"has_{n}"), 0.1 if n in ("reference", "sum_insured") else 0.05).otherwise(0.0) for n in SLIP_PATTERNS), F.lit(0.0))
    bonus = F.when(c("format").isin("pdf", "docx"), 0.1).when(c("format").isin("excel", "powerpoint", "image"), 0.05).otherwise(0.0)
    sure = F.least(F.lit(1.0), F.least(F.size("primary") * 0.3, F.lit(0.6)) + F.least(F.size("secondary") * 0.05, F.lit(0.2)) + F.least(patterns, F.lit(0.25)) + bonus)
    kind = None
    for t in SLIP_TYPES:
        test = F.arrays_overlap("primary", F.array(*(F.lit(k) for k in PRIMARY if t in k))) if any(t in k for k in PRIMARY) else F.lit(False)
        kind = F.when(test, t) if kind is None else kind.when(test, t)
    kind = kind.when(F.size("primary") > 0, "unknown")
    checks = [
        (c("has_reference"), 0.2, "No reference number found"), (c("has_sum_insured") | c("has_percentage"), 0.25, "No financial data (sum insured/percentages) found"), (c("has_cedant") | lower.contains("reinsurer"), 0.2, "No party information (cedant/reinsurer) found"),
        (has(lower, "coverage", "perils", "risks covered", "policy"), 0.15, "No coverage details found"), (c("has_period"), 0.1, "No period/date information found"), (whole.rlike(MORE_WORDS), 0.1, "Document appears too short or poorly structured"),
    ]
    quality = sum((F.when(a, w).otherwise(0.0) for a, w, _ in checks), F.lit(0.0))
    issues = F.array_compact(F.array(*(F.when(~a, F.lit(i)) for a, _, i in checks)))
    out = out.withColumns({"confidence": F.round(sure, 4), "kind": kind, "quality": F.round(quality, 4), "issues": issues})
    is_slip = c("confidence") >= 0.3
    priority = F.when(~is_slip, 4).when((c("confidence") >= 0.7) & (c("quality") >= 0.6), 1).when(c("confidence") >= 0.5, 2).otherwise(3)
    matched = sum((F.when(c(f"has_{n}"), 1).otherwise(0) for n in SLIP_PATTERNS), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.size("primary") > 0, F.concat(F.lit("Primary RI keywords found: "), F.array_join(F.slice("primary", 1, 3), ", "))), F.when(matched > 0, F.concat(F.lit("RI patterns detected: "), matched.cast("string"), F.lit(" types"))),
        F.when(c("format").isin("pdf", "docx"), F.concat(F.lit("Primary document format: "), c("format"))),
    ))
    out = out.withColumn("reasons", reasons)
    out = out.withColumns({"is_slip": is_slip, "priority": priority, "valid": is_slip & (c("quality") >= 0.5) & (F.size("issues") <= 3)})
    return out.drop(*(f"has_{n}" for n in SLIP_PATTERNS))


def plan(docs: DataFrame, message: str, index: str) -> DataFrame:
    """Processing order within a message: facultative slips before placement slips before others, unless the best placement is better by 0.15; then supporting documents by confidence, then the rest by name."""
    from pyspark.sql import Window

    best = lambda k: F.max(F.when((F.col("kind") == k) & F.col("is_slip"), F.col("quality"))).over(Window.partitionBy(message))
    out = docs.withColumns({"best_fac": best("facultative"), "best_place": best("placement")})
    ahead = F.coalesce(F.col("best_place") >= F.col("best_fac") + 0.15, F.lit(False))
    rank = F.when(~F.col("is_slip"), F.when(F.col("confidence") >= 0.15, 3).otherwise(4)).when(F.col("kind") == "facultative", F.when(ahead, 1).otherwise(0)).when(F.col("kind") == "placement", F.when(ahead, 0).otherwise(1)).otherwise(2)
    order = Window.partitionBy(message).orderBy("rank", F.desc("s1"), F.desc("s2"), "s3", index)
    out = out.withColumns({"rank": rank, "s1": F.when(rank <= 2, F.col("quality")).when(rank == 3, F.col("confidence")), "s2": F.when(rank <= 2, F.col("confidence")), "s3": F.when(rank == 4, F.col("filename"))})
    return out.withColumn("place", F.row_number().over(order)).drop("best_fac", "best_place", "s1", "s2", "s3")


def plan_summary(planned: DataFrame, message: str) -> DataFrame:
    """Documents, slips, expected seconds and advice of each message."""
    seconds = F.element_at(F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv)), F.col("format"))
    out = planned.groupBy(message).agg(F.count(F.lit(1)).alias("documents"), F.count_if("is_slip").alias("slips"), F.sum(seconds).alias("seconds"), F.max("quality").alias("best"))
    advice = F.when(F.col("slips") == 0, "No slip found: review by hand").when(F.col("slips") > 1, "Several slips: process the first by plan").when(F.col("best") < 0.5, "Slip of low quality: check the fields").otherwise("Process as planned")
    return out.withColumn("advice", advice)


def section_scores(docs: DataFrame, words: list[str], text: str = "text", separator: str = "\n\n") -> DataFrame:
    """Sections of each text and their score: 0.2 a keyword up to 0.6, 0.2 for digits, 0.2 for a date."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), separator)).alias("place", "section"))
    lower = low("section")
    score = F.least(F.lit(0.6), F.size(hits(lower, words)) * 0.2) + F.when(F.col("section").rlike("[0-9]"), 0.2).otherwise(0.0) + F.when(F.col("section").rlike(PATTERNS["date"]), 0.2).otherwise(0.0)
    return parts.withColumn("score", F.round(score, 4))


def truncated(docs: DataFrame, words: list[str], budget: int, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """Texts above the budget keep 30 % from the head and 20 % from the tail; between them the best sections that still fit (a fold: one that doesn't fit is skipped), in their order."""
    t = F.coalesce(F.col(text), F.lit(""))
    head, tail = int(budget * 0.3), int(budget * 0.2)
    middle = F.split(t.substr(F.lit(head + 1), F.length(t) - head - tail), separator)
    scored = F.transform(middle, lambda s, i: F.struct((-F.size(F.filter(F.array(*map(F.lit, words)), lambda k: F.lower(s).contains(k)))).alias("score"), i.alias("i"), s.alias("s")))
    start = F.struct(F.lit(budget - head - tail).alias("left"), F.array().cast("array<struct<i:int,s:string>>").alias("kept"))
    step = lambda a, x: F.when(F.length(x["s"]) <= a["left"], F.struct((a["left"] - F.length(x["s"])).alias("left"), F.concat(a["kept"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s")))).alias("kept"))).otherwise(a)
    kept = F.aggregate(F.array_sort(scored), start, step, lambda a: F.array_join(F.transform(F.array_sort(a["kept"]), lambda x: x["s"]), separator))
    short = F.concat(t.substr(F.lit(1), F.lit(head)), F.lit(separator), kept, F.lit(separator), t.substr(F.length(t) - tail + 1, F.lit(tail)))
    return docs.withColumn("truncated", F.when(F.length(t) <= budget, t).otherwise(short))


def recovered_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Model answers: fences off, parsed, else the part from the first to the last brace."""
    plain = F.regexp_replace(F.trim(F.col(column)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    options = {"mode": "PERMISSIVE"}
    whole = F.when(plain.startswith("{"), F.from_json(plain, schema, options))
    return df.withColumn("parsed", F.coalesce(whole, F.from_json(F.regexp_extract(F.col(column), r"(?s)(\{.*\})", 1), schema, options)))
