"""Market classification, groups, trends and document relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import hot_keys, salted_join
from tidemark.functions.shared import saved
from tidemark.functions.text import class_words, has, hits, low
from tidemark.operators.similarity import dot

# Fixed values.
GEOGRAPHY = {
    "north_america": ["usa", "united states", "america", "canada", "mexico", "north america", "new york", "california", "texas", "florida", "toronto", "vancouver"],
    "europe": ["europe", "european", "uk", "united kingdom", "britain", "england", "germany", "france", "italy", "spain", "netherlands", "switzerland", "london", "paris", "berlin", "madrid", "amsterdam", "zurich"],
    "asia_pacific": ["asia", "pacific", "china", "japan", "singapore", "hong kong", "australia", "new zealand", "south korea", "thailand", "malaysia", "tokyo", "beijing", "shanghai", "sydney", "melbourne"],
    "middle_east_africa": ["middle east", "africa", "uae", "saudi arabia", "qatar", "dubai", "south africa", "egypt", "nigeria", "kenya", "morocco", "johannesburg", "cairo", "lagos", "casablanca"],
    "latin_america": ["latin america", "south america", "brazil", "argentina", "chile", "colombia", "peru", "mexico", "sao paulo", "buenos aires", "santiago", "bogota", "lima"],
}
INDUSTRY = {
    "energy_utilities": ["oil", "gas", "energy", "power", "electricity", "utility", "utilities", "petroleum", "refinery", "pipeline", "solar", "wind", "nuclear", "coal", "lng", "renewable"],
    "manufacturing": ["manufacturing", "factory", "plant", "production", "assembly", "automotive", "steel", "chemical", "pharmaceutical", "textile", "electronics", "machinery", "equipment"],
    "construction_engineering": ["construction", "engineering", "building", "infrastructure", "contractor", "civil", "structural", "bridge", "tunnel", "road", "railway", "airport", "port", "dam"],
    "transportation": ["transportation", "logistics", "shipping", "freight", "cargo", "airline", "aviation", "railway", "trucking", "fleet", "warehouse", "distribution"],
    "technology": ["technology", "software", "hardware", "it", "computer", "data", "telecommunications", "internet", "cloud", "ai", "artificial intelligence", "cybersecurity", "fintech"],
    "healthcare": ["healthcare", "hospital", "medical", "pharmaceutical", "biotech", "clinic", "health", "medicine", "drug", "vaccine", "therapy"],
    "financial_services": ["bank", "banking", "financial", "insurance", "investment", "securities", "fund", "credit", "loan", "mortgage", "fintech"],
    "marine_aviation": ["marine", "maritime", "shipping", "vessel", "ship", "cargo", "aviation", "aircraft", "airline", "airport", "aerospace"],
}
LINE = {
    "property": ["property", "building", "real estate", "fire", "explosion", "natural catastrophe", "earthquake", "flood", "hurricane"],
    "casualty": ["casualty", "liability", "third party", "public liability", "product liability", "professional indemnity", "workers compensation"],
    "marine": ["marine", "cargo", "hull", "vessel", "ship", "maritime", "ocean marine", "inland marine"],
    "aviation": ["aviation", "aircraft", "airline", "airport", "aerospace", "hull", "liability", "passenger"],
    "cyber": ["cyber", "cybersecurity", "data breach", "privacy", "technology", "network security", "cyber liability"],
    "political_risk": ["political risk", "political violence", "war", "terrorism", "confiscation", "expropriation", "currency"],
}
INDICATORS = ["facultative", "reinsurance", "treaty", "quota share", "surplus", "catastrophe", "excess of loss", "stop loss", "aggregate", "cedant", "ceding company", "retrocession"]
FOLLOW_UP, BROKER, AMENDMENT = ["follow up", "update", "status", "response"], ["broker", "intermediary", "agent"], ["amendment", "endorsement", "change", "modification"]
#: Words that a class must reach to count in a group; classes count ten words at most.
THRESHOLD_WORDS, MOST_WORDS = 3, 10


def best_class(words: Column, table: dict[str, list[str]], begin: int) -> Column:
    """The class of most words (of the keywords found, MOST_WORDS at most), the first of several; struct (words, order, name). Without a hit the first class with 0. words: of class_words, in which the table's classes begin at `begin`."""
    return F.array_max(F.array(*(F.struct(F.least(F.get(words, F.lit(begin + n)), F.lit(MOST_WORDS)).alias("words"), F.lit(-n).alias("order"), F.lit(name).alias("name")) for n, name in enumerate(table))))


def document_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))


def sender_domain(column: str) -> Column:
    """What follows the at sign, or null."""
    return F.when(F.col(column).contains("@"), F.substring_index(column, "@", -1))


def classified(docs: DataFrame) -> DataFrame:
    """One pass over the texts: classes and words on three axes, grouped values (by threshold), overall score and indicators."""
    text, geo = F.col("_text"), F.concat_ws(" ", F.col("_text"), sender_domain("sender"))
    out = docs.withColumn("_text", document_text("filename", "subject", "text"))
    out = out.withColumns({"_geo": class_words(geo, GEOGRAPHY), "_words": class_words(text, INDUSTRY, LINE)})
    words = F.col("_words")
    out = out.withColumns({"g": best_class(F.col("_geo"), GEOGRAPHY, 0), "i": best_class(words, INDUSTRY, 0), "l": best_class(words, LINE, len(INDUSTRY))})
    grouped = lambda x, other: F.when(F.col(f"{x}.words") >= THRESHOLD_WORDS, F.col(f"{x}.name")).otherwise(other)
    overall = (F.col("g.words") + F.col("i.words") + F.col("l.words")) / 30.0
    return out.select(
        *docs.columns, F.col("g.name").alias("geography"), F.col("g.words").alias("geography_words"), F.col("i.name").alias("industry"), F.col("i.words").alias("industry_words"), F.col("l.name").alias("line"), F.col("l.words").alias("line_words"), overall.alias("overall"),
        hits(text, INDICATORS).alias("indicators"), F.when(F.col("g.words") > 0, F.col("g.name")).otherwise("unknown").alias("geography_or_unknown"), grouped("g", "unknown").alias("geo_group"), grouped("i", "other").alias("industry_group"), grouped("l", "other").alias("line_group"),
    )


def long_markets(docs: DataFrame) -> DataFrame:
    """A row for each document and axis: market_type, market."""
    return docs.unpivot(["doc_id", "uploaded_at", "filename"], ["geo_group", "industry_group", "line_group"], "market_type", "market")


def distribution(docs: DataFrame) -> DataFrame:
    prefix = F.element_at(F.create_map(F.lit("geo_group"), F.lit("geo_"), F.lit("industry_group"), F.lit("industry_"), F.lit("line_group"), F.lit("business_")), F.col("market_type"))
    return long_markets(docs).groupBy(F.concat(prefix, "market").alias("market")).agg(F.count(F.lit(1)).alias("n"))


def members(docs: DataFrame) -> DataFrame:
    """The documents of each market, a row each: a list of them would grow with the market."""
    return long_markets(docs).select("market_type", "market", "doc_id")


def groups(docs: DataFrame) -> DataFrame:
    """Documents, types, dates and span of each market."""
    kind = F.substring_index("filename", ".", -1)
    long = long_markets(docs).withColumn("kind", kind)
    kinds = long.groupBy("market_type", "market", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("market_type", "market").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), "|").alias("kinds"))  # few kinds
    dates = long.groupBy("market_type", "market").agg(F.count(F.lit(1)).alias("n"), F.min("uploaded_at").alias("first_at"), F.max("uploaded_at").alias("last_at"))
    return dates.withColumn("span_days", F.timestamp_diff("DAY", "first_at", "last_at")).join(kinds, ["market_type", "market"])


def repeated_entities(docs: DataFrame, group: str, entities: str, most: int = 5) -> DataFrame:
    """Entities met more than once in a group, the most frequent first."""
    n = docs.select(group, F.explode(entities).alias("entity")).groupBy(group, "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "entity"))
    return n.withColumn("place", place).where(F.col("place") <= most)


def monthly_trend(docs: DataFrame) -> DataFrame:
    """Months, slope (last less first, by months) and direction: one row."""
    months = docs.groupBy(F.date_format("uploaded_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    one = months.agg(F.count(F.lit(1)).alias("months"), F.min_by("n", "month").alias("first_n"), F.max_by("n", "month").alias("last_n"))
    slope = F.when(F.col("months") > 1, (F.col("last_n") - F.col("first_n")) / F.col("months")).otherwise(0.0)
    return one.withColumn("slope", slope).withColumn("direction", F.when(F.col("months") <= 1, "insufficient_data").when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable"))


def growth(docs: DataFrame, group: str) -> DataFrame:
    """Documents per 30 days of each group that has more than one and spans a day."""
    out = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.timestamp_diff("DAY", F.min("uploaded_at"), F.max("uploaded_at")).alias("days"))
    return out.where("n > 1 AND days > 0").withColumn("per_month", F.col("n") / (F.col("days") / 30))


def seasonal(docs: DataFrame) -> DataFrame:
    """Documents in each of the twelve months of the year."""
    n = docs.groupBy(F.month("uploaded_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = docs.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(n.hint("merge"), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


#: Cosine above which two documents relate.
SIMILAR = 0.5


def relations(docs: DataFrame, block: str = "application_id") -> DataFrame:
    """docs: doc_id, subject, text, entities (array), and embedding (array, may be null; without the column no pair is similar). Pairs within a block that relate, by similarity, by an entity or by type; the type is the first that fits.

    What is looked for in a text is looked for once a document, not once a pair, and so is a vector's norm. Blocks of many documents are dealt to
    many tasks, so pairs are made in parallel whatever block they are of.
    """
    embedding = F.col("embedding") if "embedding" in docs.columns else F.lit(None).cast("array<double>")
    flags = {"follow": has(low("subject"), *FOLLOW_UP), "broker": has(low("text"), *BROKER), "amended": has(low("subject"), *AMENDMENT)}
    rows = saved(docs.select(F.col(block).alias("block"), "doc_id", "entities", embedding.alias("embedding"), F.sqrt(dot(embedding, embedding)).alias("norm"), *(c.alias(n) for n, c in flags.items())).where(F.col(block).isNotNull()), "relation-rows")
    side = lambda n: rows.select("block", *(F.col(c).alias(f"{c}_{n}") for c in ("doc_id", "entities", "embedding", "norm", *flags)))
    pairs = salted_join(side(1), side(2), "block", hot_keys(rows, "block"), F.col("doc_id_1")).where(F.col("doc_id_1") < F.col("doc_id_2"))
    either = lambda f: F.col(f"{f}_1") | F.col(f"{f}_2")
    out = pairs.withColumn("common", F.array_sort(F.array_intersect("entities_1", "entities_2"))).withColumn("similarity", F.coalesce(dot(F.col("embedding_1"), F.col("embedding_2")) / F.nullif(F.col("norm_1") * F.col("norm_2"), F.lit(0.0)), F.lit(0.0)))
    kind = F.when(either("follow"), "follow_up").when(F.size("common") > 2, "same_client").when(either("broker"), "same_broker").when(either("amended"), "amendment").otherwise("unrelated")
    kept = out.withColumn("kind", kind).where((F.col("kind") != "unrelated") | (F.size("common") > 0) | (F.col("similarity") > SIMILAR))  # the dearest last
    return kept.select("block", "doc_id_1", "doc_id_2", "kind", F.array_join("common", "|").alias("common"), "similarity")
