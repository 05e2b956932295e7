"""Mail screening, assembly, and tables of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SENDERS = ["@broker.", "@cedant."]
SUBJECTS = [["facultative", "reinsurance"], ["fac ", "placement"]]
ATTACHMENT = r"(slip|survey).*[.](pdf|docx|xlsx)$"


def screened(messages: DataFrame) -> DataFrame:
    """Adds accepted: a known sender, a subject with all words of a set, and an attachment whose name and extension fit."""
    subject = F.lower(F.coalesce("subject", F.lit("")))
    known = F.exists(F.array(*map(F.lit, SENDERS)), lambda s: F.lower("sender").contains(s))
    asked = F.lit(False)
    for words in SUBJECTS:
        every = F.lit(True)
        for w in words:
            every = every & subject.contains(w)
        asked = asked | every
    return messages.withColumn("accepted", known & asked & F.lower("attachment").rlike(ATTACHMENT))


def referenced(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, names. The attachment names that the text mentions."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.array_join(F.array_sort(F.filter("names", lambda n: lower.contains(F.lower(n)))), "|").alias("mentioned"))


def region_rollup(regions: DataFrame, least: float = 0.0) -> DataFrame:
    """Regions (doc_id, page, line, text, confidence) of a document in order as one text, with mean confidence and counts; regions below the threshold are dropped."""
    kept = regions.where(F.col("confidence") >= least)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda r: r["text"]), "\n").alias("text"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("regions"), F.count_distinct("page").alias("pages"))


def assembled(messages: DataFrame) -> DataFrame:
    """One document a message: subject, sender, bodies in order, numbered attachments."""
    parts = messages.groupBy("message_id").agg(F.first("subject").alias("subject"), F.first("sender").alias("sender"), F.array_sort(F.collect_list(F.struct("turn", "text", "attachment"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    names = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("Attachment "), (i + 1).cast("string"), F.lit(": "), x["attachment"])), "\n")
    return parts.select("message_id", F.concat_ws("\n", F.concat(F.lit("Subject: "), "subject"), F.concat(F.lit("From: "), "sender"), body, names).alias("document"), F.size("p").alias("attachments"))


def linearised(cells: DataFrame, most: int = 100) -> DataFrame:
    """cells: doc_id, row, col, value. Rows joined with bars under a header tag; the first rows only, as a preview."""
    rows = cells.groupBy("doc_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), " | ").alias("line"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("row"))).where(F.col("place") <= most)  # before they are gathered
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n")
    return first.groupBy("doc_id").agg(F.concat(F.lit("[TABLE]\n"), text).alias("text"))


def entity_fields(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs: doc_id, entities (label, value, score). Names fill insured, then broker, then location; money fills sum insured, then premium."""
    good = F.filter("entities", lambda e: (e["score"] > least) & (e["value"] != ""))
    named = F.filter(good, lambda e: e["label"].isin("PER", "ORG", "LOC"))
    money = F.filter(good, lambda e: e["label"] == "MONEY")
    at = lambda xs, n: F.get(xs, F.lit(n))["value"]
    return docs.select("doc_id", at(named, 0).alias("insured"), at(named, 1).alias("broker"), at(named, 2).alias("location"), at(money, 0).alias("sum_insured"), at(money, 1).alias("premium"))
