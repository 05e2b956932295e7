"""Merging of rows and passes: later or first non-missing value wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "TBD"


def merge_passes(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The second pass wins where it isn't missing."""
    known = lambda c: F.when(F.col(c) != MISSING, F.col(c))
    other = second.select(key, *(known(f).alias(f"_{f}") for f in fields))
    return first.join(other, key, "left").select(key, *(F.coalesce(f"_{f}", f).alias(f) for f in fields))


def last_values(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Of each field the last value that isn't null; order is total within a key."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def first_values(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Of each field the first value that isn't null or empty."""
    at = F.struct(*order)
    there = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
    return rows.groupBy(key).agg(*(F.min_by(f, F.when(there(f), at)).alias(f) for f in fields))


def merged_slips(rows: DataFrame, fields: list[str], row_id: str = "row_id", confidence: str = "confidence_score", source: str = "source_document", notes: str | None = None) -> DataFrame:
    """Slips of one reference (else one insured, else each its own) as one row: first values, all sources, mean of positive confidences; with notes (a column of arrays) those of all slips in order, and one that says how many slips were merged, if several."""
    key = F.coalesce(F.nullif(F.concat(F.lit("r:"), "reference_number"), F.lit("r:")), F.nullif(F.concat(F.lit("i:"), "insured_name"), F.lit("i:")), F.concat(F.lit("u:"), F.col(row_id).cast("string")))
    keyed = rows.withColumn("merge_key", key)
    values = first_values(keyed, "merge_key", [row_id], [f for f in fields])
    more = keyed.groupBy("merge_key").agg(F.count(F.lit(1)).alias("n_slips"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.avg(F.when(F.col(confidence) > 0, F.col(confidence))).alias("confidence"))
    if notes:
        each = keyed.select("merge_key", row_id, F.posexplode_outer(notes).alias("_at", "_note")).groupBy("merge_key").agg(F.array_sort(F.collect_list(F.when(F.col("_note").isNotNull(), F.struct(row_id, "_at", "_note")))).alias("_notes"))
        merged = F.when(F.col("n_slips") > 1, F.array(F.concat(F.lit("Merged data from "), F.col("n_slips").cast("string"), F.lit(" documents")))).otherwise(F.array().cast("array<string>"))
        more = more.join(each, "merge_key").withColumn("notes", F.concat(F.transform("_notes", lambda x: x["_note"]), merged)).drop("_notes")
    return values.join(more, "merge_key")


def pivoted_first(cells: DataFrame, wanted: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """cells: key, row, column, value. Of each wanted field the first value under a column whose name holds one of its words."""
    name = F.lower("column")
    hit = lambda ws: F.reduce(F.array(*(name.contains(w) for w in ws)), F.lit(False), lambda a, x: a | x)
    return cells.groupBy(key).agg(*(F.min_by("value", F.when(hit(ws) & F.col("value").isNotNull(), F.struct("row", "column"))).alias(f) for f, ws in wanted.items()))
