"""Join sides of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast up to max_rows rows (counted), beyond that a sort-merge join."""
    return df.hint("merge") if df.limit(max_rows + 1).count() > max_rows else F.broadcast(df)


#: A key of more than one in HOT_SHARE of all rows (and more than HOT_ROWS) is dealt to SALTS tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 1000, 64


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys of many rows: HOT_SHARE at most."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    total = rows.count()
    return [r[0] for r in counts.where(F.col("n") * HOT_SHARE > total).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, by: Column) -> DataFrame:
    """An inner sort-merge join on the key in which left's rows of hot keys are dealt to SALTS tasks by the column `by`, and right's rows of hot keys are repeated for each."""
    if not hot:
        return left.join(right.hint("merge"), key)
    is_hot = F.col(key).isin(hot)
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated.hint("merge"), [key, "_salt"]).drop("_salt")
