"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path

#: A word: a run of characters other than space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key of more than this share of all rows (and so many rows) is dealt to SALTS tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 1000, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write the table out and read it back: cuts the lineage, survives lost executors, and gives later joins true sizes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote and nothing reads any more."""
    path = getattr(df, "_saved_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a join side by its counted size: broadcast up to max_rows rows, else a sort-merge join (which AQE splits where it is skewed)."""
    many = df.limit(max_rows + 1).count() > max_rows
    return df.hint("merge") if many else F.broadcast(df)


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys that hold more than 1/HOT_SHARE of all rows (so HOT_SHARE at most) and more than HOT_ROWS of them. counts: a row a key."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return [r[0] for r in counts.where((F.col(n) * HOT_SHARE > total) & (F.col(n) > HOT_ROWS)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, by: Column, how: str = "inner") -> DataFrame:
    """A sort-merge join on the key in which left's rows of hot keys are dealt to SALTS tasks by the column `by`; right's rows of hot keys are repeated for each."""
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    own = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    others = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return own.join(others.hint("merge"), [key, "_salt"], how).drop("_salt")


def words(text: str) -> Column:
    """The words of a text column; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def count_words(text: str) -> Column:
    """How many words a text column has (long); 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
