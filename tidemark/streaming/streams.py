"""Streams: intake of messages, rolling statistics, periodic rollups. Each has a batch twin with the same columns.

Aggregates run in append mode: a window is given once, when the watermark has passed its end, and its state is then
dropped, so state holds the open windows of the retention only (but for whole_rollup, which gives open windows too). Rows older than the watermark are dropped and counted
by the stream's progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.shared import new_path, saved
from tidemark.operators.mail import screened

RETENTION = "24 hours"
#: Size of a quantile sketch: exact up to as many values, beyond that within a rank error of about 0.1 %.
SKETCH = 4096
NOW = {"availableNow": True}


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table as a stream of files, be it one file or a folder of parts. (The path is a pattern of that one name: without a pattern, a stream takes folders only.)"""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{table}.parque[t]")


def fed(rows: DataFrame, batch: Column, batches: int, run: Callable[[DataFrame], StreamingQuery], name: str) -> list:
    """Rows arrive in batches (0, 1, ... as the column says): each is written to a folder, and run(stream of the folder) starts again from its own checkpoint. The progress reports of all runs."""
    spark = rows.sparkSession
    held, path, out = saved(rows.withColumn("_batch", batch), name), new_path(spark, f"{name}-files"), []
    for n in range(batches):
        held.where(F.col("_batch") == n).drop("_batch").write.mode("append").parquet(path)
        query = run(spark.readStream.schema(rows.schema).parquet(path))
        query.awaitTermination()
        out += query.recentProgress
    return out


def logs_of(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("event_type").alias("process_type"), F.col("value"), F.col("ts").cast("timestamp").alias("created_at"))


def written(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Appends what the stream gives, up to all that is there. A batch has a folder of its own by its number, so one that is run again replaces itself. In complete mode a batch gives all rows anew, and replaces those of the one before."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else n}")
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**NOW).start()


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and gives what it wrote."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    written(stream, out, new_path(spark, f"{name}-state"), mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def drained_in_batches(rows: DataFrame, batch: Column, batches: int, of: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, list]:
    """As drained, for rows that arrive in batches: what of(stream) wrote over all of them, and all progress reports."""
    spark = rows.sparkSession
    out, checkpoint, schema = new_path(spark, name), new_path(spark, f"{name}-state"), of(rows).schema
    reports = fed(rows, batch, batches, lambda stream: written(of(stream), out, checkpoint), name)
    return spark.read.schema(schema).parquet(out).select(*schema.names), reports


def dropped(reports: list) -> int:
    """Rows that came too late, of all state operators."""
    return sum(s.numRowsDroppedByWatermark for r in reports for s in r.stateOperators)


def held_back(logs: DataFrame) -> DataFrame:
    return logs.withWatermark("created_at", RETENTION) if logs.isStreaming else logs


def windowed(logs: DataFrame, width: str, slide: str | None, aggregates: dict[str, Column]) -> DataFrame:
    """logs: held back, if a stream."""
    w = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    out = logs.groupBy(w.alias("w"), "process_type").agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "process_type", *aggregates)


BASIC = {"n": F.count, "mean": F.avg, "most": F.max, "least": F.min}


def rollup(logs: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Count, mean, maximum and minimum of each process in windows."""
    return windowed(held_back(logs), width, slide, {n: f("value") for n, f in BASIC.items()})


def whole_rollup(logs: DataFrame, width: str) -> DataFrame:
    """As rollup, for streams in complete mode: open windows too, and rows however late. Their state is the result, a row for each window and process."""
    return windowed(logs, width, None, {n: f("value") for n, f in BASIC.items()})


def rolling_stats(logs: DataFrame, width: str, slide: str) -> DataFrame:
    """As rollup, with p50, p95 and p99: the least values that so many percent of the window's values don't exceed. What a window holds of its values is a mergeable sketch of bounded size."""
    got = windowed(held_back(logs), width, slide, {n: f("value") for n, f in BASIC.items()} | {"sketch": F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(SKETCH))})
    percentile = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}")
    return got.select("since", "until", "process_type", *BASIC, *map(percentile, (50, 95, 99)))


def exact_percentiles(logs: DataFrame, width: str, slide: str) -> DataFrame:
    """logs: a table. The least values that 50, 95 and 99 percent of a window's values don't exceed, exactly: equal values are counted first, then running sums over the sorted ones (which spill) hold each rank."""
    key = ["w", "process_type"]
    counted = logs.where("value IS NOT NULL").groupBy(F.window("created_at", width, slide).alias("w"), "process_type", "value").agg(F.count(F.lit(1)).alias("many"))
    totals = counted.groupBy(*key).agg(F.sum("many").alias("n"))
    upto = F.sum("many").over(Window.partitionBy(*key).orderBy("value"))
    ranked = counted.join(totals.hint("merge"), key).withColumn("upto", upto)
    percentile = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.lit(p / 100) * F.col("n")), F.col("value"))).alias(f"p{p}")
    return ranked.groupBy(*key).agg(*map(percentile, (50, 95, 99))).select(F.col("w.start").alias("since"), "process_type", "p50", "p95", "p99")


def counted_once(logs: DataFrame) -> DataFrame:
    """Each event once, however often it arrives; events older than the retention are dropped row by row, so progress counts them."""
    return held_back(logs).dropDuplicatesWithinWatermark(["event_id"]) if logs.isStreaming else logs.dropDuplicates(["event_id"])


def late_counts(logs: DataFrame, width: str) -> DataFrame:
    """Events of each process in windows, late ones counted as long as the watermark lets them in."""
    return windowed(counted_once(logs), width, None, {"n": F.count(F.lit(1))})


def intake(messages: DataFrame) -> DataFrame:
    """Unread messages, each once, with where they go: processed or other. A stream remembers messages for the retention after they arrived, so its state stays bounded."""
    key = ["message_id", "turn"]
    if messages.isStreaming:
        once = messages.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", RETENTION).dropDuplicatesWithinWatermark(key).drop("_arrived")
    else:
        once = messages.dropDuplicates(key)
    return screened(once).withColumn("route", F.when(F.col("accepted"), "processed").otherwise("other"))


class Intake:
    """The standing intake: two sinks and the counters of each batch, below one folder. A batch's parts lie in folders of its number, which a batch that is run again replaces, so each message is there once whatever fails."""

    SINKS = ("processed", "other")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def sink(self, batch: DataFrame, n: int, name: str) -> None:
        batch.where(F.col("route") == name).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={n}")

    def count(self, batch: DataFrame, n: int) -> None:
        """Counters of this batch, and their sums up to it from those of the batches before (a row each)."""
        own = batch.agg(F.count(F.lit(1)).alias("last_processed"), F.count_if(F.col("route") == "processed").alias("last_ok"), F.count_if(F.col("route") == "other").alias("last_errors"))
        own.write.mode("overwrite").parquet(f"{self.folder}/counters/batch={n}")

    def route(self, batch: DataFrame, n: int) -> None:
        held = batch.persist()
        for name in self.SINKS:
            self.sink(held, n, name)
        self.count(held, n)
        held.unpersist()

    def start(self, messages: DataFrame, each: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Polls every 300 seconds, unless another trigger is given; `each` is called for every batch (route, unless given)."""
        stream = intake(messages).writeStream.foreachBatch(each or self.route).option("checkpointLocation", f"{self.folder}/checkpoint")
        return stream.trigger(**(trigger or {"processingTime": "300 seconds"})).start()

    def messages(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def counters(self) -> DataFrame:
        """A row a batch that had messages, numbered in order: last and cumulative processed, ok and errors."""
        names = ("processed", "ok", "errors")
        own = self.spark.read.schema(", ".join(["batch int", *(f"last_{c} long" for c in names)])).parquet(f"{self.folder}/counters").where("last_processed > 0")
        totals = ", ".join(f"sum(last_{c}) OVER (ORDER BY batch) AS total_{c}" for c in names)  # a row a batch
        return own.selectExpr("CAST(row_number() OVER (ORDER BY batch) AS int) AS poll", *(f"last_{c}" for c in names), *totals.split(", "))
