"""State of streams stays bounded, and what they give equals their batch twins."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path
from tidemark.streaming import streams

START = datetime.datetime(2024, 3, 1)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_is_bounded_over_100_batches(spark, one_partition, tmp_path):
    rows = [(n, f"p{n % 3}", float((n * 37) % 101), START + datetime.timedelta(minutes=18 * n)) for n in range(2000)]  # 25 days
    schema = "event_id long, process_type string, value double, created_at timestamp"
    columns = ("event_id", "process_type", "value", "created_at")
    for k in range(100):  # a file for every six hours
        own = {c: [r[n] for r in rows[20 * k : 20 * k + 20]] for n, c in enumerate(columns)}
        file = tmp_path / f"{k}.parquet"
        pq.write_table(pa.table(own | {"created_at": pa.array(own["created_at"], pa.timestamp("us", "UTC"))}), file)
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = streams.rolling_stats(stream, "6 hours", "3 hours").writeStream.format("memory").queryName("hundred").trigger(**streams.NOW).start()
    query.awaitTermination()
    reports = query.recentProgress
    assert max(r.batchId for r in reports) >= 99 and len(reports) >= 90
    held = [r.stateOperators[0].numRowsTotal for r in reports]
    assert max(held) <= 3 * (24 + 6 + 2 * 6) // 3  # three processes, the windows of the retention and of two batches
    assert max(held[:30]) == max(held[-20:])  # and no more at the end than at the beginning
    assert streams.dropped(reports) == 0
    twin = streams.rolling_stats(spark.createDataFrame(rows, schema), "6 hours", "3 hours").where(F.col("until") <= F.lit(max(r[3] for r in rows) - datetime.timedelta(hours=24)))
    assert sorted(spark.table("hundred").collect()) == sorted(twin.collect())


def test_sketches_of_many_values_are_near(spark):
    rows = spark.range(200_000).select(F.lit("p").alias("process_type"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("value"), F.lit(START).alias("created_at"))
    got, exact = streams.rolling_stats(rows, "6 hours", "6 hours").first(), rows.agg(F.percentile("value", [0.5, 0.95, 0.99])).first()[0]
    assert all(abs(a - b) < 0.005 * 1_000_003 for a, b in zip((got.p50, got.p95, got.p99), exact, strict=True))


def test_late_rows_are_counted_or_dropped(spark):
    at = lambda h: START + datetime.timedelta(hours=h)
    rows = [(1, "p", 1.0, at(1), 0), (2, "p", 1.0, at(40), 0), (3, "p", 1.0, at(2), 1), (4, "p", 1.0, at(30), 1), (2, "p", 1.0, at(40), 1), (5, "p", 1.0, at(90), 1), (None, "p", 1.0, None, 1)]
    df = spark.createDataFrame(rows, "event_id long, process_type string, value double, created_at timestamp, _n int")
    out, reports = streams.drained_in_batches(df.drop("_n"), F.when(F.col("event_id").isin(3, 4, 5), 1).otherwise(0), 2, lambda s: streams.late_counts(s, "12 hours"), "late-test")
    # event 3 comes when hour 16 has passed, event 4 does not; event 2 counts once
    assert sorted((r.since, r.n) for r in out.collect()) == [(at(0), 1), (at(24), 1), (at(36), 1)]
    assert streams.dropped(reports) == 1


def test_a_batch_that_is_run_again_replaces_itself(spark):
    mail = spark.createDataFrame([(n, 0, "a@broker.x", "facultative reinsurance" if n % 2 else "lunch", "slip.pdf") for n in range(10)], "message_id long, turn int, sender string, subject string, attachment string")
    work = streams.Intake(spark, new_path(spark, "intake-test"))
    seen = []

    def each(batch, n):
        if not seen:
            seen.append(n)
            work.sink(batch, n, "processed")
            raise RuntimeError("stopped")
        work.route(batch, n)

    def run(stream):
        query = work.start(stream, each, streams.NOW)
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            query = work.start(stream, each, streams.NOW)
        return query

    streams.fed(mail, F.col("message_id") % 2, 2, run, "intake-test-mail")
    schema = streams.intake(mail).schema
    got = sorted(r.message_id for name in work.SINKS for r in work.messages(name, schema).collect())
    assert seen and got == list(range(10))
    last = work.counters().orderBy("poll").collect()[-1]
    assert (last.total_processed, last.total_ok, last.total_errors) == (10, 5, 5)


def test_tables_of_one_file_or_of_parts_are_streamed(spark, tmp_path):
    for n in range(3):
        (tmp_path / "parts.parquet").mkdir(exist_ok=True)
        pq.write_table(pa.table({"x": [2 * n, 2 * n + 1]}), tmp_path / "parts.parquet" / f"part-{n}.parquet")
    pq.write_table(pa.table({"x": list(range(6))}), tmp_path / "one.parquet")
    pq.write_table(pa.table({"x": [9]}), tmp_path / "none.parquet")  # of another table
    for table in ("parts", "one"):
        got = streams.drained(streams.table_stream(spark, str(tmp_path), table), "table-stream")
        assert sorted(r.x for r in got.collect()) == list(range(6))


def test_a_whole_rollup_has_open_windows_and_late_rows(spark):
    at = lambda h: START + datetime.timedelta(hours=h)
    rows = [(1, "p", 1.0, at(1), 0), (2, "p", 3.0, at(90), 0), (3, "p", 5.0, at(1.5), 1), (4, "p", 1.0, at(91), 1)]
    df = spark.createDataFrame(rows, "event_id long, process_type string, value double, created_at timestamp, _n int")
    out, checkpoint = new_path(spark, "whole"), new_path(spark, "whole-state")
    streams.fed(df.drop("_n"), F.when(F.col("event_id") > 2, 1).otherwise(0), 2, lambda s: streams.written(streams.whole_rollup(s, "1 hour"), out, checkpoint, "complete"), "whole-test")
    assert sorted((r.since, r.n, r.mean) for r in spark.read.parquet(out).collect()) == [(at(1), 2, 3.0), (at(90), 1, 3.0), (at(91), 1, 1.0)]


def test_exact_percentiles_of_many_values(spark):
    rows = spark.range(30_000).select(F.lit("p").alias("process_type"), F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double").alias("value"), F.lit(START).alias("created_at"))
    held = sorted(r.value for r in rows.collect())
    got = streams.exact_percentiles(rows.unionByName(rows.limit(1).withColumn("value", F.lit(None).cast("double"))), "6 hours", "6 hours").first()
    assert [got.p50, got.p95, got.p99] == [held[15_000 - 1], held[28_500 - 1], held[29_700 - 1]]
