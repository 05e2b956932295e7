"""Slips at size: even tasks, no text sent, each pattern searched in one pass."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import hits
from tidemark.operators import extract
from tidemark.plans import catalog
from tidemark.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
TEXTS = ["a survey\nsurvey b", "x\r\n y SURVEYOR z\r\nb", "resurvey\n\nsurvey", "\nsurveys", "a b " * 24 + "x y", "a b " * 25 + "x", " " + "a b " * 25, "", "Ref -", "ref: -- policy 7, Share 40%quota 3", "USD 1,2,.5EUR3 KES 4.x", "cedant: 1 reinsured a.b", "limit USD $ 1,000.00 from 1/2/24"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def here():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")


def test_quick_patterns_find_the_same(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    c = F.col("text")
    same = [F.regexp_extract(c, extract.PATTERNS["survey"], 1).eqNullSafe(F.regexp_extract(c, extract.quick("survey"), 1)), F.regexp_extract_all(c, F.lit(extract.PATTERNS["amount"]), F.lit(0)).eqNullSafe(F.regexp_extract_all(c, F.lit(extract.quick("amount")), F.lit(0)))]
    for p in extract.SLIP_PATTERNS.values():
        n = F.regexp_count(c, F.lit(p))
        same += [n == F.regexp_count(c, F.lit(extract.led(p))), (n > 0) == c.rlike(extract.led(p))]
    same.append(c.rlike(extract.MORE_WORDS) == (F.size(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) > 50))
    assert df.where(~F.array_min(F.array(*(s.cast("int") for s in same))).cast("boolean")).collect() == []


def test_hits_are_what_the_text_contains(spark):
    rng = random.Random(3)
    for words in (extract.PRIMARY, extract.SECONDARY, extract.PERIL_WORDS, ["alone"]):
        texts = [" ".join(rng.choices(words + "slip excess of cover limit the".split(), k=rng.randrange(8))) for _ in range(200)]
        got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", hits(F.col("text"), words)).collect()
        assert {i: h for i, h in got} == {i: [k for k in words if k in t] for i, t in enumerate(texts)}


def test_survey_takes_time_by_length_not_its_square(spark):
    long = "a word " * 60_000
    df = spark.createDataFrame([(1, long), (2, long + "\nsee survey_a.pdf")], "doc_id long, text string")
    start = time.time()
    assert [(r.survey, r.survey_file) for r in extract.survey(df).orderBy("doc_id").collect()] == [(None, None), ("see survey_a.pdf", "survey_a.pdf")]
    assert time.time() - start < 30


def test_slips_of_one_row_group_go_to_even_tasks(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS o_orderkey", "id % 99 AS o_custkey", "'O' AS o_orderstatus", "cast(1000 + id AS decimal(15,2)) AS o_totalprice", "date'2024-01-01' AS o_orderdate", "sha2(cast(id AS string), 256) AS o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        t = Tables(spark, str(tmp_path))
        assert t.orders.rdd.getNumPartitions() >= 8
        assert t.slips.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 20_000 / 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mail_extraction_sends_fields_not_texts(spark, here):
    lines = optimized(catalog.QUERIES["x32_mail_extraction"](spark, SF)).split("\n")
    lowest = max(n for n, line in enumerate(lines) if "Window [" in line)
    assert "Project [" in lines[lowest + 1] and not re.search(r"\btext#\d+(?! AS)", lines[lowest + 1])


@pytest.mark.parametrize("name", ["x26_slip_confidence", "x28_slip_quality", "x29_slip_priority", "w1_processing_plan", "x31_plan_summary"])
def test_matches_are_counted_only_where_asked(spark, here, name):
    assert "regexp_extract_all" not in optimized(catalog.QUERIES[name](spark, SF))


def test_percentage_is_looked_for_once_a_slip(spark, here):
    plan = optimized(catalog.QUERIES["x4_money"](spark, SF))
    assert plan.index("([0-9]+(?:\\.[0-9]+)?)%") > plan.index("Generate posexplode")
