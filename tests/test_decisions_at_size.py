"""Decisions at size: applications go to even tasks, factors are weighed once."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decision
from tidemark.plans import catalog
from tidemark.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def test_risk_parameters_of_one_row_group_go_to_even_tasks(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS o_orderkey", "id % 99 AS o_custkey", "'O' AS o_orderstatus", "cast(1000 + id AS decimal(15,2)) AS o_totalprice", "date'2024-01-01' AS o_orderdate", "sha2(cast(id AS string), 256) AS o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(99).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        tasks = Tables(spark, str(tmp_path)).risk_parameters.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert tasks[0] <= 20_000 / 8 and tasks[1] == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["k18_rationale", "w2_top_factors"])
def test_factors_are_weighed_once(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    sort = plan[plan.index("array_sort(") :].split("\n")[0]
    assert sort.count(".weight") == 1


def test_factors_of_one_weight_stay_in_their_order(spark):
    factor = lambda place, score, weight: {"place": place, "factor": f"f{place}", "score": score, "weight": weight, "confidence": 0.9, "rationale": f"r{place}"}
    items = [factor(0, 0.0, 0.5), factor(1, 40.0, 0.25), factor(2, 20.0, 0.5), factor(3, 90.0, 0.25), factor(4, 0.0, 0.25)]
    df = spark.createDataFrame([("a", "APPROVE", items)], "application_id string, decision string, factors array<struct<place:int,factor:string,score:double,weight:double,confidence:double,rationale:string>>")
    got = decision.explained(df).first()
    assert [f.factor for f in got.top] == ["f3", "f1", "f2"] and got.addressed == ["r1", "r2", "r0", "r4"]
