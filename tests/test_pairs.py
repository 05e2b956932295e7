"""Pairs of documents: what a document alone decides isn't computed for each pair."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import markets
from tidemark.operators.similarity import cosine
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_similar_pairs_multiply_vectors_once_a_place(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    plan = catalog.QUERIES["m5_similar_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"zip_with\(", plan)) <= 2  # in the test of pairs, and in the column


def test_similarity_is_the_cosine_of_the_two(spark):
    vectors = {1: [1.0, 2.0, 3.0], 2: [1.0, 2.0, 2.5], 3: [-1.0, 0.5, 0.0], 4: [0.0, 0.0, 0.0], 5: None, 6: [1e-3, 2e-3, 3e-3]}
    docs = spark.createDataFrame([("a", i, "note", "plain", ["x"] if i < 5 else [], v) for i, v in vectors.items()], "application_id string, doc_id long, subject string, text string, entities array<string>, embedding array<double>")
    got = {(r.doc_id_1, r.doc_id_2): r.similarity for r in markets.relations(docs).collect()}
    side = lambda n: docs.select(F.col("doc_id").alias(f"d{n}"), F.col("embedding").alias(f"e{n}"))
    want = {(r.d1, r.d2): r.s for r in side(1).join(side(2), F.expr("d1 < d2")).select("d1", "d2", F.coalesce(cosine(F.col("e1"), F.col("e2")), F.lit(0.0)).alias("s")).collect()}
    assert got == {k: s for k, s in want.items() if k[1] < 5 or s > markets.SIMILAR}
    assert (1, 6) in got and (3, 6) not in got
