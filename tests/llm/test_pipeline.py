"""The pipeline against a plain version, stage by stage."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import WORD, base_text, brute_links, brute_secrets
from tidemark.llm import registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows = random.Random(8), []
    for i in range(60):
        text = base_text(80 + i, i) + (" password = hunter2hunter2" if i % 7 == 0 else "")
        rows.append((i, text, "en", r.choice(["a", "b", None]), len(text)))
    rows += [(100 + i, rows[i][1] + " tail", "en", "b", 1) for i in range(10)] + [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "### " * 80, "en", "a", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs, text = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    columns = docs.columns
    kept = [corpus_pipeline.STAGES[0][1](spark, docs, path)]
    first = {r.doc_id for r in kept[0].collect()}
    assert first == {i for i in text if i < 200}
    second = corpus_pipeline.STAGES[1][1](spark, kept[0], path)
    roots = brute_links([(i, text[i]) for i in first], corpus_pipeline.PERCENT)
    assert {r.doc_id for r in second.collect()} == {i for i in first if roots[i][1] == i}
    third = corpus_pipeline.STAGES[2][1](spark, second, path)
    for r in third.collect():
        assert brute_secrets(r.text) == "" and (r.text == text[r.doc_id] or brute_secrets(text[r.doc_id])) and r.n_chars == len(r.text)
    fourth = corpus_pipeline.STAGES[3][1](spark, third, path)
    assert second.columns == third.columns == fourth.columns == columns
    words = lambda df: sum(len(WORD.findall(r.text)) for r in df.collect())
    assert words(fourth) == pytest.approx(words(third), rel=0.1)
    tokenizers = pytest.importorskip("tokenizers")
    real = tokenizers.Tokenizer.from_file(registry.vocabulary_path())
    last = corpus_pipeline.run(spark, path)
    want = sorted((r.doc_id, real.encode(r.text, add_special_tokens=False).ids) for r in fourth.collect())
    assert sorted((r.doc_id, r.ids) for r in last.collect()) == want


def test_stages_keep_other_columns(spark, folder):
    path, rows = folder
    names = ["key", "times", "time", "target", "found", "blob", "kept", "failed_rule", "root", "t", "class", "row", "n_words"]
    docs = spark.createDataFrame(rows[:40], COLUMNS).selectExpr("*", *(f"'{c}' as {c}" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")] + names
    assert docs.select(*names).distinct().collect() == [tuple(names)]


def test_queries_have_their_columns(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    out = registry.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    both = out.where("held_out").join(labels, "doc_id").where(F.col("quality").isNotNull())
    right = both.where(F.col("quality") == F.col("predicted")).count()
    assert right >= 0.9 * both.count()
