"""The sentence classifier's work: texts joined and hashed once, scores from dense weights, the same as the model's own."""

import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidecast.operators import classifier as CL
from tidecast.session import checkpoint_dir

TEXTS = ["Good day. Very good words here!\nbad start", "bad bad words. Nothing good", None, "", "... !!! 12", "good words again", "bad day again. bad luck",
         "unseen tokens only"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, "a second text under the same id. good")], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (5, 1), (5, 1), (6, 0), (99, 0)], "doc_id LONG, quality INT")
    return docs, labels, CL.fit(docs, labels)


def test_training_sentences_keep_repeats_and_move_no_sentences(spark, tables):
    docs, labels, _ = tables
    got = sorted((r.doc_id, r.idx, r.sentence, r.label) for r in CL.training_sentences(docs, labels).collect())
    assert got == [(0, 1, "Good day.", 1.0), (0, 1, "a second text under the same id.", 1.0), (0, 2, "Very good words here!", 1.0),
                   (0, 2, "good", 1.0), (0, 3, "bad start", 1.0), (1, 1, "bad bad words.", 0.0), (1, 2, "Nothing good", 0.0),
                   (5, 1, "good words again", 1.0), (5, 1, "good words again", 1.0), (6, 1, "bad day again.", 0.0), (6, 2, "bad luck", 0.0)]
    plan = CL.training_sentences(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Generate") < plan.index("Join ")


def test_fit_reads_the_texts_once(spark, tables):
    docs, labels, _ = tables
    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    CL.fit(docs.where("text is not null").withColumn("text", counted("text")).select("doc_id", "text"), labels)
    assert seen.value <= docs.where("text is not null").count()
    new = set(os.listdir(checkpoint_dir(spark).removeprefix("file:"))) - before
    assert [d for d in new if d.startswith("sentence-counts-")]


def test_scores_are_those_of_the_model(spark, tables):
    docs, labels, model = tables
    own = model.transform(CL.sentences(docs)).select(
        "doc_id", "idx", F.when(F.col("prediction") == 1.0, "positive").otherwise("negative").alias("label"),
        F.array_max(vector_to_array(F.col("probability"))).alias("p"))
    want = sorted((r.doc_id, r.idx, r.label, round(r.p, 6)) for r in own.collect())
    got = sorted((r.doc_id, r.idx, r.label, float(r.confidence)) for r in CL.annotate(model, docs).collect())
    assert len(got) == 14 and [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    plan = CL.annotate(model, docs)._jdf.queryExecution().analyzed().toString()
    assert "rawPrediction" not in plan  # the model's own transform walks over all its coefficients for each row


@pytest.mark.parametrize("quality", [0, 1])
def test_one_label_only(spark, tables, quality):
    docs, labels, _ = tables
    model = CL.fit(docs, labels.withColumn("quality", F.lit(quality)))
    assert {(r.label, r.confidence) for r in CL.annotate(model, docs).collect()} == {(("negative", "positive")[quality], "1.000000")}


def test_three_labels_fall_back_to_the_model(spark, tables):
    docs, labels, _ = tables
    model = CL.fit(docs, labels.withColumn("quality", F.when(F.col("doc_id") == 6, 2).otherwise(F.col("quality"))))
    own = model.transform(CL.sentences(docs))
    assert CL.annotate(model, docs).where("label = 'positive'").count() == own.where("prediction = 1").count()
