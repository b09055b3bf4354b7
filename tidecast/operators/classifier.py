"""Sentence sentiment classifier: hashed term frequencies, IDF and logistic regression on Spark ML.

Trained on sentences of labelled documents (quality 1 -> positive, 0 -> negative); each sentence of
any document is then given a label and a confidence (the winning class probability, as text, the way
annotators report it), which ``sentiment.signed_confidence`` turns into a document score.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import tokens

SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n+"
NUM_FEATURES = 1 << 18


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per non-blank sentence: key, idx (1-based), sentence, toks, and the columns ``keep`` of its document."""
    full = F.filter(F.split(F.col(text), SENTENCE_SPLIT), lambda x: F.trim(x) != "")
    s = docs.select(key, *keep, F.posexplode(full).alias("pos", "sentence"))
    return s.select(key, (F.col("pos") + 1).alias("idx"), "sentence",
                    tokens(F.col("sentence")).alias("toks"), *keep)


def training_sentences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Sentences with the label of their document, which is joined to whole texts: sentences are not sorted or moved."""
    lab = labels.select("doc_id", F.col("quality").cast("double").alias("label"))
    return sentences(docs.select("doc_id", "text").join(lab, "doc_id"), keep=("label",))


def fit(docs: DataFrame, labels: DataFrame) -> PipelineModel:
    """The texts are split, hashed and joined once: the passes of IDF and of the regression read the written counts."""
    hashing = HashingTF(inputCol="toks", outputCol="tf", numFeatures=NUM_FEATURES)
    tf = written(hashing.transform(training_sentences(docs, labels)).select("label", "tf"), "sentence-counts")
    idf = IDF(inputCol="tf", outputCol="features", minDocFreq=2).fit(tf)
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=30, regParam=0.01).fit(idf.transform(tf))
    return PipelineModel([hashing, idf, lr])


def _margin(lr, features: DataFrame) -> tuple[DataFrame, Column]:
    """The margin of a two-class model from dense weights, in work that goes with a sentence's own words.

    A fitted model keeps its coefficients sparse, and its own ``transform`` walks over all of them for every row.
    """
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(lr.coefficients.toArray()), inputCol="features", outputCol="weighted")
    total = F.aggregate(F.unwrap_udt("weighted")["values"], F.lit(0.0), lambda acc, x: acc + x)
    return weigh.transform(features), total + F.lit(float(lr.intercept))


def annotate(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """key, idx, label (positive/negative), confidence (text) for every sentence of ``docs``."""
    hashing, idf, lr = model.stages
    p = idf.transform(hashing.transform(sentences(docs)))
    if lr.numClasses > 2:
        p = lr.transform(p)
        positive, prob = F.col("prediction") == 1.0, F.array_max(vector_to_array(F.col("probability")))
    else:
        p, margin = _margin(lr, p)
        p = p.select("doc_id", "idx", margin.alias("margin"))
        positive, prob = F.col("margin") > 0, 1 / (1 + F.exp(-F.abs("margin")))
    return p.select("doc_id", "idx", F.when(positive, "positive").otherwise("negative").alias("label"),
                    F.format_string("%.6f", prob).alias("confidence"))
