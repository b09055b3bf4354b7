"""Paragraph extraction fixtures and lexicon scoring with the shipped dictionary."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tidecast.sources import tables as T
from tidecast.operators import classifier as CL
from tidecast.operators import sentiment as SN
from tidecast.operators import text as X


def _page_text(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id LONG, html STRING")
    return X.page_text(df).collect()[0]


def test_paragraph_fixtures(spark):
    assert _page_text(spark, "<html><body><div>no paragraphs</div></body></html>").text == X.NO_CONTENT
    assert _page_text(spark, "<p>  </p><p></p>").status == "empty"
    r = _page_text(spark, '<script>var t="</p>";</script><p>One <b>two</b><p>Three &amp; &lt;four&gt;'
                          '</div><!-- <p>hidden</p> --><p>Five</p>')
    assert r.text == "One two Three & <four> Five"


@pytest.mark.parametrize("text,expected", [
    ("not good", -1.0),
    ("very bad", -2.0),
    ("lack of good", -1.0),
    ("good good", 2.0),
    ("barely nice", 0.5),
    ("i recommend others to avoid it", -1.0),
    ("", 0.0),
])
def test_shipped_lexicon_scores(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")
    r = SN.lexicon_scores(df).collect()[0]
    assert r.score_sum == expected
    assert r.compound == pytest.approx(expected / math.sqrt(expected * expected + 15))


def test_phrase_covers_its_tokens(spark):
    df = spark.createDataFrame([(1, "i recommend others to avoid it")], "doc_id LONG, text STRING")
    r = SN.lexicon_scores(df).collect()[0]
    # two free tokens (i, it) are neutral; the phrase counts once as negative (1 - (-1) = 2)
    assert (r.neg, r.neu, r.pos) == (0.5, 0.5, 0.0)


def test_signed_confidence_edge_cases(spark):
    rows = [(1, 1, "positive", "0.9"), (1, 2, "negative", "0.5"), (1, 3, "neutral", "0.7"),
            (2, 1, "positive", "n/a")]
    df = spark.createDataFrame(rows, "doc_id LONG, idx INT, label STRING, confidence STRING")
    r = {x.doc_id: x for x in SN.signed_confidence(df).collect()}
    assert r[1].score == pytest.approx(0.4) and r[1].n_unknown == 1 and r[1].n_sentences == 3
    assert r[2].score == 0.0


def test_zip_shortest_cuts(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(["a", "b", "c"], ["1", "2"])], "x ARRAY<STRING>, y ARRAY<STRING>")
    z = df.select(F.size(SN.zip_shortest(F.col("x"), F.col("y"))).alias("n")).collect()[0].n
    assert z == 2


def test_all_named_references_decode_like_the_standard_library(spark):
    import html
    from html.entities import html5
    cases = [f"a &{n} b" for n in html5 if n.endswith(";")]
    cases += ["&amp;lt;", "&amp;#65;", "&#65;&#x42;", "&nosuch; &lt &;", "&#0; &#xD800; &#1114112;", "&&amp;&", "plain", "R&D &Eacute;t&eacute;"]
    got = [r.t for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, c STRING").select(
        "i", X.decode_entities(F.col("c")).alias("t")).orderBy("i").collect()]
    n = len(cases) - 8
    assert got[:n] == [html.unescape(c) for c in cases[:n]] and n > 2000
    assert got[n:] == ["&lt;", "&#65;", "AB", "&nosuch; &lt &;", "&#0; &#xD800; &#1114112;", "&&&", "plain", "R&D Été"]


def test_sentence_classifier_on_held_out_documents(spark):
    docs = T.table(spark, SF_CHECK, "documents")
    labels = T.table(spark, SF_CHECK, "labels").where("quality is not null")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    model = CL.fit(docs, labels.where(~held))
    told = SN.signed_confidence(CL.annotate(model, docs.join(labels.where(held), "doc_id", "left_semi")))
    rows = told.join(labels, "doc_id").select((F.col("score") > 0).cast("int").alias("p"), "quality").collect()
    right = sum(r.p == r.quality for r in rows) / len(rows)
    most = max(sum(r.quality for r in rows), sum(1 - r.quality for r in rows)) / len(rows)
    print(f"held-out accuracy {right:.3f} of {len(rows)}, majority {most:.3f}")
    assert len(rows) > 50 and right > most
