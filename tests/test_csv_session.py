"""CSV sources and sink, session settings, and the limits that must not be there."""

import os

import pytest
from pyspark.sql import functions as F

from tidecast import session as SE
from tidecast.operators import classifier as CL
from tidecast.operators import kv as KV
from tidecast.operators import ml as ML
from tidecast.operators import sentiment as SN
from tidecast.operators import text as X
from tidecast.plans import catalog
from tidecast.sources import csv as CSV
from tidecast.sources import tables as T
from tidecast.streaming import flow
from tidecast.streaming import triggers as TR

from conftest import SF_SMALL


def test_price_file_names_and_bad_rows(spark, tmp_dir):
    for name, body in (("aapl.us.daily.csv", "Date,Open,Close\n2024-01-02,1,2.5\nbad,1,2\n2024-01-03,1,\n"),
                       ("brk-b.csv", "Close,Date\n7.5,2024-01-02\n")):
        os.makedirs(os.path.join(tmp_dir, name[:3]))
        with open(os.path.join(tmp_dir, name[:3], name), "w") as f:
            f.write(body)
    a = CSV.read_prices(spark, os.path.join(tmp_dir, "aap")).collect()
    assert [(r.ticker, r.ts.day, r.price) for r in a] == [("AAPL", 2, 2.5)]
    b = CSV.read_prices(spark, os.path.join(tmp_dir, "brk")).collect()
    assert [(r.ticker, r.price) for r in b] == [("BRK-B", 7.5)]
    assert CSV.read_prices(spark, os.path.join(tmp_dir, "brk"), "x").first().ticker == "X"


def test_price_sink_window_default_name_and_empty(spark, tmp_dir):
    rows = spark.createDataFrame([("2013-12-31", 1.0), ("2014-01-02", 2.0), ("2023-12-31", 3.0), ("2024-01-02", 4.0)],
                                 "d string, price double").select(F.to_timestamp_ntz("d").alias("ts"), "price")
    path = os.path.join(tmp_dir, "h")
    assert CSV.write_price_history(rows, path, "2024-01-01 00:00:00")
    got = spark.read.option("header", True).csv(path).collect()
    # [a day before less ten years, a day before): the rows of 2013-12-31 and 2014-01-02
    assert sorted((r.Close, r.Ticker) for r in got) == [("1.0", "UNKNOWN"), ("2.0", "UNKNOWN")]
    none = os.path.join(tmp_dir, "none")
    assert CSV.write_price_history(rows, none, "1990-01-01 00:00:00", "t") is False
    assert not os.path.exists(none)
    with pytest.raises(ValueError):
        CSV.read_wide(spark, path)


def test_caller_settings_survive(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "12345", "spark.sql.adaptive.skewJoin.enabled": "false",
            "spark.sql.constraintPropagation.enabled": "true", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        SE.ensure_session_defaults(spark)
        assert {k: spark.conf.get(k) for k in keys} == keys
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_side_is_broadcast_by_its_measured_size(spark):
    df = catalog.REGISTRY["minmax_series"][0](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Initial Plan")[0]


def test_no_shared_folder_on_a_cluster_raises(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        SE.checkpoint_dir(Session())


def test_kafka_without_connector_raises(spark, tmp_dir):
    if flow.kafka_available(spark):
        pytest.skip("connector present")
    with pytest.raises(RuntimeError):
        flow.read_messages(spark, path=tmp_dir, kafka_servers="nowhere:9092")


def test_large_doc_ids_have_a_publication_time(spark):
    d = spark.createDataFrame([(60_000_000,), (1,)], "doc_id long")
    got = {r.doc_id: r.t for r in d.select("doc_id", T.published_at(F.col("doc_id")).alias("t")).collect()}
    assert got[1].minute == 43 and got[60_000_000].year == 6929


@pytest.mark.parametrize("value,ok", [
    ('{"a": 1}', True), ("[1, 2]", True), ("12", True), ('"x"', True), ("null", True), ('{"a": 1} xx', False),
    ("raw", False), ("", False), ("  ", False), ('1,"end_of_value":1}xx', False), ('{"a": 1', False), ("1,2", False),
    (None, False)])
def test_whole_value_has_to_be_json(spark, value, ok):
    d = spark.createDataFrame([(value,)], "v string")
    assert d.select(KV.is_json(F.col("v")).alias("j")).first().j is ok


def test_trailing_text_is_bad_json_in_messages(spark):
    d = spark.createDataFrame([("hourly_topic", '{"trigger_type": "hourly_prediction"} xx')], "topic string, value string")
    assert TR.parse_messages(d).first().status == "bad_json"


def test_pages_errors_and_character_references(spark):
    rows = [(1, None), (2, "<p>It&#8217;s &mdash; &#x41;&#65; &#0; &#99999999; &amp;#65; &#xD800;</p>")]
    got = {r.page_id: r for r in X.page_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1].status == "error" and got[1].text == X.NO_CONTENT
    assert got[2].text == "It’s — AA &#0; &#99999999; &#65; &#xD800;"


def test_sentence_numbers_have_no_gaps(spark):
    d = spark.createDataFrame([(1, "\n\nOne. Two!\n\n \nThree?")], "doc_id long, text string")
    assert [(r.idx, r.sentence) for r in CL.sentences(d).orderBy("idx").collect()] == [
        (1, "One."), (2, "Two!"), (3, "Three?")]


def lexicon_sum(spark, text, lexicon):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return SN.lexicon_scores(d, "text", lexicon).first()


@pytest.mark.parametrize("as_table", [False, True])
def test_overlapping_and_repeated_terms(spark, as_table):
    def lex(pairs):
        return spark.createDataFrame(pairs, "term string, cls string") if as_table else pairs

    r = lexicon_sum(spark, "a b c d", lex([("a b", "positive"), ("b c", "negative"), ("c d", "positive")]))
    assert r.score_sum == 2.0 and r.neu == 0.0
    assert lexicon_sum(spark, "x good", lex([("Good", "positive"), ("good", "positive")])).score_sum == 1.0
    r = lexicon_sum(spark, None, lex([("good", "positive")]))
    assert (r.n_tokens, r.score_sum, r.compound, r.neu) == (0, 0.0, 0.0, 0.0)


def test_lexicon_table_of_any_size(spark, tmp_dir):
    path = os.path.join(tmp_dir, "lex.csv")
    with open(path, "w") as f:
        f.writelines(f"w{k}x,positive\n" for k in range(250_000))
        f.write("not good,negative\n")
    lexicon = SN.load_lexicon(spark, path)
    assert lexicon.count() == 250_001
    assert lexicon_sum(spark, "it is not good", lexicon).score_sum == -1.0


def test_large_confidence_counts_as_bad(spark):
    d = spark.createDataFrame([(1, 1, "positive", "1e20"), (1, 2, "positive", "0.5")],
                              "doc_id long, idx int, label string, confidence string")
    r = SN.signed_confidence(d).first()
    assert (r.score, r.n_bad_confidence) == (0.5, 1)
    assert [(x.idx, x.label, x.confidence) for x in r.details] == [(1, "positive", "1e20"), (2, "positive", "0.5")]


def test_scaler_merges_complete_and_incomplete_rows(spark):
    rows = [(1.0, 10.0), (2.0, None), (4.0, 30.0), (None, 50.0), (9.0, 70.0)]
    fit = ML.standardize_fit(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    import statistics
    for c, values in (("a", [1.0, 2.0, 4.0, 9.0]), ("b", [10.0, 30.0, 50.0, 70.0])):
        assert fit[c] == pytest.approx((statistics.mean(values), statistics.stdev(values)))


def test_price_files_with_different_columns(spark, tmp_dir):
    put = lambda name, text: open(os.path.join(tmp_dir, name), "w").write(text)
    put("aa.us.csv", "Date,Close\n2024-01-02,1.5\n2024-01-03,2.5\n")
    put("bb.csv", "Date,Open,Close\n2024-01-02,9,3.5\n2024-01-03,9,\n")
    put("cc.csv", 'Volume,"Close","Date"\n7,4.5,2024-01-04 10:00:00\n')
    put("dd.csv", "Date,Close\n")
    got = sorted((r.ticker, str(r.ts), r.price) for r in CSV.read_prices(spark, tmp_dir).collect())
    assert got == [("AA", "2024-01-02 00:00:00", 1.5), ("AA", "2024-01-03 00:00:00", 2.5), ("BB", "2024-01-02 00:00:00", 3.5),
                   ("CC", "2024-01-04 10:00:00", 4.5)]
    put("ee.csv", "Day,Close\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="no Date and Close"):
        CSV.read_prices(spark, tmp_dir)


def test_price_sink_keeps_all_columns_under_its_default_name(spark, tmp_dir):
    rows = spark.createDataFrame([("2020-01-01", 1.0, 5, "zz")], "d string, price double, Volume int, ticker string").select(
        F.to_timestamp_ntz("d").alias("ts"), "price", "Volume", "ticker")
    path = CSV.write_price_history(rows, None, "2024-01-01 00:00:00", "aapl", tmp_dir)
    assert path == os.path.join(tmp_dir, "AAPL_10_years_data.csv")
    got = spark.read.option("header", True).csv(path)
    assert got.columns == ["Date", "Close", "Volume", "Ticker"] and got.first().Ticker == "AAPL" and got.first().Volume == "5"
