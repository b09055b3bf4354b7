"""The two pipelines as table jobs over every ticker, run and article at once.

* ``daily_train``  - sequence windows -> forecaster; feature rows -> standardise -> split ->
  sentiment-aware regressor; both evaluated on the hash-split test set and optionally registered.
* ``hourly_predict`` - for every (ticker, run): the 60 bars before the run, a window-scaled forecast,
  news of the hour a day earlier scored by the lexicon, the 64-value feature row, the second model,
  the blended prediction, the result key and JSON payload, upserted into the keyed store.

Every step is a join, aggregation or window on bounded keys; the driver sees fitted parameters only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as FE
from ..operators import kv as KV
from ..operators import ml as ML
from ..operators import sentiment as SN
from ..operators import text as X
from ..operators import windows as W
from ..operators.bars import resample, scale_expr, unscale_expr
from ..operators.joins import asof_latest, interval_join
from ..operators.kvstore import KeyedStore
from ..session import written
from ..sources import csv as CSV
from ..sources import tables as T
from ..streaming import triggers as TR

SEQ = FE.SEQ_LEN
VERSIONS_KEPT = 3
AUX = ("algo", "lex_score", "ml_score", "llm_score")


@dataclass
class Models:
    forecaster: object
    senti: object
    scaler: dict


def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return resample(T.ticks(spark, sf), "hour")


def news_scores(spark: SparkSession, sf: str, runs: DataFrame, dim: DataFrame,
                per_run: int = 1, lexicon=SN.DEFAULT_LEXICON, lang: str | None = "en",
                keyword: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(ticker, run_ts) -> mean lexicon compound of the first ``per_run`` articles of the ticker's company
    published in [run - 25h, run - 24h), in order of relevance to ``keyword`` if one is given, then newest
    first, and how many they are (``n_articles``); runs without news get no row.

    With ``pages`` (doc_id, text, status; as ``text.page_text`` makes them) an article's page text is scored, and
    articles whose page is missing, was not fetched or holds no text are left out.

    Each article is scored once, where it lies; only ids, times and scores are joined.
    """
    r = FE.with_company(runs.select("ticker", "run_ts"), dim).where(F.col("company").isNotNull())
    arts = T.articles(spark, sf)
    if lang:
        arts = arts.where(F.col("lang") == lang)
    hits = X.relevance(F.col("text"), f"{keyword} stock") if keyword else F.lit(0)
    body = F.concat("title", "text") if pages is None else F.lit(None).cast("string")
    arts = arts.select("company", "doc_id", "published_at", hits.alias("hits"), body.alias("body"))
    if keyword:
        arts = arts.where("hits > 0")
    facts = ("company", "published_at", "hits")
    if pages is None:
        scored = SN.lexicon_scores(arts, "body", lexicon, keep=("doc_id", *facts)).select("doc_id", *facts, "compound")
    else:
        scored = SN.lexicon_scores(pages.where("status = 'ok'"), "text", lexicon).select("doc_id", "compound").join(
            arts.drop("body"), "doc_id")
    j = interval_join(r, scored, "run_ts", "published_at", 25, 24, keys=["company"])
    w = Window.partitionBy("ticker", "run_ts").orderBy(
        F.col("hits").desc(), F.col("published_at").desc(), F.col("doc_id").desc())
    top = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_run)
    return top.groupBy("ticker", "run_ts").agg(F.avg("compound").alias("lex_score"), F.count("*").alias("n_articles"))


def run_windows(bars: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run with the 60 closes ending at the latest bar strictly before it (and their range); a run
    without so many has a NULL window."""
    at = asof_latest(runs, bars.select("ticker", "bar_ts"), "ticker", "run_ts", "bar_ts", [])
    win = W.window_sequences(bars).select("ticker", "bar_ts", "seq", "mn", "mx")
    return at.join(win, ["ticker", "bar_ts"], "left")


def forecast(model, rows: DataFrame) -> DataFrame:
    """Window-scaled forecast of the next close, mapped back to price (``algo``)."""
    # Filters may be merged and reordered around the model's predict function, so its input is
    # made full width on every row (short rows, dropped later, get zeros) instead of relying on
    # an earlier size filter having run first.
    full = F.coalesce(F.size("seq") == SEQ, F.lit(False))
    vals = F.transform("seq", lambda x: scale_expr(x, F.col("mn"), F.col("mx")))
    scaled = rows.withColumn("features", array_to_vector(
        F.when(full, vals).otherwise(F.array_repeat(F.lit(0.0), SEQ))))
    p = model.transform(scaled).drop("features")
    return p.withColumn("algo", unscale_expr(F.col("prediction"), F.col("mn"), F.col("mx"))).drop(
        "prediction")


def feature_rows(rows: DataFrame, scores: DataFrame | None) -> DataFrame:
    """64-value rows: 60 closes + [algo, lexicon, classifier (0, as in the pipeline), reply score].

    A run without news scores 0 for the lexicon; the reply score is NULL unless a ``reply`` column is
    present, and a NULL is replaced by 0 with ``llm_missing`` set instead of spoiling the row.
    """
    r = rows if scores is None else rows.join(scores.select("ticker", "run_ts", "lex_score"), ["ticker", "run_ts"], "left")
    if "lex_score" not in r.columns:
        r = r.withColumn("lex_score", F.lit(None).cast("double"))
    reply = S.parse_score(F.col("reply")) if "reply" in r.columns else F.lit(None).cast("double")
    r = (r.withColumn("lex_score", F.coalesce("lex_score", F.lit(0.0)))
         .withColumn("ml_score", F.lit(0.0))
         .withColumn("llm_missing", reply.isNull())
         .withColumn("llm_score", F.coalesce(reply, F.lit(0.0))))
    return FE.check_rows(r.withColumn("features", FE.assemble_row(
        F.col("seq"), *[F.col(c) for c in AUX])), "features")


def to_wide(rows: DataFrame, keep=("ticker", "run_ts"), target: str | None = "target") -> DataFrame:
    cols = [F.element_at("features", i + 1).alias(f"v{i + 1}") for i in range(FE.ROW_WIDTH)]
    extra = [F.col(target).alias(f"v{FE.ROW_WIDTH + 1}")] if target else []
    return rows.select(*keep, *cols, *extra)


TARGET = f"v{FE.ROW_WIDTH + 1}"
FEATS = [f"v{i}" for i in range(1, FE.ROW_WIDTH + 1)]


def history_rows(spark: SparkSession, sf: str, dim: DataFrame, forecaster) -> DataFrame:
    """Wide training rows: every bar is a run at its own start, its close the target (v65)."""
    bars = hourly_bars(spark, sf)
    hist = bars.select("ticker", F.col("bar_ts").alias("run_ts"), F.col("close").alias("target"))
    rows = feature_rows(forecast(forecaster, written(run_windows(bars, hist), "history-windows")),
                        written(news_scores(spark, sf, hist, dim), "history-scores"))
    # the check's result is read from a table: filtering on its long expression would be inferred through
    # every column built on it
    return to_wide(written(rows.select("ticker", "run_ts", "target", "features", "valid"), "history-rows").where("valid"))


def fit_senti(wide: DataFrame, kind: str = "linear", fit_on_all: bool = False):
    """(model, scaler, metrics) of the second model. All 65 columns are standardised, the target too, so
    the output is a small signed number of standard deviations that the blend adds a tenth of."""
    train = ~F.col("is_test")
    scaler = ML.standardize_fit(wide if fit_on_all else wide.where(train), [*FEATS, TARGET])
    mean, std = scaler[TARGET]
    z = written(ML.scaled_vector(wide, scaler, FEATS).select("features", "is_test", (
        (F.col(TARGET) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)).alias("label")), "train-vectors")
    model = ML.fit(z.where(train), kind)
    return model, scaler, ML.evaluate(model.transform(z.where(F.col("is_test"))))


def daily_train(spark: SparkSession, sf: str, dim: DataFrame, kind: str = "linear",
                register: bool | str = False, fit_on_all: bool = False, wide: DataFrame | None = None,
                rows_path: str | None = None, wide_csv: str | None = None):
    """Fit both models; returns (Models, metrics DataFrame). ``fit_on_all`` scales with statistics
    of all rows (the pipeline's behaviour) instead of the training rows only. ``wide`` replaces the rows
    of the second model, e.g. a wide CSV file cast to numbers. ``register`` saves both models, with
    metrics and scaler, in the registry (a string names its folder). ``rows_path`` keeps the second model's rows.
    ``wide_csv`` is such a file (or a folder of them): its cells are cast, rows with a bad or empty cell go."""
    if wide_csv:
        wide = ML.drop_incomplete(ML.wide_cast(CSV.read_wide(spark, wide_csv), keep=()))
        wide = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    bars = hourly_bars(spark, sf)
    sw = W.sequence_windows(bars)
    sw = sw.withColumn("features", array_to_vector("seq"))  # one model for all tickers, on scaled series
    test = ML.is_test(F.concat_ws("|", "ticker", F.col("bar_ts").cast("string")))
    # the training tables feed several jobs (fits, scaler, evaluation): write them once to the shared
    # folder so each job reads a plain scan instead of recomputing the lineage
    sw = written(sw.withColumn("is_test", test), "train-windows")
    forecaster = ML.fit(sw.where(~F.col("is_test")), kind)
    m1 = ML.evaluate(forecaster.transform(sw.where(F.col("is_test"))))
    if wide is None:
        wide = history_rows(spark, sf, dim, forecaster).withColumn("is_test", ML.is_test(
            F.concat_ws("|", "ticker", F.col("run_ts").cast("string"))))
    elif "is_test" not in wide.columns:
        wide = wide.withColumn("is_test", ML.is_test(F.concat_ws("|", *wide.columns)))
    if rows_path:
        wide.write.parquet(rows_path)
        wide = spark.read.schema(wide.schema).parquet(rows_path)
    else:
        wide = written(wide, "train-rows")
    senti, scaler, m2 = fit_senti(wide, kind, fit_on_all)
    metrics = (m1.withColumn("model", F.lit("forecaster"))
               .unionByName(m2.withColumn("model", F.lit("senti"))))
    models = Models(forecaster, senti, scaler)
    if register:
        save_models(spark, models, metrics, None if register is True else register)
    return models, metrics


def save_models(spark: SparkSession, models: Models, metrics: DataFrame, root: str | None = None) -> None:
    from ..operators import registry

    told = {(r["model"], r["metric"]): r["value"] for r in metrics.collect()}  # eight numbers
    of = lambda name: {m: v for (n, m), v in told.items() if n == name and v is not None}
    scale = {}
    for c, (mean, std) in models.scaler.items():
        scale |= {f"mean:{c}": mean or 0.0, f"std:{c}": std or 0.0}
    registry.save(spark, models.forecaster, "forecaster", of("forecaster"), root)
    registry.save(spark, models.senti, "senti", of("senti") | scale, root)


def load_models(spark: SparkSession, loader, root: str | None = None) -> Models:
    """The newest registered models and their scaler; ``loader`` is the models' class."""
    from ..operators import registry

    told = registry.latest(spark, "senti", root)["metrics"]
    scaler = {k[5:]: (v, told[f"std:{k[5:]}"]) for k, v in told.items() if k.startswith("mean:")}
    return Models(registry.load(spark, "forecaster", loader, root),
                  registry.load(spark, "senti", loader, root), scaler)


def hourly_predict(spark: SparkSession, sf: str, models: Models, dim: DataFrame,
                   runs: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Blended predictions and store writes, one row for every run (default: every hourly slot of every
    date with bars). A run that cannot be scored keeps its row: ``status`` says why, predictions are NULL.
    """
    bars = hourly_bars(spark, sf)
    runs = FE.runs_for(bars) if runs is None else runs
    rows = forecast(models.forecaster, written(run_windows(bars, runs), "run-windows"))
    if scores is None:
        scores = news_scores(spark, sf, runs, dim)
    rows = written(feature_rows(rows, scores).select(
        "ticker", "run_ts", "slot", "algo", "llm_missing", "features", "valid", "reason"), "run-rows")
    rejected = rows.where(~F.col("valid")).select("ticker", "run_ts", "slot", "llm_missing", F.when(
        F.size("features").isNull() | (F.col("reason") == "wrong_length"), "short_window").otherwise(
            F.col("reason")).alias("status"))
    wide = to_wide(rows.where("valid"), keep=("ticker", "run_ts", "slot", "algo", "llm_missing"), target=None)
    z = ML.scaled_vector(wide, models.scaler, FEATS).drop(*FEATS)
    pred = models.senti.transform(z).withColumnRenamed("prediction", "senti_out")
    payload = S.payload_struct(F.col("ticker"), F.col("slot"), F.col("algo"), F.col("senti_out"))
    done = pred.select(
        "ticker", "run_ts", "slot", "algo", "senti_out", "llm_missing",
        S.blend(F.col("algo"), F.col("senti_out")).alias("predicted"),
        S.result_key(F.col("run_ts"), F.col("slot"), F.col("ticker")).alias("key"),
        F.to_json(payload).alias("value"), F.lit("ok").alias("status"))
    return done.unionByName(rejected, allowMissingColumns=True)


def runs_of_messages(messages: DataFrame, bars: DataFrame) -> DataFrame:
    """The runs that parsed hourly messages ask for: their slot's time, for every ticker with bars."""
    at = TR.slot_time(F.col("value"))
    utc = messages.select(F.col("slot_friendly").alias("slot"), F.to_timestamp_ntz(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("run_ts")).where("run_ts is not null").distinct()
    # a message is for every ticker; a batch has few distinct slots, so they travel as one literal array
    slots = F.array(*[F.struct(F.lit(r["slot"]).alias("slot"), F.lit(r["at"]).alias("run_ts"))
                      for r in utc.select("slot", F.col("run_ts").cast("string").alias("at")).collect()]).cast("array<struct<slot:string,run_ts:timestamp_ntz>>")
    runs = bars.select("ticker").distinct().select("ticker", F.explode(slots).alias("_s")).select("ticker", "_s.*")
    return runs.select("ticker", F.to_date(S.ny_local(F.col("run_ts"))).alias("ny_date"), "slot", "run_ts")


def handlers(spark: SparkSession, sf: str, dim: DataFrame, models, store: str, registry_root: str | None = None,
             wide_csv: str | None = None):
    """Topic -> function of (parsed messages, call number): hourly messages predict and store their runs,
    daily ones train and register, on the rows of ``wide_csv`` if it is given. ``models`` is a function that gives the
    current models."""
    def hourly(messages: DataFrame, batch_id: int) -> None:
        if messages.isEmpty():
            return
        runs = runs_of_messages(messages, hourly_bars(spark, sf))
        upsert_version(spark, store, results_as_writes(hourly_predict(spark, sf, models(), dim, runs)), batch_id)

    def daily(messages: DataFrame, batch_id: int) -> None:
        if not messages.isEmpty():
            daily_train(spark, sf, dim, register=registry_root or True, wide_csv=wide_csv)

    return {TR.TOPICS[TR.HOURLY]: hourly, TR.TOPICS[TR.DAILY]: daily}


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest (or a given) version of a stored table; an empty one if there is none."""
    return KeyedStore(spark, path).read(version=version).select(*KV.WRITE_COLS)


def upsert_version(spark: SparkSession, path: str, writes: DataFrame, batch_id: int) -> None:
    """Apply a batch of writes to the store, once for each batch id (the micro-batch's, so it must grow), and
    delete the files that the newest versions do not read."""
    store = KeyedStore(spark, path)
    store.commit(writes, batch_id)
    store.vacuum(keep=VERSIONS_KEPT)


def results_as_writes(predictions: DataFrame) -> DataFrame:
    """Store writes of the scored runs."""
    return predictions.where("status = 'ok'").select(
        "key", "value", F.col("run_ts").alias("written_at"), F.xxhash64("key", "run_ts").alias("seq"),
        F.lit(None).cast("bigint").alias("ttl_seconds"))


def store_results(store: DataFrame | None, predictions: DataFrame) -> DataFrame:
    """Upsert the run results into the keyed store (latest write per key wins)."""
    writes = results_as_writes(predictions)
    if store is None:
        return KV.latest_per_key(writes, "key", "written_at", "seq")
    return KV.upsert(store, writes)
