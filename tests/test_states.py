"""Mergeable states against whole recomputation, and sliding extremes against plain windows."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidecast.operators import bars as B
from tidecast.operators import states as ST
from tidecast.operators import windows as W

TICK = "ticker STRING, ts TIMESTAMP_NTZ, price DOUBLE, seq LONG"


def ticks(n=600, seed=2):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "a", "b", None]), t0 + timedelta(seconds=rng.randrange(3 * 86400) // 30 * 30),
             rng.choice([None, 1e9 + rng.random(), rng.uniform(-5, 5)]) if rng.random() < 0.2 else rng.uniform(10, 20), i) for i in range(n)]
    return rows


def test_rolled_up_states_match_the_ticks(spark, tmp_dir):
    rows = ticks()
    store = ST.BarStore(spark, os.path.join(tmp_dir, "s"))
    for k in range(3):  # batches in no order of time
        store.add(spark.createDataFrame(rows[k::3], TICK), k)
    store.add(spark.createDataFrame(rows[1::3], TICK), 1)  # a replay
    for unit, states in store.states("hour", "day").items():
        got = {(r.ticker, r.bar_ts): r for r in ST.bars_of(states).collect()}
        whole = B.resample(spark.createDataFrame(rows, TICK).where("price is not null"), unit)
        want = {(r.ticker, r.bar_ts): r for r in whole.collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            g = got[k]
            assert (g.open, g.high, g.low, g.close, g.n_ticks) == (w.open, w.high, w.low, w.close, w.n_ticks)
            cut = {"hour": 13, "day": 10}[unit]
            xs = [p for t, ts, p, _ in rows if p is not None and t == k[0] and str(ts)[:cut] == str(k[1])[:cut]]
            mean = math.fsum(xs) / len(xs)
            assert g["mean"] == pytest.approx(mean, rel=1e-12)
            if len(xs) > 1:
                assert g["std"] == pytest.approx(math.sqrt(math.fsum((x - mean) ** 2 for x in xs) / (len(xs) - 1)), rel=1e-9)
            else:
                assert g["std"] is None


def test_moments_merge_in_steps(spark, monkeypatch):
    monkeypatch.setattr(ST, "FAN", 3)
    df = spark.range(1000).select((F.col("id") % 50).alias("part"), (F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * 1e-3 + 1e8).alias("x"))
    states = df.groupBy("g", "part").agg(*[c.alias(n) for n, c in ST.moments("x").items()])
    got = {r.g: r for r in ST.merge_moments(states, ["g"], "part").withColumn("std", ST.spread(F.col("n"), F.col("m2"))).collect()}
    for r in df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect():
        assert got[r.g]["n"] == r.n and got[r.g]["mean"] == pytest.approx(r.m, rel=1e-14) and got[r.g]["std"] == pytest.approx(r.s, rel=1e-6)


def test_empty_states(spark, tmp_dir):
    store = ST.BarStore(spark, os.path.join(tmp_dir, "s"))
    store.add(spark.createDataFrame([("a", datetime(2024, 1, 1), None, 1)], TICK), 0)
    assert store.states("hour")["hour"].count() == 0


@pytest.mark.parametrize("n,block", [(1, 50), (2, 7), (5, 5), (13, 50), (60, 64), (150, 40)])
def test_sliding_extremes_match_plain_windows(spark, n, block):
    rng = random.Random(n)
    t0 = datetime(2024, 1, 1)
    rows = [(t, t0 + timedelta(hours=h), rng.randrange(50) / 4) for t, m in (("a", 240), ("b", 61), ("c", n - 1), ("d", n)) for h in range(m)]
    df = spark.createDataFrame(rows, "ticker STRING, bar_ts TIMESTAMP_NTZ, close DOUBLE")
    out = W.sliding_extremes(df, n, block_rows=block)
    got = sorted((r.ticker, r.idx, r.close, r.mn, r.mx) for r in out.collect())
    want = []
    for t in "abcd":
        xs = [p for k, _, p in rows if k == t]
        want += [(t, i, xs[i], min(xs[i - n + 1:i + 1]), max(xs[i - n + 1:i + 1])) for i in range(n - 1, len(xs))]
    assert got == sorted(want)
    assert set(out.columns) == {"ticker", "bar_ts", "close", "idx", "mn", "mx"}
