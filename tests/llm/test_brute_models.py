"""Operators 1 and 10 against plain Python: FTRL coordinate by coordinate, mixtures by a fine grid."""

import math
import random

import numpy as np
import pytest

from tidecast.llm import langid, toxicity


def plain_ftrl(examples, size, epochs):
    """The published update rule, one coordinate at a time; the last coordinate is the bias."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    for _ in range(epochs):
        for at, label in examples:
            w = {}
            for i in at:
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
            own = -z[size] / ((beta + math.sqrt(n[size])) / alpha)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()) + toxicity.START_BIAS + own))))
            g = (p - label) * (toxicity.POSITIVE_WEIGHT if label else 1.0)
            for i, x in [*w.items(), (size, own)]:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - step * x
                n[i] += g * g
    return z, n


def test_ftrl_matches_the_rule_coordinate_by_coordinate():
    rng, size = random.Random(3), 60
    examples = [(np.array(sorted(rng.sample(range(size), rng.randint(0, 12))), np.int64), float(rng.random() < 0.3)) for _ in range(400)]
    examples += [(np.array([1, 2], np.int64), 1.0), (np.array([3], np.int64), 0.0)] * 40
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    toxicity.learn(examples, z, n, epochs=3)
    want_z, want_n = plain_ftrl(examples, size, 3)
    assert z == pytest.approx(want_z, rel=1e-9, abs=1e-9) and n == pytest.approx(want_n, rel=1e-9)
    weights = toxicity.weights_of(z[:-1], n[:-1])
    assert weights[1] > 0 and (weights == 0).any() and (weights != 0).any()  # learned, and sparse by L1


def test_features_are_words_pairs_and_skip_pairs():
    """A text's features are those of its windows of three words, and no others; case and marks do not matter."""
    words = "You ARE such an idiot, really such an idiot été 2nd".split()
    text_of, bucket = toxicity.features([" ".join(words).encode()])
    windows = [" ".join(words[i:i + 3]).encode() for i in range(len(words) - 2)]
    _, each = toxicity.features(windows)
    assert set(bucket.tolist()) == set(each.tolist()) and not text_of.any()
    low = [w.lower().strip(",") for w in words]
    kinds = {(w,) for w in low} | set(zip(low, low[1:])) | {("skip", *p) for p in zip(low, low[2:])}
    assert len(bucket) == len(kinds)
    assert toxicity.features([" ".join(low).encode()])[1].tolist() == bucket.tolist()
    assert len(toxicity.features([b"", b" ,. "])[1]) == 0


def test_two_language_mixtures_match_a_grid_search(monkeypatch):
    monkeypatch.setattr(langid, "EM_STEPS", 400)  # the climb run out
    rng = np.random.default_rng(2)
    size, texts = 40, 25
    logs = np.log(rng.dirichlet(np.full(size, 0.4), 2).T + 1e-6)
    logs -= np.log(np.exp(logs).sum(axis=0))
    counts, rows, of = [], [], []
    for t in range(texts):
        share = rng.random() if t % 3 else float(t % 2)
        p = share * np.exp(logs[:, 0]) + (1 - share) * np.exp(logs[:, 1])
        c = rng.multinomial(rng.integers(30, 600), p / p.sum())
        seen = np.flatnonzero(c)
        counts.append(c[seen]), rows.append(logs[seen]), of.append(np.full(len(seen), t))
    got = langid.mixtures(np.concatenate(counts).astype(float), np.concatenate(rows), np.concatenate(of), texts)
    grid = np.linspace(0, 1, 2001)[1:-1]
    kept = set()
    for t in range(texts):
        like = np.exp(rows[t])
        fit = np.log(like[:, :1] * grid + like[:, 1:] * (1 - grid)).T @ counts[t]
        price = langid.PENALTY * np.log(max(counts[t].sum(), 2))
        both = fit.max() - 2 * price
        alone = np.array([(counts[t] * rows[t][:, k]).sum() for k in (0, 1)]) - price
        best = grid[fit.argmax()]
        if both > alone.max() + 1e-3:
            kept.add(2)
            assert got[t, 0] == pytest.approx(best, abs=2e-3), t
        elif both < alone.max() - 1e-3:
            kept.add(1)
            assert got[t, alone.argmax()] == pytest.approx(1, abs=1e-6), t
    assert kept == {1, 2}
