"""Toxicity scores against a plain scorer: one window and one word at a time, in double precision."""

import math
import random

import numpy as np
import pytest

from tallyglass.llm import toxicity


def plain_codes(word):
    b = b"\x02" + word.encode() + b"\x03"
    return [(((b[i] * 65_537 + b[i + 1] * 257 + b[i + 2]) * 0x9E3779B97F4A7C15 % 2**64) >> 52) % toxicity.GRAMS for i in range(len(b) - 2)]


def plain_logit(net, words):
    """Both directions by the recurrence's definition, then attention over the places."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = [np.concatenate([p["word"][net.vocab.get(w, 0)], np.mean([p["char"][c] for c in plain_codes(w)], axis=0)]) for w in words]
    states = np.zeros((len(x), 2 * h))
    for way in (0, 1):
        s = np.zeros(h)
        for i in range(len(x)) if way == 0 else reversed(range(len(x))):
            g, u = x[i] @ p["W"][way] + p["b"][way][0], s @ p["U"][way]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            states[i, way * h : way * h + h] = s
    if not words:
        return float(p["c"][0])
    e = np.array([np.tanh(t @ p["A"]) @ p["v"] for t in states])
    a = np.exp(e - e.max())
    return float((a / a.sum()) @ states @ p["o"] + p["c"][0])


def plain_score(net, text):
    words = toxicity.words_of(text)
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    return 1 / (1 + math.exp(-max(plain_logit(net, words[s : s + toxicity.WINDOW]) for s in starts)))


def made(seed):
    g = random.Random(seed)
    words = list(dict.fromkeys("".join(g.choice("abcdeéж日#") for _ in range(g.randrange(1, 9))) for _ in range(120)))
    net = toxicity.Network.new({w: i + 1 for i, w in enumerate(words[:50])}, np.array([g.uniform(-1, 1) for _ in range(50)], np.float32), seed)
    for k in ("word", "char"):  # so that windows differ clearly
        net.p[k] *= 8
    size = toxicity.WINDOW, toxicity.STRIDE
    lengths = [0, 1, size[1], size[0] - 1, size[0], size[0] + 1, size[0] + size[1], size[0] + size[1] + 1, 700] + [g.randrange(300) for _ in range(12)]
    texts = [" ".join(g.choice(words) for _ in range(n)) for n in lengths] + [None, "", " \n\t", "x" * 500, texts_of_edges(words)]
    return net, texts + texts[:3]


def texts_of_edges(words):
    return " ".join(f"({w.upper()})!" for w in words)


@pytest.mark.parametrize("kept", [toxicity.KEPT_WORDS, 90])
def test_scores_are_those_of_a_plain_scorer(monkeypatch, kept):
    """All windows count, and neither the words that a worker keeps nor the other texts change a score."""
    monkeypatch.setattr(toxicity, "KEPT_WORDS", kept)  # 90: kept words are dropped, and long texts pass them by
    for seed in (1, 2):
        net, texts = made(seed)
        want = [plain_score(net, t) for t in texts]
        got = toxicity.Scorer(net).scores(texts)
        assert np.allclose(got, want, atol=2e-5), np.abs(got - want).max()
        one = toxicity.Scorer(net)
        assert np.allclose([one.scores([t])[0] for t in texts], want, atol=2e-5)
        assert max(want) - min(want) > 0.05


def test_scores_of_a_table(spark):
    net, texts = made(3)
    d = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, net).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain_score(net, t) for t in texts], atol=2e-5) and len(got) == len(texts)
