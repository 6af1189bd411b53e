"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Words longer than PIECE letters are cut into pieces, each a place; texts without
spaces have windows like others. Inputs of a place are a word vector (of words known from training) and the mean of
the vectors of the word's character trigrams; a window's states are pooled by
attention and give a probability. A text is scored in overlapping windows, all of
them, and has the largest probability. The network is trained here in numpy, on
the windows that score highest in each training text.

Scale: training takes a bounded sample of labelled rows (SAMPLE for each label) on
the driver. Scoring is one pass without an exchange; the model that is sent to the
workers has a vector for each word that MIN_DOCS of these rows have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, prepare, trimmed

#: Labelled rows of each label that training takes at most, in the order of a hash of their ids.
SAMPLE = {0: 3000, 1: 1500}
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 48, 36
#: Texts of the sample that have a word which is given a vector of its own, at least; others are known by their trigrams.
MIN_DOCS = 4
#: Letters of a place; a longer word takes several, with two letters shared so that no trigram is lost.
PIECE = 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND, GRAMS = 8, 8, 8, 8, 4096
#: Windows of a training step, and steps of an epoch at least: few texts are passed over more often.
BATCH, LEAST_STEPS = 128, 60
#: Words whose projections a worker keeps.
KEPT_WORDS = 1 << 17
EDGES = "\"'.,;:!?()[]{}<>*#$%&|+=-_/\\~`^@…“”„«»‘’"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their edges, long ones in consecutive pieces."""
    words = [x.strip(EDGES) or x for x in (text or "").lower().split()]
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - 2), PIECE - 2)]


def window_starts(n: int) -> range:
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all words with their edges, and each word's number of them."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in raw])
    n = np.maximum(size - 2, 1)
    at = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    third = np.minimum(at + 2, len(data) - 1)
    code = data[at] * np.uint64(65_537) + data[np.minimum(at + 1, len(data) - 1)] * np.uint64(257) + data[third]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) % GRAMS, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """vocab maps words to rows of "word"; row 0 is for unknown words."""

    vocab: dict[str, int]
    p: dict[str, np.ndarray]
    constant: float | None = None  # without both labels in the sample

    @classmethod
    def new(cls, vocab: dict[str, int], odds: np.ndarray, seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        x = WORD_DIM + CHAR_DIM

        def init(*shape: int) -> np.ndarray:
            return (g.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        word = g.standard_normal((len(vocab) + 1, WORD_DIM)).astype(np.float32) * 0.05
        word[1:, 0] = odds
        return cls(vocab, {
            "word": word, "char": g.standard_normal((GRAMS, CHAR_DIM)).astype(np.float32) * 0.05,
            "W": init(2, x, 3 * HIDDEN), "U": init(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "A": init(2 * HIDDEN, ATTEND), "v": init(ATTEND), "o": init(2 * HIDDEN), "c": np.full(1, -1, np.float32),
        })

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: word rows, trigram codes, numbers of codes, input vectors."""
        rows = np.array([self.vocab.get(w, 0) for w in words])
        codes, n = gram_codes(words)
        chars = np.add.reduceat(self.p["char"][codes], np.cumsum(n) - n) / n[:, None].astype(np.float32)
        return rows, codes, n, np.concatenate([self.p["word"][rows], chars], axis=1)

    def forward(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates: (2, words, 3H) projections; at: (N, T) word of each place; mask: (N, T). Logits of N windows."""
        p, (n, t), size = self.p, at.shape, HIDDEN
        h = np.zeros((2, n, size), np.float32)
        states = np.zeros((t, n, 2 * size), np.float32)
        kept = []
        for s in range(t):
            b = t - 1 - s
            g = np.stack([gates[0][at[:, s]], gates[1][at[:, b]]])
            u = h @ p["U"]
            zr = _sigmoid(g[:, :, : 2 * size] + u[:, :, : 2 * size])
            z, r = zr[:, :, :size], zr[:, :, size:]
            un = u[:, :, 2 * size :]
            new = np.tanh(g[:, :, 2 * size :] + r * un)
            live = np.stack([mask[:, s], mask[:, b]])[:, :, None]
            nxt = h + live * (1 - z) * (new - h)
            if keep:
                kept.append((h, z, r, un, new, live))
            h = nxt
            states[s, :, :size], states[b, :, size:] = h[0], h[1]
        e = np.tanh(states @ p["A"])
        score = np.where(mask.T > 0, e @ p["v"], np.float32(-1e9))
        a = np.exp(score - score.max(axis=0)) * mask.T
        a = a / np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = (a[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["o"] + p["c"]
        return (logit, (states, e, a, pooled, kept)) if keep else logit

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, HIDDEN
        rows, codes, n, x = self.inputs(words)
        gates = x @ p["W"] + p["b"]
        logit, (states, e, a, pooled, kept) = self.forward(gates, at, mask, keep=True)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        dpool = d[:, None] * p["o"]
        dstates = a[:, :, None] * dpool
        da = (states * dpool).sum(axis=2)
        dscore = a * (da - (a * da).sum(axis=0))
        g["v"] = (e * dscore[:, :, None]).sum(axis=(0, 1))
        de = dscore[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = np.tensordot(states, de, ([0, 1], [0, 1]))
        dstates = dstates + de @ p["A"].T
        t = at.shape[1]
        dgates = np.zeros_like(gates)
        g["U"] = np.zeros_like(p["U"])
        dh = np.zeros((2, len(at), size), np.float32)
        for s in range(t - 1, -1, -1):
            b = t - 1 - s
            h, z, r, un, new, live = kept[s]
            dh = dh + np.stack([dstates[s, :, :size], dstates[b, :, size:]])
            dnew = dh * live * (1 - z) * (1 - new * new)
            dz = dh * live * (h - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            du = np.concatenate([dz, dr, dnew * r], axis=2)
            dg = np.concatenate([dz, dr, dnew], axis=2)
            g["U"] += h.transpose(0, 2, 1) @ du
            dh = dh * (1 - live * (1 - z)) + du @ p["U"].transpose(0, 2, 1)
            np.add.at(dgates[0], at[:, s], dg[0])
            np.add.at(dgates[1], at[:, b], dg[1])
        g["W"] = x.T @ dgates
        g["b"] = dgates.sum(axis=1, keepdims=True)
        dx = (dgates @ p["W"].transpose(0, 2, 1)).sum(axis=0)
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], rows, dx[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], codes, np.repeat(dx[:, WORD_DIM:] / n[:, None].astype(np.float32), n, axis=0))
        return g


def _batch(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    words = sorted({w for x in windows for w in x}) or [""]
    index = {w: i for i, w in enumerate(words)}
    t = max(1, max(len(x) for x in windows))
    at, mask = np.zeros((len(windows), t), np.int64), np.zeros((len(windows), t), np.float32)
    for i, x in enumerate(windows):
        at[i, : len(x)], mask[i, : len(x)] = [index[w] for w in x], 1
    return words, at, mask


class Scorer:
    """Scores texts with a network; keeps the projections of words it has met, up to KEPT_WORDS."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.gates = np.zeros((2, KEPT_WORDS, 3 * HIDDEN), np.float32)

    def window_logits(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and logit of all windows."""
        net, out = self.net, []
        doc = np.array([i for i, x in enumerate(docs) for _ in window_starts(len(x))], np.int64)
        start = np.array([s for x in docs for s in window_starts(len(x))], np.int64)
        size = np.array([len(x) for x in docs], np.int64)
        first = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()) + 1, np.int64)
        new: dict[str, None] = {}
        flat = [w for x in docs for w in x]
        if len(flat) > KEPT_WORDS:  # a very long text: only the words it has
            held, self.index = self.index, {}
            words = list(dict.fromkeys(flat))
            gates = self._project(words)
            table = {w: i for i, w in enumerate(words)}
            ids[:-1] = [table[w] for w in flat]
            self.index = held
        else:
            index = self.index
            new = dict.fromkeys(w for w in flat if w not in index)
            if len(index) + len(new) > KEPT_WORDS:
                index.clear()
                new = dict.fromkeys(flat)
            if new:
                at = len(index)
                index.update(zip(new, range(at, at + len(new)), strict=True))
                self.gates[:, at : at + len(new)] = self._project(list(new))
            ids[:-1] = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
            gates = self.gates
        length = np.minimum(size[doc] - start, WINDOW)
        order = np.argsort(length, kind="stable")
        logits = np.zeros(len(doc), np.float32)
        for lo in range(0, len(order), 1024):
            w = order[lo : lo + 1024]
            t = max(1, int(length[w].max()))
            place = np.arange(t)
            mask = place[None, :] < length[w][:, None]
            at = ids[np.where(mask, (first[doc[w]] + start[w])[:, None] + place, len(ids) - 1)]
            logits[w] = net.forward(gates, at, mask.astype(np.float32))
        return doc, start, logits

    def _project(self, words: list[str]) -> np.ndarray:
        p, step = self.net.p, 1 << 14
        return np.concatenate([self.net.inputs(words[i : i + step])[3] @ p["W"] + p["b"] for i in range(0, len(words), step)], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        out = np.zeros(len(texts))
        if len(texts):
            doc, _, logit = self.window_logits([words_of(t) for t in texts])
            top = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(top, doc, logit)
            out = _sigmoid(top.astype(np.float64))
        return out


def train(texts: list[str | None], labels: list[int], epochs: int = 5, seed: int = 7) -> Network:
    """Fits a network. Without both labels, one that scores every text as the label there is (0 without any)."""
    if len(set(labels)) < 2:
        return Network({}, {}, float(labels[0]) if labels else 0.0)
    docs = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    seen = [set(x) for x in docs]
    yes, no = Counter(w for x, l in zip(seen, labels, strict=True) if l for w in x), Counter(w for x, l in zip(seen, labels, strict=True) if not l for w in x)
    both = yes + no
    vocab = {w: i + 1 for i, (w, n) in enumerate(sorted(((w, n) for w, n in both.items() if n >= MIN_DOCS), key=lambda x: (-x[1], x[0])))}
    n1, n0 = float(y.sum()), float((1 - y).sum())
    odds = np.array([np.log((yes[w] + 0.5) / (n1 + 1)) - np.log((no[w] + 0.5) / (n0 + 1)) for w in vocab], np.float32) / 3
    net = Network.new(vocab, odds, seed)
    weight = dict(zip(vocab, odds.tolist(), strict=True))
    rng = np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    chosen: list[list[int]] = []
    for x in docs:
        gain = np.concatenate([[0], np.cumsum([max(0, weight.get(w, 0)) for w in x])])
        starts = list(window_starts(len(x)))
        chosen.append([max(starts, key=lambda s, g=gain, n=len(x): g[min(s + WINDOW, n)] - g[min(s, n)])])
    for epoch in range(epochs):
        if epoch:  # the windows that score highest now
            scorer = Scorer(net)
            for lo in range(0, len(docs), 500):
                d, s, l = scorer.window_logits(docs[lo : lo + 500])
                o = np.lexsort((s, -l, d))
                top = o[np.concatenate([[True], d[o][1:] != d[o][:-1]])]
                for i, a in zip(d[top], s[top], strict=True):
                    chosen[lo + i] = [int(a)]
        todo = [(i, s) for i, starts in enumerate(chosen) for s in starts]
        for i in np.flatnonzero(y == 0):
            n = len(docs[i])
            todo.append((int(i), int(rng.choice(list(window_starts(n))))))
        order = np.concatenate([rng.permutation(len(todo)) for _ in range(-(-BATCH * LEAST_STEPS // len(todo)))])
        for lo in range(0, len(order), BATCH):
            part = [todo[i] for i in order[lo : lo + BATCH]]
            words, at, mask = _batch([docs[i][s : s + WINDOW] for i, s in part])
            label = np.array([y[i] for i, _ in part], np.float32)
            g = net.gradients(words, at, mask, label, np.ones_like(label))
            step += 1
            rate = 0.01 * min(1, step / 20) * (0.5 if epoch >= epochs - 2 else 1)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: dict[int, int] = SAMPLE) -> DataFrame:
    """(id, text, label) of at most per_label[label] ids for each label, out of those whose crc32(id as text) mod 5 is not 0. Of rows that repeat an id, the least text; that is chosen before anything is collected."""
    l = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")).where(crc_mod(F.col("id"), 5) != 0)
    some = None
    for value in (0, 1):
        part = l.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label[value])
        some = part if some is None else some.unionByName(part)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = d.join(F.broadcast(some), "id")  # at most the sum of per_label rows are sent
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Network:
    rows = sorted((r.id, r.text, r.label) for r in training_rows(docs, labels, **columns).collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def score_toxicity(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Each row with score_col, from 0 to 1, of its whole text.

    Null and empty texts have one window without words, and so the score of no
    evidence. Repeated rows score alike. An input column named score_col is
    replaced. An empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    names = [c for c in docs.columns if c != score_col]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    out = to_arrow_schema(schema)
    sent = spark.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                yield pa.record_batch([*part.columns, pa.array(scorer.scores(part.column(text_col).to_pylist()), pa.float64())], schema=out)

    return docs.mapInArrow(trimmed(of), schema)
