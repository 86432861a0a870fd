"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its potential comes from counts of the line and of its
two neighbours, the chain adds potentials of neighbouring labels. The marginals
of forward-backward, weighted by the lines' lengths, give the good share of a
document, which a logistic curve turns into a probability of quality.

Labels are of documents: the lines of a good one start as good, those of a bad
one as bad; lines of bad documents that a line model takes for good are then
relabelled, and the field is fitted to these labels by its likelihood.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import BLANKS, small_batches
from linkwatch.llm.sampling import fit_logistic, labelled_sample, remainder, sigmoid

#: Training documents of each label, and the most lines of one.
PER_CLASS = 1000
MOST_LINES = 200
THRESHOLD = 0.7

_SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽΑ-ΩА-Я]")
_PLAIN = re.compile(r"(?<!\S)[\"'(«„“]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…]?[\"')»“”]?(?!\S)")
_DIGIT = re.compile(r"\d")
N_COUNTS = 11


def lines_of(text: str | None) -> list[str]:
    """The lines that hold a word."""
    return [x for x in (text or "").split("\n") if x.strip(BLANKS)]


def line_counts(lines: list[str]) -> np.ndarray:
    """A row of N_COUNTS numbers for each line of a document."""
    seen: set[str] = set()
    rows = []
    for x in lines:
        words = x.split() or [x]
        n, size = len(words), len(x)
        rows.append(
            (
                math.log1p(n),
                min(size / n, 40.0) / 10,
                sum(map(x.count, _SYMBOLS)) / n,
                x.count("!") / n,
                len(_UPPER.findall(x)) / size,
                len(_PLAIN.findall(x)) / n,
                len(set(words)) / n,
                1.0 if x.rstrip(BLANKS)[-1] in ".!?…" else 0.0,
                len(_DIGIT.findall(x)) / size,
                1.0 if x in seen else 0.0,
                min(max(map(len, words)), 60) / 20,
            )
        )
        seen.add(x)
    return np.array(rows, float).reshape(-1, N_COUNTS)


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """Counts of the line, the one before, the one after (zeros at the ends), and a constant."""
    blank = np.zeros((1, rows.shape[1]))
    return np.hstack([rows, np.vstack([blank, rows[:-1]]), np.vstack([rows[1:], blank]), np.ones((len(rows), 1))])


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the label good
    moves: np.ndarray  # 2 x 2, from bad / good to bad / good
    curve: tuple[float, float]

    def potentials(self, lines: list[str]) -> np.ndarray:
        return with_neighbours((line_counts(lines) - self.mean) / self.scale) @ self.weights

    def marginals(self, potentials: np.ndarray) -> list[float]:
        """P(good) of each line, by forward-backward."""
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        good = np.exp(np.clip(potentials, -30, 30)).tolist()
        forth, b, g = [], 1.0, 1.0
        for k, e in enumerate(good):
            b, g = (1.0, e) if not k else (b * bb + g * gb, (b * bg + g * gg) * e)
            b, g = b / (b + g), g / (b + g)
            forth.append(g)
        out, b, g = [0.0] * len(good), 1.0, 1.0
        for k in range(len(good) - 1, -1, -1):
            p, q = forth[k] * g, (1 - forth[k]) * b
            out[k] = p / (p + q)
            e = good[k]
            b, g = bb * b + bg * e * g, gb * b + gg * e * g
            b, g = b / (b + g), g / (b + g)
        return out

    def good_share(self, text: str | None) -> float:
        """Length-weighted mean of the marginals; 0 without lines."""
        lines = lines_of(text)
        if not lines:
            return 0.0
        size = np.array([len(x) for x in lines], float)
        return float(size @ np.array(self.marginals(self.potentials(lines))) / size.sum())

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return float(sigmoid(a * _logit(self.good_share(text)) + b))


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _fit_chain(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves that maximise the likelihood of the line labels (Adam, all documents at once)."""
    order = np.argsort([-len(a) for a in x], kind="stable")
    x, y = [x[i] for i in order], [y[i] for i in order]
    size = np.array([len(a) for a in x])
    t_max, docs, k = int(size.max()), len(x), x[0].shape[1]
    px, py, on = np.zeros((t_max, docs, k)), np.zeros((t_max, docs), int), np.zeros((t_max, docs), bool)
    for d in range(docs):
        px[: size[d], d], py[: size[d], d], on[: size[d], d] = x[d], y[d], True
    live = on.sum(axis=1)  # documents by falling length: those with a line t come first
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (py[:-1][on[1:]], py[1:][on[1:]]), 1)
    theta, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    total = on.sum()
    for step in range(1, rounds + 1):
        w, moves = theta[:k], np.exp(theta[k:].reshape(2, 2))
        e = np.ones((t_max, docs, 2))
        e[:, :, 1] = np.exp(np.clip(px @ w, -30, 30))
        f, b = np.zeros((t_max, docs, 2)), np.ones((t_max, docs, 2))
        f[0] = e[0] / e[0].sum(axis=1, keepdims=True)
        for t in range(1, t_max):
            n = live[t]
            a = (f[t - 1, :n] @ moves) * e[t, :n]
            f[t, :n] = a / a.sum(axis=1, keepdims=True)
        for t in range(t_max - 2, -1, -1):
            n = live[t + 1]
            a = (e[t + 1, :n] * b[t + 1, :n]) @ moves.T
            b[t, :n] = a / a.sum(axis=1, keepdims=True)
        g = f * b
        g = g / np.maximum(g.sum(axis=2, keepdims=True), 1e-300)
        both = f[:-1, :, :, None] * moves * (e[1:] * b[1:])[:, :, None, :]
        both /= np.maximum(both.sum(axis=(2, 3), keepdims=True), 1e-300)
        grad = np.concatenate([np.einsum("tdk,td->k", px, (py - g[:, :, 1]) * on), (pairs - both[on[1:]].sum(axis=0)).ravel()])
        grad = grad / total - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:k], theta[k:].reshape(2, 2)


def fit_field(sample: pd.DataFrame) -> LineField:
    """The field of a sample (text, label). Without both labels every document scores 0.5."""
    texts = [(lines_of(t), int(q)) for t, q in zip(sample["text"], sample["label"])]
    texts = [(x, q) for x, q in texts if 0 < len(x) <= MOST_LINES]
    if len({q for _, q in texts}) < 2:
        return LineField(np.zeros(N_COUNTS), np.ones(N_COUNTS), np.zeros(3 * N_COUNTS + 1), np.zeros((2, 2)), (0.0, 0.0))
    counts = [line_counts(x) for x, _ in texts]
    every = np.vstack(counts)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    rows = [with_neighbours((c - mean) / scale) for c in counts]
    good = np.array([q for _, q in texts])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.vstack(rows)[:, :N_COUNTS]  # the line by itself
    labels = good[of].astype(float)
    for _ in range(3):
        w = fit_logistic(flat, labels, l2=1.0)
        p = sigmoid(flat @ w[:-1] + w[-1])
        labels = np.where(good[of] == 1, 1.0, (p > 0.5).astype(float))
        # A bad document keeps its worst line at least.
        worst = pd.Series(p).groupby(of).idxmin().to_numpy()
        labels[worst[good == 0]] = 0.0
    cuts = np.cumsum([len(r) for r in rows])[:-1]
    weights, moves = _fit_chain(rows, [a.astype(int) for a in np.split(labels, cuts)])
    field = LineField(mean, scale, weights, moves, (1.0, 0.0))
    share = np.array([field.good_share("\n".join(x)) for x, _ in texts])
    a, b = fit_logistic(_logit(share)[:, None], good, l2=0.1)
    return LineField(mean, scale, weights, moves, (float(a), float(b)))


def score_texts(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` with the column ``score``; the texts are read whole."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([field.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", scores(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels are learnt from rows whose crc32(doc_id) mod ``folds`` isn't ``held``.
    Null, empty and wordless texts have a good share of 0 and score by that. A
    null doc_id is held out. Rows that repeat a doc_id are scored each. Other
    columns are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    out = lambda c: F.coalesce(remainder(c, folds) == held, F.lit(True))
    field = fit_field(labelled_sample(docs, labels, "quality", lambda c: ~out(c), per_class))
    rows = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), field)
    return rows.select("doc_id", out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
