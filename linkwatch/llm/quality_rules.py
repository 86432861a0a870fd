"""Quality rules as weak supervision.

Each rule votes keep, reject or abstains. Expectation-maximisation over the
vote patterns of the whole corpus estimates the share of good documents and,
for each rule that votes, how often it rejects good and bad ones. The verdict is
the posterior probability of quality, not "every rule must pass".

The patterns are counted by Spark: at most 3 ** len(RULES) rows reach the
driver, whatever the size of the corpus. No label is read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import BLANKS, small_batches, written

MIN_WORDS = 50
THRESHOLD = 0.5

SYMBOLS = "#*$%&|<>"
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_shouts", "n_plain_words", "n_ended_lines", "longest_word",
)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(r"(?<![^\x20\x09-\x0D])[\"'(«„“]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…]?[\"')»“”]?(?![^\x20\x09-\x0D])")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n < 60:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) == n:
            return 0
        often = np.fromiter((seen[x] > 1 for x in windows), bool, n)
    else:
        ids: dict[str, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n + 2)
        pairs = codes[:-1] * len(ids) + codes[1:]
        if len(ids) > 2_000_000:  # keeps pair * word within 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + codes[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        often = np.zeros(n, bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= often
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts named in FEATURES, of one whole text (null: an empty one)."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    letters = sum(map(str.isalpha, text)) if len(text) < 64 else len(text) - len(_NOT_LETTER.findall(text))
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(_UPPER.findall(text)),
        letters,
        text.count("!"),
        len(_PLAIN.findall(text)),
        sum(x.rstrip(BLANKS)[-1] in ".!?…\"'”»:" for x in lines),
        max(map(len, words), default=0),
    )


_NOT_LETTER = re.compile(r"[\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽΑ-ΩА-Я]")

_STRUCT = "struct<" + ",".join(f"{x}:bigint" for x in FEATURES) + ">"


def features(text: Column) -> Column:
    """Struct of FEATURES of a text column."""

    @F.pandas_udf(_STRUCT)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_features(t) for t in texts], columns=FEATURES)

    return counted(text)


@dataclass(frozen=True)
class Rule:
    """Rejects from ``bad`` on and keeps up to ``good`` (the other way round if bad < good); abstains between."""

    name: str
    part: str
    whole: str
    good: float
    bad: float

    def vote(self, f) -> Column:
        """1 keep, -1 reject, 0 abstain."""
        x = F.try_divide(f(self.part).cast("double"), f(self.whole).cast("double"))
        keep, reject = (x <= self.good, x >= self.bad) if self.good < self.bad else (x >= self.good, x <= self.bad)
        return F.when(keep, 1).when(reject, -1).otherwise(0).cast("byte")


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.01, 0.05),
    Rule("word_length_high", "word_chars", "n_words", 9.0, 14.0),
    Rule("word_length_low", "word_chars", "n_words", 3.5, 2.5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.1, 0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.15, 0.3),
    Rule("capitals", "n_upper", "n_letters", 0.15, 0.4),
    Rule("shouting", "n_shouts", "n_words", 0.05, 0.3),
    Rule("plain_words", "n_plain_words", "n_words", 0.85, 0.6),
    Rule("ended_lines", "n_ended_lines", "n_lines", 0.5, 0.1),
)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; for each rule, how often its vote on good and on bad ones is a rejection."""

    prior: float
    reject_good: tuple[float, ...]
    reject_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a keep and a reject vote of each rule add. A keep never lowers the odds, a reject never raises them."""
        out = []
        for g, b in zip(self.reject_good, self.reject_bad):
            out.append((max(0.0, math.log((1 - g) / (1 - b))), min(0.0, math.log(g / b))))
        return out


#: Votes that each rule starts from, as if seen on so many good and bad documents.
_PSEUDO = 20.0
_START_GOOD, _START_BAD = 0.05, 0.5


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents).

    Abstentions say nothing. The start and the pseudo-counts tell which side is
    which; with no votes at all the start is the result.
    """
    k = len(RULES)
    votes = np.array([p for p, _ in patterns], float).reshape(-1, k)
    n = np.array([c for _, c in patterns], float)
    keep, reject = (votes > 0).astype(float), (votes < 0).astype(float)
    prior, g, b = 0.8, np.full(k, _START_GOOD), np.full(k, _START_BAD)
    for _ in range(rounds):
        model = LabelModel(prior, tuple(g), tuple(b))
        w = np.array(model.weights())
        odds = math.log(prior / (1 - prior)) + keep @ w[:, 0] + reject @ w[:, 1]
        q = n / (1 + np.exp(-np.clip(odds, -60, 60)))
        r = n - q
        was = prior
        prior = float((q.sum() + 0.8 * _PSEUDO) / (n.sum() + _PSEUDO))
        g = (q @ reject + _START_GOOD * _PSEUDO) / (q @ (keep + reject) + _PSEUDO)
        b = (r @ reject + _START_BAD * _PSEUDO) / (r @ (keep + reject) + _PSEUDO)
        if abs(prior - was) < 1e-9:
            break
    return LabelModel(prior, tuple(map(float, g)), tuple(map(float, b)))


def votes(f) -> list[Column]:
    return [r.vote(f).alias(f"vote_{r.name}") for r in RULES]


def fit(feature_rows: DataFrame) -> LabelModel:
    """The label model of a table with the FEATURES columns; documents that fail the base rules take no part."""
    kept = feature_rows.where(~base_failed(F.col))
    names = [f"vote_{r.name}" for r in RULES]
    # At most 3 ** len(RULES) rows.
    rows = kept.select(*votes(F.col)).groupBy(*names).count().orderBy(*names).collect()
    return fit_label_model([(tuple(r[:-1]), r[-1]) for r in rows])


def base_failed(f) -> Column:
    """Too short, or mostly repeated."""
    return (f("n_words") < MIN_WORDS) | (F.lit(100) * f("n_repeat_words") > F.lit(50) * f("n_words"))


def posterior(model: LabelModel, f) -> Column:
    """Probability of quality, given the votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for vote, (keep, reject) in zip(votes(f), model.weights()):
        odds = odds + F.when(vote > 0, keep).when(vote < 0, reject).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the counts of the contract, base_failed, kept, quality) of every document.

    A null or empty text has counts of 0 and fails the base rules. Every row has
    its own result, also rows that repeat a doc_id or lack one. Other columns
    are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), features(F.col("text")).alias("f")).select("doc_id", "f.*")
    rows = written(rows, "quality-features")
    model = fit(rows)
    failed = base_failed(F.col)
    q = posterior(model, F.col)
    return rows.select("doc_id", *FEATURES[:5], failed.alias("base_failed"), (~failed & (q >= threshold)).alias("kept"), q.alias("quality"))


def keep_quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    The counts are taken twice, once for the model and once to filter: they cost
    less than a shuffle of the texts.
    """
    small_batches(docs.sparkSession)
    model = fit(docs.select(features(F.col("text")).alias("f")).select("f.*"))
    names = docs.columns
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), features(F.col("text")).alias("f"))
    f = lambda c: F.col(f"f.{c}")
    kept = counted.where(~base_failed(f) & (posterior(model, f) >= threshold))
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
