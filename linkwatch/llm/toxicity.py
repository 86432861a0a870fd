"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what is
peculiar to toxic text. Each window of a document is compressed with the
ordinary dictionary alone and with both; the bytes that the toxic one saves are
the window's distance. Ordinary windows save little, whatever their wording, as
they find the same in either case. The greatest savings of a document, against
the number of its windows, give its score by a logistic curve calibrated on
training documents that no dictionary was trained on; the threshold is a score
of 0.5.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import small_batches
from linkwatch.llm.sampling import fit_logistic, labelled_sample, remainder, sigmoid

#: Training documents of each label.
PER_CLASS = 2500
#: Windows of ordinary training documents, chosen at random, that train the ordinary dictionary.
PLAIN_WINDOWS = 60_000
#: Words of a window, and bytes of the two dictionaries.
WINDOW = 3
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
#: Bytes of the ordinary dictionary put before each window: a block that does
#: not shrink would be stored as it is, whatever the dictionary knows.
LEAD = 32
#: Lengths in bytes of the pieces by which peculiar words are told, and how much
#: more often than in ordinary texts they stand in toxic ones.
PIECES = range(5, 11)
TIMES = 20
THRESHOLD = 0.5


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The words of the whole text, ``size`` at a time."""
    w = (text or "").encode("utf-8", "replace").split()
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of about ``size`` bytes; too few samples are one as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Short matches, no header: the length is the matter."""
    p = zstandard.ZstdCompressionParameters.from_level(
        6, source_size=128, dict_size=max(len(content), 8), min_match=3, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=p)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass(frozen=True)
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    curve: tuple[float, ...]

    def savings(self, text: str | None) -> tuple[float, ...]:
        """The three greatest savings of a window, the logarithm of the windows, and its product with the first."""
        plain, both, lead = _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress, self.ordinary[-LEAD:]
        saved = sorted((len(plain(lead + w)) - len(both(lead + w)) for w in windows(text)), reverse=True)
        first, second, third = (*saved[:3], 0, 0, 0)[:3]
        n = float(np.log1p(len(saved)))
        return float(first), float(second), float(third), n, first * n

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.dot(self.curve[:-1], self.savings(text)) + self.curve[-1]))


def _frequent_pieces(words: list[bytes], least: float) -> dict[bytes, int]:
    """Pieces of words between blanks that ``least`` words have; the first piece may begin with the blank.

    Length by length: a piece can't be more frequent than its beginning.
    """
    out: dict[bytes, int] = {}
    before: dict[bytes, int] | None = None
    for k in PIECES:
        counts = Counter(p for w in words for p in {w[i : i + k] for i in range(len(w) - k)} if before is None or p[:-1] in before)
        before = {p: n for p, n in counts.items() if n >= least}
        out |= before
    return out


def _pieces_among(word: bytes, known: dict[bytes, int] | set[bytes]) -> set[bytes]:
    return {p for k in PIECES for i in range(len(word) - k) if (p := word[i : i + k]) in known}


def peculiar_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words of toxic texts with a piece that ordinary ones hardly have, once for each setting of the word.

    A setting is the word before and after: words that repeat only because whole
    texts were copied have few.
    """
    settings: set[tuple[bytes, ...]] = set()
    for t in toxic:
        w = [b"", *(t or "").encode("utf-8", "replace").split(), b""]
        settings.update(zip(w, w[1:], w[2:]))
    words = [b" " + w + b" " for _, w, _ in sorted(settings)]
    del settings
    least, share = max(4, 0.02 * len(toxic)), len(ordinary) / len(toxic)
    frequent = _frequent_pieces(words, least)
    common = Counter(p for t in ordinary for w in set(windows(t, 1)) for p in _pieces_among(w, frequent))
    own = {p for p, n in frequent.items() if (common[p] + 0.5) * TIMES <= n * share}
    return [w for w in words if _pieces_among(w, own)]


def fit_toxicity(sample: pd.DataFrame) -> ToxicModel:
    """The model of a sample (text, label). With one label only, every score is that label; with none it is 0."""
    texts = {v: list(sample["text"][sample["label"] == v]) for v in (0, 1)}
    if not texts[0] or not texts[1]:
        return ToxicModel(b"", b"", (0.0,) * 5 + (60.0 if texts[1] else -60.0,))
    learn = {v: t[: max(1, (len(t) * 7) // 10)] for v, t in texts.items()}
    test = {v: t[len(learn[v]) :] or t for v, t in texts.items()}
    rng = random.Random(7)
    plain = [w for t in learn[0] for w in windows(t, 12)]
    rng.shuffle(plain)
    own = peculiar_words(learn[1], learn[0])
    rng.shuffle(own)
    model = ToxicModel(trained(ORDINARY_BYTES, plain[:PLAIN_WINDOWS]), trained(TOXIC_BYTES, own) if own else b"", ())
    x = np.array([model.savings(t) for v in (0, 1) for t in test[v]])
    y = np.repeat([0, 1], [len(test[0]), len(test[1])])
    return ToxicModel(model.ordinary, model.toxic, tuple(map(float, fit_logistic(x, y, l2=0.5))))


def score_texts(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with the column ``score``; the texts are read whole."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", scores(F.col("text").cast("string")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels are learnt from rows whose crc32(doc_id) mod ``folds`` isn't ``held``.
    Null, empty and wordless texts have no windows and score as texts that save
    nothing. A null doc_id is held out. Rows that repeat a doc_id are scored each.
    Other columns are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    out = lambda c: F.coalesce(remainder(c, folds) == held, F.lit(True))
    model = fit_toxicity(labelled_sample(docs, labels, "toxic", lambda c: ~out(c), per_class))
    rows = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
