"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words at places that no piece spans, and each distinct word of
a batch is encoded once. The symbols of all these words lie in one flat array. In
every round each word's least pair rank is found (a segmented minimum), the
leftmost pairs of that rank are merged in all words at once, and the arrays are
compacted; words without a pair are done. The rounds end when no pair remains.

The library merges one pair at a time: the best score first, the leftmost of
equals. Merging all equal pairs of a word at once gives the same pieces unless a
new pair is as good as the one merged. The model tells for which ranks that can
happen (``PieceModel.alone``); of those a round merges one pair in a word.

The model is read from its file; nothing is trained here. Every worker builds the
tables once, their size is the model's.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a space is written in pieces.
SPACE = "▁"
#: Kinds of pieces in a model's file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Code points are below this.
_CODES = 0x110000
#: Rank of a pair that isn't a piece.
_NONE = np.int32(2**31 - 1)
#: Characters of texts that are encoded together; a longer text is by itself.
TOGETHER = 1_000_000
#: Words whose ids a worker keeps from batch to batch; beyond that it begins anew.
KNOWN = 300_000
#: Words with more symbols take their rounds alone, with a minimum kept for each block.
LONG, _BLOCK = 4096, 1024

codecs.register_error("linkwatch-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(kind) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Tables of a BPE model with byte fallback.

    Models that rewrite the text before it is cut (a character map, fewer
    spaces), or that have pieces set by hand or unused ones, aren't supported: a
    ValueError says so.
    """

    def __init__(self, data: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = [k for _, _, k in pieces]
        # Numbers of the model's fields: 3 model type (2: BPE), 35 byte fallback, 24 space as a suffix;
        # of the normaliser: 2 character map, 3 space put first, 4 fewer spaces, 5 spaces escaped.
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or kinds.count(BYTE) != 256:
            raise ValueError("only BPE models with byte fallback are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("models that rewrite texts are not supported")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("models with pieces set by hand or unused ones are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.size = len(pieces)
        ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        # Symbols: the pieces, then characters that only longer pieces hold, then all other code points.
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbols[c] = self.size + len(symbols) - len(ids)
        self.others = self.size + len(symbols) - len(ids)
        self.symbol = np.arange(_CODES, dtype=np.int32) + np.int32(self.others)
        self.code = np.zeros(self.others, np.int32)
        for p, s in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)], self.code[s] = s, ord(p)
        scores = np.array([s for _, s, _ in pieces], np.float32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.alone = np.zeros(self.rank.max() + 1, bool)
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is None or right is None:
                    continue
                pairs[self._key(left, right)] = i
                for part, n in ((left, k), (right, len(p) - k)):
                    if n > 1 and self.rank[i] <= self.rank[part]:
                        self.alone[self.rank[part]] = True
        self.pairs = pairs
        self._keys = np.array(sorted(pairs), np.int64)
        self._pieces = np.array([pairs[k] for k in self._keys.tolist()], np.int32)
        self.bytes = np.zeros(256, np.int32)
        self.surface = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
            self.surface.append({BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " \u2047 ".encode()}.get(k, lambda p: p.replace(SPACE, " ").encode())(p))
        self.silent = np.array([not x for x in self.surface])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in pieces])
        self._forget()
        # No piece of several characters holds these, so they are words of their own.
        inside = {c for p in ids if len(p) > 1 for c in p}
        apart = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside and chr(c) != " ")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            self.words = re.compile(f"[^{apart}]+|[{apart}]", re.S)
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|[{apart}]", re.S)

    def _key(self, left, right):
        return left * (self.others + _CODES) + right

    def pair_pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        at = np.searchsorted(self._keys, keys)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == keys, self._pieces[at], -1).astype(np.int32)

    def _ranks(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces >= 0, self.rank[pieces], _NONE)

    def _merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when no pair remains, and the word of each; words are in order."""
        piece = np.full(len(symbols), -1, np.int32)
        if len(symbols) > 1:
            same = word[1:] == word[:-1]
            piece[:-1][same] = self.pair_pieces(symbols[:-1][same], symbols[1:][same])
        rank = self._ranks(piece)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = least == _NONE
            if over.any():
                done.append((symbols[over], word[over]))
                left = ~over
                symbols, word, piece, rank, least = symbols[left], word[left], piece[left], rank[left], least[left]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            # Of pairs that overlap, every second one from the left.
            runs = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            at = at[(nth % 2 == 0) & (first | ~self.alone[rank[at]])]
            symbols[at] = piece[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            # Each merged symbol's place after those before it have lost a neighbour.
            at = at - np.arange(len(at))
            symbols, word, piece, rank = symbols[stay], word[stay], piece[stay], rank[stay]
            changed = np.union1d(at, at[at > 0] - 1)
            joined = changed[(changed + 1 < len(word))]
            joined = joined[word[joined] == word[joined + 1]]
            piece[changed] = -1
            piece[joined] = self.pair_pieces(symbols[joined], symbols[joined + 1])
            rank[changed] = self._ranks(piece[changed])
        symbols, word = (np.concatenate(x) for x in zip(*done)) if done else (symbols, word)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _merged_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word: a merge a round, minima kept by block, no compaction before the end."""
        n = len(symbols)
        rank = np.full(-(-n // _BLOCK) * _BLOCK, _NONE)
        rank[: n - 1] = self._ranks(self.pair_pieces(symbols[:-1], symbols[1:]))
        blocks = rank.reshape(-1, _BLOCK)
        least = blocks.min(axis=1)
        now, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def set_rank(i: int) -> None:
            p = self.pairs.get(self._key(now[i], now[after[i]])) if after[i] < n else None
            rank[i] = _NONE if p is None else self.rank[p]
            least[i // _BLOCK] = blocks[i // _BLOCK].min()

        while True:
            b = int(least.argmin())
            if least[b] == _NONE:
                break
            i = b * _BLOCK + int(blocks[b].argmin())
            j = after[i]
            now[i], now[j] = self.pairs[self._key(now[i], now[j])], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            rank[j] = _NONE
            least[j // _BLOCK] = blocks[j // _BLOCK].min()
            set_rank(i)
            if before[i] >= 0:
                set_rank(before[i])
        return np.array([s for s in now if s >= 0], np.int32)

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, those that aren't pieces byte by byte, and the number of ids of each."""
        unknown = symbols >= self.size
        count = np.ones(len(symbols), np.int64)
        code = np.where(symbols >= self.others, symbols - self.others, self.code[np.minimum(symbols, self.others - 1)])[unknown]
        count[unknown] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ids = np.repeat(symbols, count)
        ids[np.repeat(unknown, count)] = self.bytes[np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8"), np.uint8)]
        return ids, count

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after the other, and where each word's begin (and the last end)."""
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        if (sizes > LONG).any():
            short = np.repeat(sizes <= LONG, sizes)
            parts = [self._merged(symbols[short], word[short])]
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(sizes > LONG):
                s = self._merged_long(symbols[ends[i] - sizes[i] : ends[i]])
                parts.append((s, np.full(len(s), i, np.int32)))
            symbols, word = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        else:
            symbols, word = self._merged(symbols, word)
        ids, count = self._ids(symbols)
        per_word = np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_word)]

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._word_ids, self._word_starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and where each text's begin (and the last end).

        Null and empty texts have none.
        """
        if len(self._known) > KNOWN or len(self._word_ids) > 16 * KNOWN:
            self._forget()
        index, known = self._known, len(self._known)
        at: list[int] = []
        ends = [0]
        for text in texts:
            if text:
                spaced = text.replace(" ", SPACE)
                at += [index.setdefault(w, len(index)) for w in self.words.findall(SPACE + spaced if self.prefix else spaced)]
            ends.append(len(at))
        if len(index) > known:
            new, new_starts = self.encode_words(list(islice(index, known, None)))
            self._word_starts = np.r_[self._word_starts, new_starts[1:] + len(self._word_ids)]
            self._word_ids = np.r_[self._word_ids, new]
        ids, starts = self._word_ids, self._word_starts
        places = np.array(at, np.int64)
        sizes = (starts[1:] - starts[:-1])[places]
        total = np.r_[0, np.cumsum(sizes)]
        flat = np.arange(total[-1]) + np.repeat(starts[:-1][places] - total[:-1], sizes)
        return ids[flat], total[np.array(ends)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that make no character become U+FFFD each."""
        if not len(ids):
            return ""
        # Control pieces have no text, and bytes on either side of one make no character.
        silent = np.flatnonzero(self.silent[ids])
        runs = [x for x in np.split(ids, silent) if len(x)] if len(silent) else [ids]
        parts = [b"".join(map(self.surface.__getitem__, x.tolist())) for x in runs]
        if self.prefix and len(said := ids[~self.silent[ids]]) and self.spaced[said[0]]:
            # The space that begins the text was put there by the encoder.
            first = next(i for i, x in enumerate(parts) if x)
            parts[first] = parts[first][1:]
        return "".join(x.decode("utf-8", "linkwatch-each-byte") for x in parts)


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def read_model(path: str) -> bytes:
    """The bytes of a model's file; a bad model raises here, on the driver."""
    with open(path, "rb") as f:
        data = f.read()
    _model(data)
    return data


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for x in texts:
        group.append(x.as_py())
        size += len(group[-1] or "")
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def with_ids(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): the pieces of the whole ``text``.

    Null and empty texts have an empty array. Texts of any length are read whole.
    Every row has its own result, also rows that repeat. All other columns stay,
    whatever their names, but for one named as ``ids``, which is replaced. An
    empty table gives an empty one.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(model)
        for texts in batches:
            parts = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)) for values, ends in map(m.encode, _groups(texts))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids, encoded(F.col(f"`{text}`").cast("string")))


def with_decoded(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text``: what the ids stand for. A null or empty array is an empty text."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(model)
        for lists in batches:
            yield pa.array([m.decode(x.values.to_numpy()) if x.is_valid else "" for x in lists], pa.string())

    return docs.withColumn(text, decoded(F.col(f"`{ids}`")))


def piece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the ids in decimal, joined by commas, and the decoded text.

    A null text counts as an empty one. A null doc_id stays null. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_decoded(with_ids(rows, model), model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
