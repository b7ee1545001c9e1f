"""Exact ids of whole texts from a public vocabulary, each distinct unit encoded once per worker.

A text is cut where no token of the vocabulary's pre-tokeniser can cross: before white space that follows
other bytes, between an ASCII letter or digit and ASCII punctuation, and between ASCII punctuation other
than an apostrophe and an ASCII letter or digit. Units between cuts are encoded by the tokenizers library
and kept in a table by 64-bit hash with their bytes; every unit's bytes are compared with those its ids came from, so
two units with one hash get each its own ids. The table belongs to the worker process and is emptied when it holds
``CACHE_UNITS`` units, which changes no result. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
from functools import cached_property
from itertools import chain

import numpy as np

from pantry.llm import text as T

CACHE_UNITS = 1_500_000
_encoders: dict[tuple[str, bool], "UnitEncoder"] = {}


def piece_encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for a sentencepiece model."""
    if (path, True) not in _encoders:
        _encoders[path, True] = PieceEncoder(path)
    return _encoders[path, True]


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_OPEN = _PUNCT.copy()
_OPEN[39] = False


def encoder(path: str, drop_white: bool = False) -> "UnitEncoder":
    """The worker's encoder for a vocabulary file. drop_white: the vocabulary ignores white space and case of A-Z."""
    if (path, drop_white) not in _encoders:
        _encoders[path, drop_white] = UnitEncoder(path, drop_white)
    return _encoders[path, drop_white]


class UnitEncoder:
    def __init__(self, path: str, drop_white: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.drop_white = drop_white
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.raw = np.zeros(0, np.uint8)  # the units' bytes, and where each begins
        self.raw_starts = np.zeros(1, np.int64)

    @cached_property
    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids of a byte-level vocabulary back to back, and the range of each id."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the alphabet of such vocabularies: these bytes stand for themselves
        rest = [b for b in range(256) if b not in plain]  # and these, in order, for the characters from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        token = [b""] * self.model.get_vocab_size()
        for x, i in self.model.get_vocab().items():
            token[i] = bytes(byte[c] for c in x)
        return np.frombuffer(b"".join(token), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in token])))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of a sequence of ids of a byte-level vocabulary, and the range of each."""
        flat, ranges = self.written
        lengths = np.diff(ranges)[ids]
        return flat[T.ragged(ranges[ids], lengths)].tobytes(), np.concatenate(([0], np.cumsum(lengths)))

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each unit."""
        white = T.WHITE[data]
        alnum = _ALNUM[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= (~white[:-1] & white[1:]) | (alnum[:-1] & _PUNCT[data[1:]]) | (_OPEN[data[:-1]] & alnum[1:])
        if not self.drop_white:
            at = np.flatnonzero(edge)
            return at[:-1], at[1:]
        edge[1:-1] |= white[:-1] & ~white[1:]
        at = np.flatnonzero(edge)
        keep = ~white[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
        return at[:-1][keep], at[1:][keep]

    def _ids(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(units, add_special_tokens=False)]

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        return T.lower(data) if self.drop_white else data

    def _learn(self, units: list[bytes], hashes: np.ndarray | None) -> np.ndarray:
        """The rows of new units; those with hashes are found again by them."""
        ids = self._ids([x.decode("utf-8", "replace") for x in units])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        rows = len(self.starts) + np.arange(len(units))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, flat))
        self.raw = np.concatenate((self.raw, self._hashed(np.frombuffer(b"".join(units), np.uint8))))
        self.raw_starts = np.concatenate((self.raw_starts, self.raw_starts[-1] + np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))))
        if hashes is not None:
            at = np.searchsorted(self.keys, hashes)
            self.keys = np.insert(self.keys, at, hashes)
            self.rows = np.insert(self.rows, at, rows)
        return rows

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other as uint32, and the range of each text; end_id follows each text."""
        n = len(offsets) - 1
        if len(data):
            first, end = self.cuts(data, offsets)
        else:
            first = end = np.zeros(0, np.int64)
        if len(self.keys) > CACHE_UNITS:
            self.reset()
        seen = self._hashed(data)
        hashes = T.span_hashes(seen, first, end)
        unique, place, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        raw = data.tobytes()
        if not known.all():
            new = place[~known]
            self._learn([raw[a:b] for a, b in zip(first[new].tolist(), end[new].tolist())], unique[~known])
        own = self.rows[np.searchsorted(self.keys, unique)] if len(unique) else np.zeros(0, np.int64)
        rows = own[back]
        same = T.same_spans(seen, first, end, seen, first[place][back], end[place][back])
        same &= T.same_spans(seen, first[place], end[place], self.raw, self.raw_starts[own], self.raw_starts[own + 1])[back]
        other = np.flatnonzero(~same)
        if len(other):
            rows[other] = self._learn([raw[a:b] for a, b in zip(first[other].tolist(), end[other].tolist())], None)
        lengths = self.lengths[rows]
        ranges = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(first, offsets)]
        ids = self.flat[T.ragged(self.starts[rows], lengths)]
        if end_id is None:
            return ids, ranges
        ended = ranges + np.arange(n + 1)
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ranges))] = ids
        return out, ended


class PieceEncoder(UnitEncoder):
    """A sentencepiece model with byte fallback; words (by ASCII white space) are encoded each for itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.reset()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return T.words(data, offsets)[:2]

    def _ids(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1) if units else []

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        return data
