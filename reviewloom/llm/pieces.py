"""Exact tokenizer output from cached pieces of text: each distinct piece is encoded once for a worker.

A piece ends at white space, where no rule of the tokenizer reaches across, so the ids of a text are the ids of its
pieces in order. Texts that hold one of the tokenizer's added tokens (or, where white space makes tokens of its own,
white space outside ASCII) go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from reviewloom.llm.words import kept, span_hashes, utf8

#: White space outside ASCII, as Unicode defines it (fixed values).
WIDE_SPACE = "[\u0085   -     　]"
MAX_ENTRIES, MAX_IDS = 1 << 20, 1 << 22  # the cache of a worker starts anew beyond these
JOINED = 1 << 11  # characters of missing pieces encoded as one text
_LENGTH_BITS = 24


def cuts(column: pa.Array, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, first): the pieces of each row and the index of each row's first.

    spaces: pieces follow the byte-level rule, where a word takes one blank before it and other white space stands
    alone, all but the last character of a run together. Otherwise white space is left out.
    """
    data, rows = utf8(column)
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1] | edge[1:n]
    stop[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if spaces:
        blank = (start > 0) & ~edge[start]
        blank[blank] = data[start[blank] - 1] == 32
        free = space.copy()
        free[start[blank] - 1] = False  # blanks that words take
        runs, ends = free.copy(), free.copy()
        runs[1:] &= ~free[:-1] | edge[1:n]
        ends[:-1] &= ~free[1:] | edge[1:n]
        a, b = np.flatnonzero(runs), np.flatnonzero(ends) + 1
        before_word = ~edge[b]
        before_word[before_word] = ~space[b[before_word]]
        alone = before_word & (b - a > 1)  # the last character stands before a word that took no blank
        start = np.sort(np.concatenate([start - blank, a, b[alone] - 1]))
        end = np.sort(np.concatenate([end, np.where(alone, b - 1, b), b[alone]]))
    return data, start, end, np.searchsorted(start, rows)


class Pieces:
    """Ids of texts through a cache from piece hash to ids, kept in sorted arrays."""

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray] | None = None):
        """table: sorted hashes of frequent pieces and their numbers of ids; used by counts() only."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.separator, self.separator_id = next((t.content, i) for i, t in added.items() if t.special)
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        self.spaces = head.get("normalizer") is None  # white space makes tokens unless it is normalised away
        self.table = table
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "")
        bad = np.zeros(len(column), bool)
        for content in self.added:
            bad |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        if self.spaces:
            bad |= pc.match_substring_regex(column, WIDE_SPACE).to_numpy(zero_copy_only=False)
        return bad

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each piece; many are encoded in one call, with the special token between them and after the last."""
        groups, size = [[]], 0
        for text in texts:
            if size > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(text)
            size += len(text)
        for at in range(0, len(groups), 64):
            joined = [self.separator.join([*g, ""]) for g in groups[at : at + 64] if g]
            for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                stop = np.flatnonzero(ids == self.separator_id)
                yield from (ids[a:b] for a, b in zip([0, *(stop[:-1] + 1)], stop, strict=True))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = data.tobytes() if len(keys) > 64 else None
        texts = [(raw[a:b] if raw else data[a:b].tobytes()).decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids = list(self._encode(texts))
        size = np.array([len(x) for x in ids], np.int64)
        if self.used + size.sum() > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + int(size.sum()) + (1 << 16), np.uint32)])
        at = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + size.sum()] = np.concatenate(ids)
        self.used += int(size.sum())
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.values, (at << _LENGTH_BITS) | size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def _values(self, column: pa.Array, lengths: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its cache value (or, with lengths, its number of ids), and each row's first piece."""
        data, start, end, first = cuts(column, self.spaces)
        distinct, at, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        known = np.zeros(len(distinct), bool)
        value = np.zeros(len(distinct), np.int64)
        if lengths and self.table is not None and len(self.table[0]):
            keys, sizes = self.table
            place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            known = keys[place] == distinct
            value[known] = sizes[place[known]]
        rest = np.flatnonzero(~known)
        if len(self.keys) > MAX_ENTRIES or self.used > MAX_IDS:
            self._clear()
        _, there = self._find(distinct[rest])
        if len(missing := rest[~there]):
            self._learn(distinct[missing], data, start[at[missing]], end[at[missing]])
        found, _ = self._find(distinct[rest])
        value[rest] = found & ((1 << _LENGTH_BITS) - 1) if lengths else found
        return value[which.reshape(-1)], first

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        out = np.zeros(len(column), np.int64)
        whole = self._whole(column)
        for i in np.flatnonzero(whole):
            out[i] = len(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids)
        rest = np.flatnonzero(~whole)
        if len(rest):
            size, first = self._values(column.take(pa.array(rest)) if whole.any() else column, True)
            total = np.concatenate([[0], np.cumsum(size)])
            out[rest] = total[first[1:]] - total[first[:-1]]
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, where each row's start and the last end)."""
        whole = self._whole(column)
        rest = np.flatnonzero(~whole)
        size = np.zeros(len(column), np.int64)
        other = {int(i): np.array(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(whole)}
        value, first = self._values(column.take(pa.array(rest)) if whole.any() else column, False)
        length = value & ((1 << _LENGTH_BITS) - 1)
        total = np.concatenate([[0], np.cumsum(length)])
        size[rest] = total[first[1:]] - total[first[:-1]]
        at = np.repeat((value >> _LENGTH_BITS) - total[:-1], length) + np.arange(total[-1])
        flat = self.pool[at]
        for i, x in other.items():
            size[i] = len(x)
        offsets = np.concatenate([[0], np.cumsum(size)])
        if other:
            out = np.empty(offsets[-1], np.uint32)
            kept = np.ones(offsets[-1], bool)
            for i, x in other.items():
                out[offsets[i] : offsets[i + 1]] = x
                kept[offsets[i] : offsets[i + 1]] = False
            out[kept] = flat
            flat = out
        return flat, offsets


def pieces(path: str, table: tuple[np.ndarray, np.ndarray] | None = None, table_id: int = 0) -> Pieces:
    """The worker's Pieces of this vocabulary, kept between tasks."""
    return kept(("pieces", path, table_id), lambda: Pieces(path, table))
