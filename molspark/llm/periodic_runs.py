"""Runs of periodically repeated words, found by internal pattern matching.

A run is a maximal stretch of words with smallest period q that is at least 2q words
long. For a period from 2b-1 to 4b-2, b a power of two, the first q words of a run
hold a whole block of b words that begins at a multiple of b, and the block occurs
again q words later. So for each such block it suffices to look for its occurrences
in the window that begins 2b-1 to 4b-2 words on:

- the suffix array of the words, made by doubling, tells the interval of suffixes
  that begin with the block, and keeps for each power of two which stretches of that
  length are equal;
- a wavelet matrix over the suffix array answers range successor queries: the first
  occurrence in that interval at or after a place of the text;
- occurrences nearer to each other than half a block form an arithmetic progression,
  which is taken at once: it ends where the stretch with its difference as period
  ends. If that stretch holds the block too, it gives no new period; of any other
  progression every member gives a candidate period.

Each candidate is verified by how far the words agree to both sides, which the tables
of equal stretches tell in a step per power of two. Periods below 15 are found by
comparing the words with themselves, shifted. All runs are found, none twice.

The texts of a batch are laid end to end with a different mark after each, and are
searched together, so a batch of short texts takes a few hundred array operations.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molspark.llm.text import slices, small_batches, text_bytes

MIN_LENGTH = 12
_DIRECT = 15  # periods below are found by shifting
_ROWS, _BATCH_BYTES, _QUERIES = 512, 4 << 20, 1 << 18


class Suffixes:
    """Suffix array of words whose last one stands nowhere else, and the classes of equal stretches of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        order = np.argsort(words, kind="stable")
        self.array = order.astype(np.int32)
        ranked = words[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        size = np.diff(np.r_[first, n])
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(first, size)
        #: Per power of two: the class of the stretch that begins at each word, by its first place in the array.
        self.classes = [rank]
        #: Per power of two: the classes of two or more stretches, and their sizes.
        self.repeated = [(first[size > 1], size[size > 1])]
        length = 1
        while len(self.repeated[-1][0]):
            first, size = self.repeated[-1]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
            suffix = self.array[at].astype(np.int64)
            key = np.repeat(first, size) * n + rank[suffix + length]
            sort = np.argsort(key, kind="stable")
            suffix, key = suffix[sort], key[sort]
            self.array[at] = suffix
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            rank = rank.copy()
            rank[suffix] = np.repeat(at[begin], size)
            self.classes.append(rank)
            self.repeated.append((at[begin][size > 1], size[size > 1]))
            length *= 2

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on."""
        total, last = np.zeros(len(i), np.int64), len(self.array) - 1
        for power in range(len(self.classes) - 1, -1, -1):
            rank = self.classes[power]
            a, b = np.minimum(i + total, last), np.minimum(j + total, last)
            total += (rank[a] == rank[b]).astype(np.int64) << power
        return total

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before ``i`` and ``j``, where ``i < j``."""
        total = np.zeros(len(i), np.int64)
        for power in range(len(self.classes) - 1, -1, -1):
            rank, a, b = self.classes[power], i - total - (1 << power), j - total - (1 << power)
            total += ((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << power
        return total


class WaveletMatrix:
    """Range successor queries over an array of numbers below ``limit``, for many queries at once."""

    def __init__(self, values: np.ndarray, limit: int) -> None:
        self._levels, self._limit = [], limit
        for bit in range(max(1, (limit - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self._levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value of ``least`` or more among places ``low`` to ``high`` (exclusive); the limit if there is none."""
        none = least >= self._limit
        below, left, right = np.zeros(len(low), np.int64), low, high
        for bit, zeros, split in self._levels:
            a, b = zeros[left], zeros[right]
            up = (least >> bit & 1).astype(bool)
            below += np.where(up, b - a, 0)
            left, right = np.where(up, split + left - a, a), np.where(up, split + right - b, b)
        none |= below >= high - low
        rest, left, right, found = np.where(none, 0, below), low, high, np.zeros(len(low), np.int64)
        for bit, zeros, split in self._levels:
            a, b = zeros[left], zeros[right]
            up = rest >= b - a
            rest = np.where(up, rest - (b - a), rest)
            found |= up.astype(np.int64) << bit
            left, right = np.where(up, split + left - a, a), np.where(up, split + right - b, b)
        return np.where(none, self._limit, found)


def _short(words: np.ndarray, min_length: int) -> list[np.ndarray]:
    """Start, end and period of stretches with a short period."""
    out = []
    for period in range(1, min(_DIRECT, len(words))):
        same = np.flatnonzero(words[period:] == words[:-period])
        if not len(same):
            continue
        cut = np.flatnonzero(np.diff(same) > 1)
        begin, end = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1 + period
        good = end - begin >= max(min_length, 2 * period)
        out.append(np.stack([begin[good], end[good], np.full(good.sum(), period)], axis=1))
    return out


def _candidates(suffixes: Suffixes, power: int, blocks: np.ndarray, low: np.ndarray, high: np.ndarray, tree: WaveletMatrix) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks and later occurrences whose distance may be a period, for blocks of one length."""
    n, size = len(suffixes.array), 1 << power
    last = np.minimum(blocks + 4 * size - 2, n - 1)
    here = tree.successor(low, high, blocks + 2 * size - 1)
    while True:
        going = here <= last
        if not going.any():
            return
        blocks, low, high, last, here = (x[going] for x in (blocks, low, high, last, here))
        after = tree.successor(low, high, here + 1)
        step = after - here
        dense = (after < n) & (step <= size // 2)
        end, own = here.copy(), np.zeros(len(here), bool)
        at = np.flatnonzero(dense)
        if len(at):
            i, j = here[at], after[at]
            stop = j + suffixes.common_after(i, j)
            end[at] = i + (stop - size - i) // step[at] * step[at]
            own[at] = i - suffixes.common_before(i, j) <= blocks[at]
        count = np.where(own, 0, np.where(dense, (np.minimum(end, last) - here) // np.where(dense, step, 1) + 1, 1))
        which = np.repeat(np.arange(len(here)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        yield blocks[which], here[which] + place * step[which]
        here = after
        if len(at):
            here = here.copy()
            here[at] = tree.successor(low[at], high[at], end[at] + 1)


def _long(words: np.ndarray, min_length: int) -> list[np.ndarray]:
    """Start, end and period of stretches with a longer period."""
    suffixes, power, out = Suffixes(words), (_DIRECT + 1).bit_length() - 2, []
    if len(suffixes.repeated) <= power or not len(suffixes.repeated[power][0]):
        return out
    first, size = suffixes.repeated[power]
    ends = np.cumsum(size)
    held = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)  # places of the array with repeated blocks
    tree = WaveletMatrix(suffixes.array[held].astype(np.int64), len(words))
    for power in range(power, len(suffixes.repeated)):
        first, size = suffixes.repeated[power]
        if not len(first):
            break
        blocks = np.arange(0, len(words), 1 << power)
        own = suffixes.classes[power][blocks]
        at = np.minimum(np.searchsorted(first, own), len(first) - 1)
        known = first[at] == own
        blocks, at = blocks[known], at[known]
        low = np.searchsorted(held, first[at])
        for begin in range(0, len(blocks), _QUERIES):
            part = slice(begin, begin + _QUERIES)
            for i, j in _candidates(suffixes, power, blocks[part], low[part], low[part] + size[at[part]], tree):
                start, end = i - suffixes.common_before(i, j), j + suffixes.common_after(i, j)
                good = end - start >= np.maximum(min_length, 2 * (j - i))
                out.append(np.stack([start[good], end[good], (j - i)[good]], axis=1))
    return out


def runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows of start, end (exclusive) and period of all runs, in that order; the last word must stand nowhere else."""
    found = [np.zeros((0, 3), np.int64)]
    if len(words) > 1:
        found += _short(words, min_length) + _long(words, min_length)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    rows = rows[new]  # of equal stretches the smallest period
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, a mark after each text, and where each text begins; equal words have equal numbers."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    parts, starts, at = [], [], 0
    for k, text in enumerate(texts):
        words = text.split()
        starts.append(at)
        parts += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.array([-1 - k])]
        at += len(words) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([*starts, at])


def _searched(texts: list[bytes], min_length: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Per text its words' number, its runs, and the words that repeat nothing, joined by spaces."""
    numbers, starts = _numbers(texts)
    found = runs(numbers, min_length)
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 1], -1)
    kept = np.cumsum(gone) == 0
    cuts = np.searchsorted(found[:, 0], starts)
    own, left = [], []
    for k, text in enumerate(texts):
        rows = found[cuts[k] : cuts[k + 1]].copy()
        rows[:, :2] -= starts[k]
        own.append(rows)
        words = text.split()
        left.append(b" ".join(compress(words, kept[starts[k] : starts[k + 1] - 1].tolist()) if len(rows) else words))
    return (np.diff(starts) - 1).tolist(), own, left


def _groups(texts: list[bytes]) -> Iterator[slice]:
    """Slices of texts of a few megabytes together; a longer text is alone."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > _BATCH_BYTES:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(text)
    yield slice(begin, len(texts))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``id_col, n_words, runs, collapsed``: one row per row of ``docs``.

    ``runs`` is an array of ``start, length, period`` in words, by start, then period:
    every maximal stretch of at least ``min_length`` words and twice its smallest
    period. ``collapsed`` is the text without the words that a run repeats, that is,
    those after its first period, joined by single spaces. Words are runs of bytes
    other than ASCII white space and count from 0. Null, empty and blank texts have no
    words, no runs and an empty rest. Null ids stay null, repeated rows repeat, other
    columns are not read; an empty table gives an empty one. A text is searched whole,
    in memory of some 4 bytes per word and power of two up to its longest repeat.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            for part in _groups(texts):
                counts, found, left = _searched(texts[part], min_length)
                rows = np.concatenate(found)
                ends = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(c) for c in (rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2])], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(left, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = chosen.mapInArrow(search, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
