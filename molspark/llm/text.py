"""Texts in Arrow batches: passing rows through a function of the whole text, and fast word hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_BYTES = 4 << 20
_PIECE, _ROWS = 1 << 20, 512
_ARROW = {
    "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}


def small_batches(spark: SparkSession) -> None:
    """Limits what Spark sends to a Python worker at once; a batch, its copies and its results lie in memory outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def returned(results: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results; then the worker, which Spark keeps for later tasks, gives back memory that it no longer uses."""
    yield from results
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text of a string column."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, to bound what their texts take in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_text(
    docs: DataFrame,
    text_col: str,
    keep: list[str],
    function: Callable[[list[bytes | None]], dict[str, list]],
    fields: dict[str, str],
) -> DataFrame:
    """``keep`` columns as ``_0, _1, ...`` in order, then one column per entry of ``fields`` (name: type).

    ``function`` gets some texts of an Arrow batch and returns a list per field.
    Numbered names keep any column of ``docs`` from clashing with a field.
    """
    small_batches(docs.sparkSession)
    names = [f"_{i}" for i in range(len(keep))]
    within = keep.index(text_col) if text_col in keep else len(keep)
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    if within == len(keep):
        columns.append(F.col(f"`{text_col}`").alias("_text"))
    chosen = docs.select(*columns)
    kinds = [f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names] + [f"{n} {t}" for n, t in fields.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            out = function(text_bytes(batch.column(within)))
            added = [pa.array(out[n], _ARROW[t]) for n, t in fields.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], [*names, *fields])

    return chosen.mapInArrow(run, ", ".join(kinds))


def text_udf(function: Callable[[list[bytes | None]], dict[str, list]], fields: dict[str, str]) -> Callable[[str], Column]:
    """A column function of a text column: a struct of ``fields`` (name: type), all that comes back from Python.

    ``function`` is that of :func:`per_text`; the other columns of a row stay in the JVM.
    """
    names = list(fields)

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(texts)), _ROWS):
            out = function(text_bytes(texts.slice(at, _ROWS)))
            parts.append(pa.StructArray.from_arrays([pa.array(out[n], _ARROW[t]) for n, t in fields.items()], names=names))
        return pa.concat_arrays(parts)

    kind = f"struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>"
    made = F.arrow_udf(run, returnType=kind)
    return lambda name: made(F.col(f"`{name}`"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: First and last code of scripts without blanks (words of one character), then of their punctuation.
_SINGLE = (
    (0x0E00, 0x0E7F, True), (0x3040, 0x30FF, True), (0x3400, 0x9FFF, True), (0xF900, 0xFAFF, True),
    (0x3000, 0x303F, False), (0xFF01, 0xFF0F, False), (0xFF1A, 0xFF20, False),
)


class WordHasher:
    """Hashes of the words of a text: runs of letters and digits, A-Z lowered.

    All bytes from 0x80 count as letters, but in scripts without blanks (Han, Kana, Thai)
    each character is a word, and their punctuation is none. A word's hash is a polynomial of its bytes
    modulo 2**64, taken for all words at once from running sums, then mixed.
    """

    _base = 0x2545F4914F6CDD1D

    def __init__(self) -> None:
        values = np.zeros(256, dtype=np.uint64)
        for byte in range(256):
            char = bytes([byte]).lower()
            if byte >= 128 or char.isalnum():
                values[byte] = int.from_bytes(char, "big") * 0x9E3779B97F4A7C15 % 2**64 | 1
        self._values, self._powers = values, (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def _grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[0]) < n:
            size = max(n, 1 << 16)
            made = []
            for base in (self._base, pow(self._base, -1, 2**64)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self._powers = made[0], made[1]
        return self._powers

    def __call__(self, text: bytes | None) -> np.ndarray:
        text, at, out = text or b"", 0, []
        while len(text) - at > _PIECE:
            end = at + _PIECE
            while end < len(text) and self._values[text[end]]:
                end += 1
            out.append(self._hash(text[at:end]))
            at = end
        out.append(self._hash(text[at:]))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _hash(self, text: bytes) -> np.ndarray:
        values = self._values[np.frombuffer(text, dtype=np.uint8)]
        inside = np.zeros(len(values) + 2, dtype=np.int8)
        inside[1:-1] = values != 0
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) and raw.max() >= 0xE0:
            starts, ends = self._characters(raw, values, inside)
        else:
            edges = np.flatnonzero(np.diff(inside))
            starts, ends = edges[::2], edges[1::2]
        powers, inverse = self._grown(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers[: len(values)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * inverse[starts])


    @staticmethod
    def _characters(raw: np.ndarray, values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words, each character of a script without blanks being one; its punctuation leaves ``inside``."""
        lead = np.flatnonzero(raw[: max(0, len(raw) - 2)] >= 0xE0)
        code = (raw[lead].astype(np.int64) & 15) << 12 | (raw[lead + 1].astype(np.int64) & 63) << 6 | raw[lead + 2] & 63
        lead, code = lead[raw[lead] < 0xF0], code[raw[lead] < 0xF0]
        for low, high, word in _SINGLE:
            at = lead[(code >= low) & (code <= high)]
            if word:
                cut = at if low == _SINGLE[0][0] else np.concatenate([cut, at])
            else:
                for step in range(3):
                    values[at + step], inside[at + step + 1] = 0, 0
        border = np.zeros(len(raw) + 1, bool)
        border[cut] = border[cut + 3] = True
        here = inside[1:-1].astype(bool)
        starts = np.flatnonzero(here & (~inside[:-2].astype(bool) | border[:-1]))
        ends = np.flatnonzero(here & (~inside[2:].astype(bool) | border[1:])) + 1
        return starts, ends


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words from the words' hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return _mixed(total)
