"""SimHash near-duplicates, found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 23, 23 and 18 bits (the last
one padded with zeros). The binary Golay code of length 23 is perfect: each word
of 23 bits lies within 3 bits of exactly one code word. Two words that differ in
one bit at most therefore meet as follows: one is known by its own code word, the
other by every code word within 4 bits of it, of which there are one or six.

Of three or fewer differing bits, leave out the segment that holds most: each of
the two others holds one at most. So fingerprints link only if they share, for
one of three segment pairs, the code words of both segments. One side of the
join has 3 keys per fingerprint, the other at most 3 x 36; every shared key is
verified by the number of differing bits.
"""

from __future__ import annotations

from itertools import combinations
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from molspark.llm.graph import components
from molspark.staging import stage

SHINGLE, SEED, DISTANCE = 3, 42, 3
_BITS, _CHECKS = 23, 11
_GENERATOR = 0b110001110101  # of the binary Golay code, a fixed value
_SEGMENTS = ((0, 23), (23, 23), (46, 18))  # lowest bit, width
_BLOCK = 1 << 16


def _remainders() -> np.ndarray:
    """Remainder of each single bit by the generator polynomial."""
    out = []
    for bit in range(_BITS):
        word = 1 << bit
        for top in range(_BITS - 1, _CHECKS - 1, -1):
            if word >> top & 1:
                word ^= _GENERATOR << (top - _CHECKS)
        out.append(word)
    return np.array(out, dtype=np.int64)


def _nearby_errors() -> np.ndarray:
    """Per remainder the error patterns of up to 4 bits that lead to code words; -1 fills."""
    single = _remainders()
    table = np.full((1 << _CHECKS, 6), -1, dtype=np.int64)
    used = np.zeros(1 << _CHECKS, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(_BITS), weight):
            at = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            if weight < 4 or used[at] and table[at, 0].item().bit_count() == 3:
                table[at, used[at]] = sum(1 << b for b in bits)
                used[at] += 1
    return table


_SINGLE, _ERRORS = _remainders(), _nearby_errors()


def code_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the code words within 4 bits of each 23-bit word, nearest first; -1 fills six columns."""
    rest = np.zeros(len(words), dtype=np.int64)
    for bit in range(_BITS):
        rest ^= np.where(words >> bit & 1, _SINGLE[bit], 0)
    errors = _ERRORS[rest]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> _CHECKS)


def _nearest_places() -> np.ndarray:
    """Per remainder the places of the up to 3 bits that lead to the nearest code word; ``_BITS`` fills."""
    table = np.full((3, 1 << _CHECKS), _BITS, dtype=np.int32)
    for rest, error in enumerate(_ERRORS[:, 0].tolist()):
        for k, bit in enumerate(b for b in range(_BITS) if error >> b & 1):
            table[k, rest] = bit
    return table


_PLACES, _NEAREST, _SINGLE_32 = _nearest_places(), _ERRORS[:, 0].astype(np.int32), _SINGLE.astype(np.int32)


def likely_codes(sums: np.ndarray, flips: int = 5) -> np.ndarray:
    """Indices (12 bits) of the likeliest code words of segments given as signed sums, 23 a row.

    A bit is set if its sum is positive; changing it costs the sum's size. All
    choices among the ``flips`` cheapest bits are changed and decoded to the nearest
    code word, and the cheapest code word wins (Chase's second algorithm). It is
    nearly always the cheapest of all.
    """
    n, power = len(sums), np.int32(1) << np.arange(_BITS, dtype=np.int32)
    cost = np.zeros((n, _BITS + 1), np.float32)
    np.abs(sums, out=cost[:, :_BITS])
    hard = sums > 0
    words = (hard * power).sum(axis=1, dtype=np.int32)
    cheap = np.argpartition(cost[:, :_BITS], flips, axis=1)[:, :flips]
    price = np.take_along_axis(cost, cheap, 1)
    rest = np.bitwise_xor.reduce(hard * _SINGLE_32, axis=1)[None]
    paid, changed = np.zeros((1, n), np.float32), np.zeros((1, n), np.int32)
    for k in range(flips):
        rest = np.concatenate([rest, rest ^ _SINGLE_32[cheap[:, k]]])
        paid = np.concatenate([paid, paid + price[:, k]])
        changed = np.concatenate([changed, changed ^ power[cheap[:, k]]])
    flat, row = cost.ravel(), np.arange(0, n * (_BITS + 1), _BITS + 1, dtype=np.int32)
    for places in _PLACES:  # a bit changed twice is paid twice, but the same word is also reached without
        paid += flat.take(places.take(rest, mode="clip") + row, mode="clip")
    best, at = paid.argmin(axis=0), np.arange(n)
    return (words ^ changed[best, at] ^ _NEAREST[rest[best, at]]) >> _CHECKS


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a whole text, as a signed number.

    A-Z are lowered, words are runs of bytes other than ASCII white space, and
    shingles are three words joined by a space, repeats included; a text of one or
    two words is one shingle. Null, empty or blank texts give 0. A bit is set if it
    is set in more than half of the shingles' hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, n, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        block = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])]
        raw = np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` for every row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def _keys(fps: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the fingerprints' positions; ``near``: of all nearby code words, else of the nearest ones."""
    unsigned = fps.view(np.uint64)
    codes = [code_indices((unsigned >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)) for low, width in _SEGMENTS]
    codes = codes if near else [c[:, :1] for c in codes]
    keys, rows = [], []
    for number, (i, j) in enumerate(combinations(range(3), 2)):
        left, right = codes[i][:, :, None], codes[j][:, None, :]
        key = number << 24 | left << 12 | right
        row, *_ = hit = np.nonzero((left >= 0) & (right >= 0))
        keys.append(key[hit])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(fps: DataFrame, near: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048]
                keys, rows = _keys(part, near)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Distinct ``a < b`` of different fingerprints at most 3 bits apart; ``fps`` has distinct ``fp``."""
    own = _keyed(fps, near=False).withColumnRenamed("fp", "other")
    near = _keyed(fps, near=True)
    close = (own.key == near.key) & (own.other != near.fp) & (F.bit_count(own.other.bitwiseXOR(near.fp)) <= DISTANCE)
    return near.join(own, close).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, fingerprint, component_id``.

    Only the id and the text are read. Equal fingerprints are collapsed before the
    search, so copies cost nothing there; links of different fingerprints are all
    found. ``component_id`` is the smallest id among the rows reachable over links.
    Null, empty and blank texts have fingerprint 0 and link like any other. A row
    with a null id gets the component of its fingerprint, which is null if no row
    there has an id. Repeated rows stay repeated; an empty table gives an empty one.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = stage(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "groups")
    labels = components(links(groups)).withColumnRenamed("node", "fp")
    labelled = groups.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = stage(labelled.join(firsts, "label").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that start their component; its columns are unchanged.

    Of each component the row with the smallest id stays, once even if it is
    repeated. Rows with a null id cannot be named and stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    first = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(first, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
