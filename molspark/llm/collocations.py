"""Phrases whose words stand together more often than chance, per language.

Counting goes from words to pairs, and from pairs of phrases to longer phrases:

1. Each task numbers the words of its texts and keeps them as chunks: the numbers of
   some ten thousand words of one language in a row, with marks between pieces, and the
   words they stand for. Words are counted over all chunks; those too rare to be in
   any phrase drop out, the others get ids by falling frequency.
2. The adjacent ids of a chunk are counted in tiles of 1,024 by 1,024 ids. As ids are
   ranked by frequency, the first tiles are dense: they are counted by address, with
   ``bincount``. Thin tiles and all pairs beyond the first tiles are counted as sorted
   coordinates. The counts of all chunks are added up by Spark.
3. Frequent pairs are ranked in turn, and each place of a chunk gets the id of the pair
   that begins there. Neighbouring pairs share a word, so adjacent ids are phrases of
   three words, which are counted by step 2, and so on.
4. Most places of two frequent phrases in a row hold a longer one that is rare. Where
   there are many, the tasks first add up what falls into each of a fixed number of
   hashed cells. A phrase is at most as frequent as its cell, so only the phrases of
   cells with enough are counted, and each task adds up its own before they move.

No phrase can be more frequent than a part of it, so nothing is lost on the way. The
ids reach the chunks as a table sent to the tasks while it has at most ``SENT_ROWS``
rows, and beyond that by a join with the distinct pairs of each chunk.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from molspark.llm.text import returned, slices, small_batches, text_bytes
from molspark.operators.rank import ordinal
from molspark.staging import stage

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
SENT_ROWS = 400_000
CHUNK_WORDS, COUNT_WORDS, PHRASE_WORDS, TALLIED, SLICE_BYTES = 1 << 17, 1 << 19, 1 << 21, 1 << 20, 2 << 20
CELL_PLACES, PLACES_PER_CELL, CELL_BITS, BLOCK_BITS = 1 << 20, 4, (10, 26), 16  # places from which cells are made, cells per language
TILE, TILES, THIN = 1024, 8, 16  # ids a side, tiles a side, cells per pair from which a tile is thin
_ROWS = 256
_BREAK = 0xFF  # a byte that no UTF-8 text holds
_BREAKS = b".,;:!?\n\x0b\x0c\r"  # fixed values: characters that end a piece
_LOWERED = bytes(_BREAK if b in _BREAKS else ord(chr(b).lower()) if b < 128 else b for b in range(256))
_CUT = re.compile(b"[" + re.escape(_BREAKS) + b"]")


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in slices of some megabytes that end with a piece."""
    while len(text) > SLICE_BYTES:
        found = _CUT.search(text, SLICE_BYTES)
        if not found:
            break
        yield text[: found.end()]
        text = text[found.end() :]
    yield text


class Chunk:
    """Numbers of words in a row; 0 is a mark between pieces."""

    def __init__(self) -> None:
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[bytes([_BREAK])]  # number 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        words = text.translate(_LOWERED).replace(b"\xff", b" \xff ").split()
        words.append(b"\xff")
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        return len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.known))[1:]
        words = pa.array(list(self.known)[1:], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([ids.astype("<i4").tobytes()], pa.binary()), *lists], _CHUNK)


_CHUNK = ["chunk", "lang", "codes", "words", "counts"]


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``chunk, lang, codes, words, counts``; ``codes`` are little-endian 32-bit numbers of ``words``, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: dict[str, Chunk] = {}
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, _ROWS):
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for part in _cut(text or b""):
                    if lang not in open_chunks:
                        open_chunks[lang] = Chunk()
                    size += open_chunks[lang].add(part)
                    if size > CHUNK_WORDS:
                        largest = max(open_chunks, key=lambda x: open_chunks[x].size)
                        chunk = open_chunks.pop(largest)
                        size -= chunk.size
                        yield chunk.row(number, largest)
                        number += 1
        for lang, chunk in open_chunks.items():
            yield chunk.row(number, lang)
            number += 1

    small_batches(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(lambda batches: returned(run(batches)), "chunk bigint, lang string, codes binary, words array<string>, counts array<bigint>")


def pair_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent codes above 0 as distinct ``left << 32 | right``, and how often each stands there."""
    here = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    left, right = codes[here].astype(np.int64) - 1, codes[here + 1].astype(np.int64) - 1
    tile = np.where((left < TILE * TILES) & (right < TILE * TILES), left // TILE * TILES + right // TILE, TILES * TILES).astype(np.uint8)
    order = np.argsort(tile, kind="stable")  # by counting, as the numbers are small
    left, right, ends = left[order], right[order], np.cumsum(np.bincount(tile, minlength=TILES * TILES + 1))
    keys, counts, begin = [], [], 0
    for number, end in enumerate(ends.tolist()):
        a, b, begin = left[begin:end], right[begin:end], end
        if not len(a):
            continue
        if number < TILES * TILES and len(a) * THIN >= TILE * TILE:
            row, column = divmod(number, TILES)
            cells = np.bincount((a - row * TILE) * TILE + b - column * TILE, minlength=TILE * TILE)
            at = np.flatnonzero(cells)
            keys.append((at // TILE + row * TILE + 1) << 32 | at % TILE + column * TILE + 1)
            counts.append(cells[at])
        else:
            key, count = np.unique((a + 1) << 32 | b + 1, return_counts=True)
            keys.append(key)
            counts.append(count)
    return (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def recoded(codes: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of the pair that begins at each place, 0 for others; ``keys`` are sorted. Zeros in a row become one."""
    if len(codes) < 2 or not len(keys):
        return np.zeros(0, np.int32)
    key = codes[:-1].astype(np.int64) << 32 | codes[1:]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out = np.where((keys[at] == key) & (codes[:-1] > 0), ids[at], 0).astype(np.int32)
    return out[np.r_[True, (out[1:] > 0) | (out[:-1] > 0)]]


class _Ids:
    """Ids for the chunks' words or pairs: sent to the tasks if few, else joined to the chunks as ``own`` and ``ids``."""

    def __init__(self, table: DataFrame, held: DataFrame, words: bool) -> None:
        key = "word" if words else "key"
        rows = table.select("lang", key, "id")
        self.words, self.sent = words, None
        if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
            found = rows.toArrow()
            langs, keys, ids = found.column(0).to_pylist(), found.column(1), found.column(2).to_numpy()
            by_lang: dict[str, list[int]] = {}
            for k, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(k)
            self.sent = {}
            for lang, at in by_lang.items():
                own = keys.take(pa.array(at))
                if words:
                    self.sent[lang] = dict(zip(own.to_pylist(), ids[at].tolist()))
                else:
                    own = own.to_numpy()
                    order = np.argsort(own)
                    self.sent[lang] = own[order], ids[at][order]
        else:
            joined = held.join(rows, ["lang", key]).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("own" if words else key).alias("k"), "id"))).alias("found"))
            self.joined = joined.select(F.col("chunk").alias("_chunk"), F.col("found.k").alias("own"), F.col("found.id").alias("ids"))

    def beside(self, held: DataFrame) -> DataFrame:
        """The chunks with what this chunk's codes or pairs are called."""
        if self.sent is not None:
            return held
        return held.join(self.joined, F.col("chunk") == F.col("_chunk"), "left").drop("_chunk")

    def map(self, held: DataFrame, function, schema: str, before: "_Ids | None" = None) -> DataFrame:
        """``function`` of the chunks (number, lang, codes); ``codes`` are named by ``self``, after ``before``."""
        chain = [x for x in (before, self) if x is not None]
        columns, wide = ["chunk", "lang", "codes"], held
        if chain[0].words:
            columns.append("words")
        for number, step in enumerate(chain):
            if step.sent is None:
                wide = step.beside(wide).withColumnsRenamed({"own": f"own{number}", "ids": f"ids{number}"})
                columns += [f"own{number}", f"ids{number}"]
        steps = [(s.words, s.sent) for s in chain]

        def named_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray]]:
            for batch in slices(batches, 1):
                row = {n: batch.column(k)[0] for k, n in enumerate(columns)}
                lang, codes = row["lang"].as_py(), np.frombuffer(row["codes"].as_buffer(), "<i4")
                for number, (words, sent) in enumerate(steps):
                    own, ids = (None, None) if sent is not None else (_numbers(row[f"own{number}"]), _numbers(row[f"ids{number}"]))
                    if words:
                        named = np.zeros(len(row["words"]) + 1, np.int32)
                        if sent is None:
                            named[own] = ids
                        else:
                            get = sent.get(lang, {}).get
                            named[1:] = [get(w, 0) for w in row["words"].values.to_pylist()]
                        codes = named[codes]
                    else:
                        codes = recoded(codes, *(sent.get(lang, (_NONE, _NONE)) if sent is not None else (own, ids)))
                yield row["chunk"].as_py(), lang, codes

        return wide.select(*columns).mapInArrow(lambda batches: returned(function(named_chunks(batches))), schema)


_NONE = np.zeros(0, np.int64)


def _numbers(value: pa.ListScalar) -> np.ndarray:
    return _NONE if value.values is None else value.values.to_numpy()


def _rows(lang: str, keys: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        some = {"key": keys[at : at + (1 << 16)], **{n: v[at : at + (1 << 16)] for n, v in columns.items()}}
        langs = pa.array([lang]).take(pa.array(np.zeros(len(some["key"]), np.int32)))
        yield pa.RecordBatch.from_arrays([langs, *map(pa.array, some.values())], ["lang", *some])


def _counted(held: Iterator[tuple[int, str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``lang, key, n``: the pairs of some chunks of a language at a time."""
    parts: dict[str, list[np.ndarray]] = {}
    size = 0
    for _, lang, codes in held:
        parts.setdefault(lang, []).extend([codes, np.zeros(1, np.int32)])
        size += len(codes)
        if size > COUNT_WORDS:
            largest = max(parts, key=lambda x: sum(map(len, parts[x])))
            codes = np.concatenate(parts.pop(largest))
            keys, counts = pair_counts(codes)
            yield from _rows(largest, keys, n=counts)
            size = sum(len(c) for p in parts.values() for c in p)
    for lang, some in parts.items():
        keys, counts = pair_counts(np.concatenate(some))
        yield from _rows(lang, keys, n=counts)


def _cell(keys: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each pair, of ``1 << bits``."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _tallied(held: Iterator[tuple[int, str, np.ndarray]], promising: dict[str, tuple[int, np.ndarray]] | None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Pairs and their counts, those of a whole task together unless they are too many.

    ``promising`` has for some languages the number of bits and the marked cells; the
    pairs of other cells are passed over.
    """
    parts: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def added(lang: str) -> None:
        keys, counts = pair_counts(np.concatenate(parts.pop(lang)))
        if promising and lang in promising:
            bits, marked = promising[lang]
            cell = _cell(keys, bits)
            good = marked[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0
            keys, counts = keys[good], counts[good]
        if lang in sums:
            keys, at = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
            both = np.zeros(len(keys), np.int64)
            np.add.at(both, at, np.concatenate([sums[lang][1], counts]))
            counts = both
        sums[lang] = keys, counts

    for _, lang, codes in held:
        parts.setdefault(lang, []).extend([codes, np.zeros(1, np.int32)])
        size += len(codes)
        if size > PHRASE_WORDS:
            for own in list(parts):
                added(own)
            size = 0
            while sum(len(k) for k, _ in sums.values()) > TALLIED:
                largest = max(sums, key=lambda x: len(sums[x][0]))
                yield largest, *sums.pop(largest)
    for own in list(parts):
        added(own)
    for lang, (keys, counts) in sums.items():
        yield lang, keys, counts


def _counted_phrases(held: Iterator[tuple[int, str, np.ndarray]], promising: dict[str, tuple[int, np.ndarray]] | None = None) -> Iterator[pa.RecordBatch]:
    """``lang, key, n`` for codes of phrases."""
    for lang, keys, counts in _tallied(held, promising):
        yield from _rows(lang, keys, n=counts)


def _cells(held: Iterator[tuple[int, str, np.ndarray]], bits: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """``lang, block, cells, counts``: what falls into the cells, those above 0 of a block in a row."""
    for lang, keys, counts in _tallied(((c, lang, x) for c, lang, x in held if lang in bits), None):
        cell = _cell(keys, bits[lang])
        order = np.argsort(cell)
        cell, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(counts[order], first) if len(first) else counts
        ends = np.r_[np.flatnonzero(np.diff(cell >> BLOCK_BITS)) + 1, len(cell)]
        for begin, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            if end > begin:
                block = int(cell[begin]) >> BLOCK_BITS
                inside = (cell[begin:end] & (1 << BLOCK_BITS) - 1).astype("<u2")
                row = [[lang], [block], [inside.tobytes()], [sums[begin:end].astype("<i8").tobytes()]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, row)), ["lang", "block", "cells", "counts"])


def _marked(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, block, bits`` from rows sorted by the first two: a bit is set if its cell holds ``least`` or more."""
    at, sums = None, np.zeros(1 << BLOCK_BITS, np.int64)

    def row() -> Iterator[pa.RecordBatch]:
        if (sums >= least).any():
            bits = np.packbits(sums >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([bits], pa.binary())], ["lang", "block", "bits"])

    for batch in slices(batches, 64):
        for lang, block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, block) != at:
                yield from row()
                at = lang, block
                sums[:] = 0
            sums[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<i8")  # a row has each cell once
    yield from row()


def _promising(ids: "_Ids", held: DataFrame, least: int) -> dict[str, tuple[int, np.ndarray]]:
    """Per language with many places the cells that ``least`` or more of them fall into, as bits.

    The number of cells follows that of the places up to 8 MB of bits a language;
    beyond that fewer pairs are passed over, and none is lost.
    """
    places = {r.lang: r.places for r in held.groupBy("lang").agg(F.sum("places").alias("places")).where(F.col("places") > CELL_PLACES).collect()}
    if not places:
        return {}
    low, high = CELL_BITS
    bits = {lang: min(high, max(low, (n // PLACES_PER_CELL).bit_length())) for lang, n in places.items()}
    found = ids.map(held, lambda chunks: _cells(chunks, bits), "lang string, block bigint, cells binary, counts binary")
    dealt = found.repartition("lang", "block").sortWithinPartitions("lang", "block")
    marks = dealt.mapInArrow(lambda batches: returned(_marked(least, batches)), "lang string, block bigint, bits binary")
    out = {lang: (n, np.zeros(max(1 << n, 1 << BLOCK_BITS) // 8, np.uint8)) for lang, n in bits.items()}
    wide = (1 << BLOCK_BITS) // 8
    for row in marks.toLocalIterator():
        out[row.lang][1][row.block * wide : (row.block + 1) * wide] = np.frombuffer(row.bits, np.uint8)
    return out


def _held(held: Iterator[tuple[int, str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``lang, key, chunk``: the distinct pairs of each chunk."""
    for chunk, lang, codes in held:
        keys, _ = pair_counts(codes)
        yield from _rows(lang, keys, chunk=np.full(len(keys), chunk))


def _coded(held: Iterator[tuple[int, str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for chunk, lang, codes in held:
        if codes.any():
            places = int(((codes[:-1] > 0) & (codes[1:] > 0)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([lang]), pa.array([codes.astype("<i4").tobytes()], pa.binary()), pa.array([places])], ["chunk", "lang", "codes", "places"])


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Counts of all frequent words and phrases, and ``lang, n``, the number of all words.

    The first table has ``lang, size, id, f, phrase, left, right``: a phrase of 1 to
    ``max_words`` words that stands ``min_count`` times or more within pieces, and the
    ids of the phrases without its last and first word.
    """
    held = stage(chunks(docs, text_col, lang_col), "chunks")
    own = held.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("own", "x")).select(
        "chunk", "lang", (F.col("own") + 1).alias("own"), F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    totals = stage(held.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
    frequent = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    level = stage(_ranked(frequent, ["word"]).select("lang", "id", "f", "word", F.col("word").alias("phrase")), "words")
    tables = [level.select("lang", F.lit(1).alias("size"), "id", "f", "phrase", F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("right"))]
    ids, before = _Ids(level, own, words=True), None
    for size in range(2, max_words + 1):
        if ids.words:
            count = _counted
        else:
            count = partial(_counted_phrases, promising=_promising(ids, held, min_count))
        pairs = ids.map(held, count, "lang string, key bigint, n bigint", before)
        added = pairs.groupBy("lang", "key").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        ranked = _ranked(added, ["key"]).select("lang", "id", "f", "key", F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("right"))
        first = level.select("lang", F.col("id").alias("left"), F.col("phrase").alias("_first"))
        last = level.select("lang", F.col("id").alias("right"), F.col("word").alias("_last"))
        named = ranked.join(first, ["lang", "left"]).join(last, ["lang", "right"])
        level = stage(named.select("lang", "id", "f", "key", F.col("_last").alias("word"), F.concat_ws(" ", "_first", "_last").alias("phrase"), "left", "right"), "phrases")
        tables.append(level.select("lang", F.lit(size).alias("size"), "id", "f", "phrase", "left", "right"))
        if size == max_words or level.isEmpty():
            break
        pair_ids = _Ids(level, ids.map(held, _held, "lang string, key bigint, chunk bigint", before), words=False)
        if ids.words:
            held = stage(pair_ids.map(held, _coded, "chunk bigint, lang string, codes binary, places bigint", ids), "codes")
        else:
            held = stage(pair_ids.map(held, _coded, "chunk bigint, lang string, codes binary, places bigint"), "codes")
        ids, before = _Same(), None
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out, totals


class _Same(_Ids):
    """The codes are the ids already."""

    def __init__(self) -> None:
        self.words = False

    def map(self, held: DataFrame, function, schema: str, before: _Ids | None = None) -> DataFrame:
        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray]]:
            for batch in slices(batches, 1):
                yield batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), np.frombuffer(batch.column(2)[0].as_buffer(), "<i4")

        return held.select("chunk", "lang", "codes").mapInArrow(lambda batches: returned(function(plain(batches))), schema)


def _ranked(counted: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``id``, from 1 by falling frequency within a language."""
    order = [F.col("f").desc(), *(F.col(k) for k in key)]
    return ordinal(stage(counted, "counted"), order, ["lang"], "id").withColumn("id", F.col("id") + 1)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language whose words stand together most.

    A-Z are lowered; texts are split at ``. , ; : ! ?`` and line ends into pieces, these
    at spaces and tabs into words. A phrase has 2 to ``max_words`` words and stands
    ``a >= min_count`` times within pieces, overlaps included; ``n`` counts all words
    of the language. Each cut of the phrase scores floor(1000 a n / (l r)) with the
    counts of its two parts; the lowest cut counts, of equal ones the first. A phrase
    that always stands in a longer frequent one is left out. Of each language come the
    first ``top`` (None: all), by score, then ``a``, falling, then by the phrase's bytes.

    Null texts are empty, a null language is ``und``. Repeated rows count as often as
    they stand there. Languages without such phrases, and empty tables, give no rows.
    """
    counted, totals = phrases(docs, text_col, lang_col, max_words, min_count)
    found = counted.where("size > 1")
    longer = found.select("lang", (F.col("size") - 1).alias("size"), "f", F.explode(F.array("left", "right")).alias("id"))
    longer = longer.groupBy("lang", "size", "id").agg(F.max("f").alias("most"))
    kept = found.join(longer, ["lang", "size", "id"], "left").where("most IS NULL OR 100 * most < 100 * f").select("lang", "size", F.col("f").alias("a"), "phrase")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("_l"), F.expr("substring_index(phrase, ' ', k - size)").alias("_r")
    )
    part = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(20,0)") * wide("n")).withColumn("down", wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("up DIV down").alias("score"), "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    if top is None:
        keyed = ordinal(rows, [F.desc("score"), F.desc("a"), F.col("phrase")], ["lang"], "rank").withColumn("rank", F.col("rank") + 1)
    else:  # each task keeps its first rows before they move
        keyed = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return keyed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
