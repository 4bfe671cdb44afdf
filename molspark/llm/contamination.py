"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are the stated query set. They are cut into passages of at most
256 words and taken in blocks of a bounded number of words, each compared with
every document. A block travels to the tasks; the documents are never shuffled,
so neither a frequent passage nor a frequent source makes a task longer.

One scan of the texts per block. Every n-gram of a passage is a seed, however many
documents hold it: a copy counts by itself, so one that a third of the corpus
repeats, edited or in part, is found like a single one. A window is cut around each
run of seed hits on nearby diagonals. Windows that share too few words with their
passage for any alignment to reach the threshold are left out, which loses nothing;
the others are aligned word by word. Words are runs of letters and digits, A-Z
lowered, so punctuation and case do not hide a copy, and single characters in scripts
without blanks; edits, insertions and left-out words cost score, not the match. Items
of 3 to 7 words tell too little for that and must be found word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molspark.llm.text import WordHasher, gram_hashes, slices, small_batches, text_bytes, text_udf

GRAM, SHORT_WORDS, PASSAGE, STEP, THRESHOLD = 3, 8, 256, 128, 0.5
EXCERPT = 100
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 500_000
_CELLS, _ROWS, _HITS = 1 << 20, 512, 1 << 18


def passages(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, words``: word hashes of each passage of the items; items under 3 words have none."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows, words = [], []
            for row, text in enumerate(text_bytes(batch.column(1))):
                own = hasher(text).view(np.int64)
                last = max(0, len(own) - PASSAGE + STEP - 1) // STEP
                for k in range(last + 1 if len(own) >= GRAM else 0):
                    begin = min(k * STEP, max(0, len(own) - PASSAGE))
                    rows.append(row)
                    words.append(own[begin : begin + PASSAGE])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.list_(pa.int64()))], ["item", "words"]
            )

    chosen = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return chosen.mapInArrow(run, f"item {kind}, words array<bigint>").distinct()


@dataclass
class Block:
    """Some passages, and the look-ups of their n-grams and words."""

    items: list
    words: list[np.ndarray]
    grams: np.ndarray = field(init=False)  # sorted, distinct
    first: np.ndarray = field(init=False)  # per gram number: where its holders begin, and the end
    passage: np.ndarray = field(init=False)  # of each holder
    position: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)
    vocabulary: np.ndarray = field(init=False)  # sorted, distinct
    filter: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        found = [gram_hashes(w, GRAM) for w in self.words]
        own = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.grams, number = np.unique(own, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.first = np.searchsorted(number[order], np.arange(len(self.grams) + 1))
        self.passage = np.repeat(np.arange(len(found)), [len(f) for f in found])[order]
        self.position = np.concatenate([np.arange(len(f)) for f in found])[order] if found else np.zeros(0, np.int64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.vocabulary = np.unique(np.concatenate(self.words)) if found else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.grams & np.uint64(0xFFFFF)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document and numbers of the block's grams found there."""
        own = gram_hashes(words, GRAM)
        at = np.flatnonzero(self.filter[own & np.uint64(0xFFFFF)])
        number = np.searchsorted(self.grams, own[at])
        good = self.grams[np.minimum(number, len(self.grams) - 1)] == own[at] if len(self.grams) else np.zeros(0, bool)
        return at[good], number[good]

    def spans(self, words: np.ndarray) -> np.ndarray:
        """Rows of passage, band of diagonals, lowest and highest diagonal: the hits of every n-gram in a document."""
        at, number = self.hits(words)
        sizes = self.first[number + 1] - self.first[number]
        ends = np.cumsum(sizes)
        found, low = np.zeros((0, 4), np.int64), 0
        while low < len(at):  # in parts, to bound what frequent n-grams of many passages take
            done = ends[low] - sizes[low]
            high = max(low + 1, int(np.searchsorted(ends, done + _HITS, side="right")))
            size = sizes[low:high]
            holder = np.arange(size.sum()) + np.repeat(self.first[number[low:high]] - (ends[low:high] - size - done), size)
            passage, diagonal = self.passage[holder], np.repeat(at[low:high], size) - self.position[holder]
            band = diagonal // (self.sizes[passage] // 2 + 16)
            found = _merged(np.concatenate([found, np.stack([passage, band, diagonal, diagonal], axis=1)]))
            low = high
        return found


def _merged(spans: np.ndarray) -> np.ndarray:
    """One row per passage and band."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])
    return np.column_stack([spans[starts, :2], np.minimum.reduceat(spans[:, 2], starts), np.maximum.reduceat(spans[:, 3], starts)])


def align(queries: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each query with its window, and where it ends in the window (exclusive).

    All alignments of the call advance together, one query word at a time.
    """
    best, ends = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    order = sorted(range(len(queries)), key=lambda i: (len(queries[i]), len(windows[i])))
    while order:
        width, size = 1, 0
        while size < len(order) and max(width, len(windows[order[size]])) * (size + 1) <= max(_CELLS, len(windows[order[0]])):
            width = max(width, len(windows[order[size]]))
            size += 1
        group, order = order[: max(1, size)], order[max(1, size) :]
        width = max(len(windows[i]) for i in group)
        height = max(len(queries[i]) for i in group)
        query, window = np.zeros((len(group), height), np.uint64), np.zeros((len(group), width), np.uint64)
        real_q, real_w = np.zeros(query.shape, bool), np.zeros(window.shape, bool)
        for row, i in enumerate(group):
            query[row, : len(queries[i])], real_q[row, : len(queries[i])] = queries[i], True
            window[row, : len(windows[i])], real_w[row, : len(windows[i])] = windows[i], True
        ramp = np.arange(width) * -GAP
        score, top, end = np.zeros((len(group), width + 1), np.int32), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k in range(height):
            same = (window == query[:, k : k + 1]) & real_w & real_q[:, k : k + 1]
            step = np.maximum(np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP), 0)
            step = np.maximum.accumulate(step + ramp, axis=1) - ramp
            score[:, 1:] = step
            at = step.argmax(axis=1)
            now = step[np.arange(len(group)), at]
            better = now > top
            top, end = np.where(better, now, top), np.where(better, at + 1, end)
        best[group], ends[group] = top, end
    return best, ends


class Scanner:
    """Finds the copies of a block's passages in the documents of a batch."""

    def __init__(self, block: Block, threshold: float) -> None:
        self.block, self.threshold, self.hasher = block, threshold, WordHasher()
        self.numbers = [np.searchsorted(block.vocabulary, w) for w in block.words]
        self.seen, self.turn = np.zeros(len(block.vocabulary) + 1, np.int64), 0

    def least(self, passage: int) -> float:
        """The alignment score from which a passage counts as found; a short one has to stand there word for word."""
        if len(self.block.words[passage]) < SHORT_WORDS:
            return MATCH * len(self.block.words[passage])
        return self.threshold * MATCH * min(EXCERPT, len(self.block.words[passage]))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Passage and window (begin, end) around its seed hits, if the window holds enough of its words."""
        out, spans, known = [], self.block.spans(words).tolist(), self.block.vocabulary
        if spans:
            number = np.minimum(np.searchsorted(known, words), len(known) - 1)
            number = np.where(known[number] == words, number, len(known))
        for passage, _, low, high in spans:
            size = len(self.block.words[passage])
            pad = size // 2 + 16
            begin, end = max(0, low - pad), min(len(words), high + size + pad)
            self.turn += 1
            self.seen[number[begin:end]] = self.turn
            if MATCH * np.count_nonzero(self.seen[self.numbers[passage]] == self.turn) >= self.least(passage):
                out.append((passage, begin, end))
        return out

    def __call__(self, texts: list[bytes | None]) -> list[tuple[int, int, float, int, int]]:
        """Row of the batch, passage, score, first and last word (exclusive); the best of each row and item."""
        rows, queries, windows = [], [], []
        for row, text in enumerate(texts):
            words = self.hasher(text)
            for passage, begin, end in self.candidates(words):
                rows.append((row, passage, begin))
                queries.append(self.block.words[passage])
                windows.append(words[begin:end])
        score, ends = align(queries, windows)
        good = [i for i, (_, passage, _) in enumerate(rows) if score[i] >= self.least(passage)]
        back, size = align([queries[i][::-1] for i in good], [windows[i][: ends[i]][::-1] for i in good])
        best: dict[tuple, tuple] = {}
        for k, i in enumerate(good):
            row, passage, begin = rows[i]
            share = float(score[i]) / (MATCH * len(queries[i]))
            found = (row, passage, share, begin + int(ends[i] - size[k]), begin + int(ends[i]))
            key = (row, self.block.items[passage])
            if key not in best or (-found[2], found[3]) < (-best[key][2], best[key][3]):
                best[key] = found
        return sorted(best.values())


def blocks(benchmark: DataFrame, item_col: str, block_words: int) -> Iterator[Block]:
    """Blocks of about ``block_words`` words of whole items."""
    found = passages(benchmark, item_col).withColumn("part", F.xxhash64("item"))
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // block_words)
    for number in range(count):
        rows = found.where(F.pmod("part", F.lit(count)) == number).select("item", "words").orderBy("item", "words").collect()
        yield Block([r.item for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``id_col, item_col, score, start_word, end_word``: one row per document row and test item found in it.

    ``score`` is the alignment score of the item's best passage over the score of
    a perfect copy; rows from ``threshold`` are returned, and of passages over 100
    words those that reach ``threshold`` of 100 words, so that a long excerpt of a
    long item counts (50 unbroken words by default). Words count from 0, the
    end is exclusive. Items of 3 to 7 words are found only word for word. Null or empty
    texts, and items with a null id or fewer than 3 words, give no row; a null document id stays null; repeated document rows give
    repeated rows, repeated items one. Other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"_doc {kind}, _item {item_kind}, score double, start_word int, end_word int"
    parts = []
    for block in blocks(benchmark, item_col, block_words):
        parts.append(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).mapInArrow(_finder(block, threshold, schema), schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema.replace("_doc", id_col).replace("_item", item_col))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnsRenamed({"_doc": id_col, "_item": item_col})


def _finder(block: Block, threshold: float, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block, threshold)
        for batch in slices(batches, _ROWS):
            found = scanner(text_bytes(batch.column(1)))
            if not found:
                continue
            rows, passage, score, start, end = map(list, zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([block.items[p] for p in passage]),
                    pa.array(score, pa.float64()),
                    pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()),
                ],
                ["_doc", "_item", "score", "start_word", "end_word"],
            )

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with all their columns and without a shuffle.

    Null and empty texts hold no item and stay, as do repeated rows; an empty table
    gives an empty one. Texts of any length are searched whole. Only a flag per row
    comes back from Python, and one worker per task searches all blocks in turn.
    """
    small_batches(docs.sparkSession)
    out = docs
    for block in blocks(benchmark, item_col, block_words):
        scanners: list[Scanner] = []

        def found(texts: list[bytes | None], block: Block = block, scanners: list[Scanner] = scanners) -> dict[str, list]:
            if not scanners:
                scanners.append(Scanner(block, threshold))
            flags = [False] * len(texts)
            for row, *_ in scanners[0](texts):
                flags[row] = True
            return {"found": flags}

        out = out.where(~text_udf(found, {"found": "boolean"})(text_col)["found"])
    return out
