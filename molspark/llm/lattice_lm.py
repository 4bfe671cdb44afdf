"""Language-model scores: the likelihood of a text over all its segmentations into subwords.

A word's lattice has one arc per vocabulary piece that fits between two of its
characters. With a weight per piece, the forward recursion in log space sums over
all paths, that is over all segmentations; a text's probability is the product
over its words and the end. The pieces and their first weights come from an
existing vocabulary. Two expectation-maximisation steps then fit the weights to the
training words: forward and backward sums give each piece's expected count.

Words are counted once over all texts, and lattices are run once per distinct
word. To score texts, the most frequent words (a table of bounded size) travel to
the tasks; the other words of each text are joined by word. Frequent words thus
never meet in one task, whatever share of the corpus they make.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window, functions as F

from molspark.llm.text import slices, text_bytes
from molspark.staging import stage

FREQUENT_WORDS, WORD_BYTES = 200_000, 64  # words that travel to the tasks, and their length at most
ZIPF_SHIFT, SMOOTHING, STEPS = 2.7, 0.1, 2
_SPACE, _END = "▁", "</s>"
_STEP, _CELLS = 0x9E3779B97F4A7C15, 1 << 15
_ROWS, _KEPT_WORDS = 512, 100_000


def read_vocabulary(path: str) -> dict[str, float]:
    """Natural logarithms of the pieces' weights, from a SentencePiece file.

    Unigram scores are logarithms already. Scores of a merge vocabulary are the
    merges' ranks, negated: these become weights by Zipf's law. Byte pieces, which
    stand in for characters without a piece, rank behind all others, as do the end and
    a lone word start where it is unused. Other unused and control pieces are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(size)
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.get_score(i) < -1e8)
    }
    if all(float(s).is_integer() for s in scores.values()):
        scores = {p: -math.log(ZIPF_SHIFT - s) for p, s in scores.items()}
    last = min(scores.values(), default=0.0)
    scores |= {model.id_to_piece(i): last for i in range(size) if model.is_byte(i)} | {_SPACE: scores.get(_SPACE, last), _END: last}
    return _normalised(scores)


def _normalised(logs: dict[str, float]) -> dict[str, float]:
    top = max(logs.values())
    total = top + math.log(sum(math.exp(v - top) for v in logs.values()))
    return {p: v - total for p, v in logs.items()}


class Lattice:
    """Sums over the segmentations of words, for many words of equal length at a time.

    A character without a piece takes the pieces of its bytes. Pieces are found by
    rolling 64-bit hashes of the characters.
    """

    def __init__(self, logs: dict[str, float]) -> None:
        self.pieces = list(logs)
        self.logs = np.array(list(logs.values()))
        self._number = {p: i for i, p in enumerate(self.pieces)}
        self._longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self._hashes, self._order = hashes[order], order
        self._maybe = np.zeros(1 << 18, dtype=bool)
        self._maybe[hashes >> np.uint64(46)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for char in piece:
            h = (h + ord(char) + 1) * _STEP % 2**64
        return h

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the pieces."""
        rows = np.flatnonzero(self._maybe[hashes >> np.uint64(46)])
        at = np.searchsorted(self._hashes, hashes[rows])
        good = self._hashes[np.minimum(at, len(self._hashes) - 1)] == hashes[rows]
        return rows[good], self._order[at[good]]

    def _arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs by their start: from, to, rows that have one, its logarithm, and the piece (or minus one less than the character)."""
        width = codes.shape[1]
        for i in range(width):
            hashes = np.zeros(len(codes), dtype=np.uint64)
            for j in range(i + 1, min(width, i + self._longest) + 1):
                hashes = (hashes + codes[:, j - 1] + np.uint64(1)) * np.uint64(_STEP)
                rows, pieces = self._find(hashes)
                if j == i + 1 and len(rows) < len(codes):
                    lone = np.setdiff1d(np.arange(len(codes)), rows)
                    chars, which = np.unique(codes[lone, i], return_inverse=True)
                    yield i, j, lone, np.array([self.logs[self._bytes(c)].sum() for c in chars.tolist()])[which], -1 - codes[lone, i].astype(np.int64)
                if len(rows):
                    yield i, j, rows, self.logs[pieces], pieces

    def _bytes(self, code: int) -> list[int]:
        return [self._number[f"<0x{b:02X}>"] for b in chr(code).encode()]

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and characters of words of equal length, in blocks of a bounded number of characters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            step = max(1, _CELLS // width)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                text = "".join(_SPACE + words[i] for i in part.tolist())
                yield part, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(len(part), width)

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural logarithms of the words' probabilities over all segmentations."""
        out = np.zeros(len(words))
        for at, codes in self._groups(words):
            ahead = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
            ahead[0] = 0.0
            for i, j, rows, log, _ in self._arcs(codes):
                ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + log)
            out[at] = ahead[-1]
        return out

    def expect(self, words: list[str], times: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected number of each piece in so many copies of each word."""
        for at, codes in self._groups(words):
            ahead = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
            behind = ahead.copy()
            ahead[0] = behind[-1] = 0.0
            arcs = []
            for arc in self._arcs(codes):
                i, j, rows, log, _ = arc
                ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + log)
                arcs.append(arc)
            used, shares = [], []
            for i, j, rows, log, pieces in reversed(arcs):
                behind[i, rows] = np.logaddexp(behind[i, rows], behind[j, rows] + log)
                share = times[at][rows] * np.exp(ahead[i, rows] + log + behind[j, rows] - ahead[-1, rows])
                if pieces[0] >= 0:
                    used.append(pieces)
                    shares.append(share)
                else:
                    chars, which = np.unique(-1 - pieces, return_inverse=True)
                    for code, value in zip(chars.tolist(), np.bincount(which, share).tolist()):
                        np.add.at(counts, self._bytes(code), value)
            if used:
                counts += np.bincount(np.concatenate(used), np.concatenate(shares), len(counts))


def word_counts(docs: DataFrame, text_col: str, held_out: Column) -> DataFrame:
    """``word, c, seen``: every word of the texts (A-Z lowered), its count in those not held out, and in all."""

    def flush(counts: dict[bool, Counter]) -> Iterator[pa.RecordBatch]:
        for held, found in counts.items():
            n = pa.array(found.values(), pa.int64())
            words = pa.array(found.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(np.zeros(len(found), np.int64)) if held else n, n], ["word", "c", "seen"])
            found.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in slices(batches, _ROWS):
            for text, held in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                counts[held].update((text or b"").lower().split())
            if sum(map(len, counts.values())) > _KEPT_WORDS:
                yield from flush(counts)
        yield from flush(counts)

    found = docs.select(F.col(text_col).alias("text"), held_out.alias("held")).mapInArrow(run, "word string, c bigint, seen bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit(words: DataFrame, ends: int, logs: dict[str, float]) -> dict[str, float]:
    """Weights after one expectation-maximisation step over the words with ``c`` above 0 and ``ends`` ends of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(logs)
        counts = np.zeros(len(logs))
        for batch in batches:
            lattice.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), counts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["piece", "expected"])

    expected = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected"))
    pieces = list(logs)
    counts = dict.fromkeys(pieces, SMOOTHING) | {_END: SMOOTHING + ends}
    for piece, value in expected.collect():  # at most one row per piece of the vocabulary
        counts[pieces[piece]] += value
    return _normalised({p: math.log(v) for p, v in counts.items()})


def _least_count(words: DataFrame) -> int:
    """The least count that at most ``FREQUENT_WORDS`` words reach."""
    falling = Window.orderBy(F.desc("seen"))  # a row per distinct count, of which there are few
    reached = words.groupBy("seen").agg(F.count("*").alias("n")).withColumn("reached", F.sum("n").over(falling))
    return reached.where(F.col("reached") <= FREQUENT_WORDS).agg(F.coalesce(F.min("seen"), F.lit(2**62))).first()[0]


def _word_scores(words: DataFrame, logs: dict[str, float]) -> DataFrame:
    """Adds ``log10``, the word's own score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(logs)
        for batch in batches:
            scores = lattice.forward(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], ["word", "c", "seen", "log10"])

    return words.mapInArrow(run, "word string, c bigint, seen bigint, log10 double")


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are words (runs of characters other than ASCII white space, A-Z lowered)
    and one end. The model and the counts learn from rows whose ``held_out`` is not
    true. ``base_score`` is the add-one unigram score over tokens, ``score`` the
    lattice's, both as base-10 logarithms. Null and empty texts are a lone end.
    Repeated rows repeat, and count again in training. With nothing to learn from,
    the base score is 0 a token and the weights stay nearly uniform.
    Other columns are not read; an empty table gives an empty one.
    """
    held = F.coalesce(held_out, F.lit(False))
    words = stage(word_counts(docs, text_col, held), "words")
    ends = docs.where(~held).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    logs = read_vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(STEPS):
        logs = fit(words, ends, logs)
    scored = stage(_word_scores(words, logs), "scored_words")
    base = lambda c: F.log10((c + 1) / F.lit(float(total + distinct + 1)))

    frequent = scored.where(F.octet_length("word") <= WORD_BYTES).where(F.col("seen") >= _least_count(scored)).collect()
    known = [r.word.encode() for r in frequent]
    counts, log10 = np.array([r.c for r in frequent], np.int64), np.array([r.log10 for r in frequent])
    parts = stage(_known_parts(docs, id_col, text_col, held, known, counts, log10, total + distinct + 1), "parts")
    rest = parts.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    rest = rest.join(scored, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * base(F.col("c"))).alias("more_base"),
        F.sum(F.col("n") * F.col("log10")).alias("more_score"),
    )
    nothing = F.lit(0.0)
    return parts.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", nothing) + base(F.lit(ends))).alias("base_score"),
        (F.col("own") + F.coalesce("more_score", nothing) + F.lit(logs[_END] / math.log(10))).alias("score"),
    )


def _known_parts(docs, id_col, text_col, held, known, counts, log10, room) -> DataFrame:
    """Per row the sums over the frequent words, and the other words with their numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = np.log10((counts + 1) / room)
    schema = f"id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, own double, rest array<struct<word:string,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(known)}
        look_up, none = number.get, len(known)
        for batch in slices(batches, _ROWS):
            rows, offsets, others, times = [], [0], [], []
            for text in text_bytes(batch.column(2)):
                words = (text or b"").lower().split()
                at = np.fromiter((look_up(w, none) for w in words), np.int64, len(words))
                rare = Counter([words[i] for i in np.flatnonzero(at == none).tolist()])
                others += rare.keys()
                times += rare.values()
                offsets.append(len(others))
                at = at[at < none]
                rows.append((len(words) + 1, int((counts[at] > 0).sum()), float(base[at].sum()), float(log10[at].sum())))
            pairs = pa.StructArray.from_arrays([pa.array(others, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"])
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            made = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))] if rows else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, rest], ["id", "held", "n_tokens", "n_known", "base", "own", "rest"])

    found = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found.withColumn("row", F.monotonically_increasing_id())
