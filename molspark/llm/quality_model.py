"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in the tasks and written once. The
trees are fitted to a bounded sample of labelled rows (``TRAIN_ROWS``), which is
drawn by a hash of the id from all of them; everything else covers all rows. The
fitted trees are complete binary trees in flat arrays, so a batch of rows goes
down all of them by a few numpy steps per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from molspark.llm.adaptive_rules import repeated_words, word_numbers
from molspark.llm.text import per_text
from molspark.staging import stage

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 5, 64, 0.15
LEAST_HESSIAN, L2 = 4.0, 1.0
STATISTICS = (
    "log_words", "word_length", "word_spread", "long_words", "single_chars", "distinct", "log_distinct", "top_word",
    "stutters", "repeated_words", "repeated_lines", "log_lines", "line_words", "full_stops", "commas", "exclamations",
    "symbols", "brackets", "other_marks", "digits", "capitals", "non_ascii", "spaces", "entropy",
)


def _marks() -> np.ndarray:
    """Class of each byte, by rows: which of the counted classes it belongs to."""
    classes = (b".", b",;:", b"!?", b"#*$%&|<>", b"()[]{}\"'", b"-_/\\@~^=+`", bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(0xC0, 256)), b" \t\n\x0b\x0c\r")
    table = np.zeros((len(classes), 256))
    for row, chars in enumerate(classes):
        table[row, list(chars)] = 1.0
    return table


_MARKS = _marks()
_STARTS = np.array([not 0x80 <= b < 0xC0 for b in range(256)], dtype=float)


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one text, all finite; those of a text without words are 0."""
    text = text or b""
    words = text.split()
    if not words:
        return np.zeros(len(STATISTICS))
    n, ids = len(words), word_numbers(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    uses = np.bincount(ids)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars, marks = float(count @ _STARTS), _MARKS @ count
    shares = count[count > 0] / len(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    word_chars = chars - marks[9]
    return np.array([
        np.log1p(n), word_chars / n, lengths.std(), (lengths > 12).mean(), (lengths == 1).mean(),
        len(uses) / n, np.log1p(len(uses)) / np.log1p(n), uses.max() / n,
        (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, repeated_words(ids) / n, 1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)), n / len(lines), *(marks[:6] / n), *(marks[6:9] / chars), marks[9] / chars, -(shares * np.log2(shares)).sum(),
    ])


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` as ``_0, _1, ...`` and ``features`` of every row; a null text counts as empty."""
    return per_text(docs, text_col, keep, lambda texts: {"features": [statistics(t) for t in texts]}, {"features": "array<double>"})


@dataclass(frozen=True)
class Trees:
    """Trees in flat arrays, a row per tree: node k has the children 2k + 1 and 2k + 2; values belong to the leaves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30.0, 30.0)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows of both labels the score is nearly constant."""
    n, width, inner = len(x), x.shape[1], 2**DEPTH - 1
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1.0 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), np.int64)
    flat = binned + np.arange(width) * BINS
    raw, trees = np.full(n, base), []
    for _ in range(TREES if n and 0 < y.sum() < n else 0):
        p = 1.0 / (1.0 + np.exp(-raw))
        gradient, hessian = p - y, p * (1.0 - p)
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, size = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (size, width, BINS)
            g = np.bincount(cell, np.repeat(gradient, width), size * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hessian, width), size * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
            gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0.0
            best = gain.reshape(size, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(size, -1).max(axis=1) > 1e-6).tolist():
                f, cut = divmod(int(best[k]), BINS)
                if cut < len(edges[f]):
                    feature[first + k], limit[first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + L2)
        raw = raw + value[leaf]
        trees.append((feature, limit, value))
    if not trees:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    return Trees(base, *(np.stack(part) for part in zip(*trees)))


def train(featured: DataFrame, labels: DataFrame, id_col: str, label_col: str, features_id: str = "_0") -> Trees:
    """Trees fitted to the rows of ``featured`` whose id has a label; ids with contradicting labels are left out.

    At most about ``TRAIN_ROWS`` ids take part, chosen by a hash of the id.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("high")
    ).where("low = high")
    share = int(1e6 * min(1.0, TRAIN_ROWS / max(1, known.count())))
    chosen = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share).select(F.col(id_col).alias("_id"), F.col("low").alias("_y"))
    rows = featured.join(F.broadcast(chosen), featured[features_id] == F.col("_id")).select("_y", "features").collect()
    x = np.array([r.features for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([float(r._y) for r in rows]))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row; the score is the chance of label 1.

    Labels are learnt only from ids for which ``held_out``, an expression over
    ``id_col``, is not true; only the text's statistics are inputs. Null, empty and
    blank texts have statistics of 0 and a score like any other. Equal texts have
    equal scores; repeated rows repeat. Rows with a null id are scored and never
    learnt from. Without labels the score is 0.5. Other columns are not read.
    """
    held = F.coalesce(held_out, F.lit(False))
    featured = stage(with_statistics(docs.select(F.col(id_col), F.col(text_col)), [id_col], text_col), "features")
    trees = train(featured, labels.where(~held), id_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], ["id", "score"])

    scored = featured.select("_0", "features").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
