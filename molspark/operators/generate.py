"""Candidate generation from token transition probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from molspark.functions.hashing import leading_md5, uniform
from molspark.functions.tokens import SENTINEL, bound, tokenize
from molspark.operators.shaping import unnest
from molspark.staging import stage

MAX_LENGTH = 100
# Transition rows that may be sent to every executor; beyond, steps are joins.
TABLE_LIMIT = 200_000


def transition_counts(df: DataFrame, text: str = "smiles", strict: bool = False) -> DataFrame:
    """``cur, next, n``: neighbouring tokens, sentinels included."""
    pairs = bound(tokenize(F.col(text), strict), lambda t: F.zip_with(
        F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1),
        lambda a, b: F.struct(a.alias("cur"), b.alias("next")),
    ))
    return unnest(df, [], pairs, "p").groupBy("p.cur", "p.next").agg(F.count(F.lit(1)).alias("n"))


def transition_shares(counts: DataFrame) -> DataFrame:
    """Conditional probability of the next token."""
    totals = counts.groupBy("cur").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "cur").select("cur", "next", "n", (F.col("n") / F.col("_t")).alias("p"))


def cumulative_shares(counts: DataFrame, temperature: float = 0.9) -> DataFrame:
    """``cur, next, lo, hi``: intervals of [0, 1) per successor, successors
    ascending, probabilities raised to 1/temperature and renormalised.

    The window runs over the successors of one token in the aggregated table.
    """
    weighted = transition_shares(counts).withColumn("_w", F.pow("p", F.lit(1.0 / temperature)))
    run = Window.partitionBy("cur").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("cur")
    shares = weighted.select(
        "cur", "next", "_w", F.sum("_w").over(run).alias("_c"), F.sum("_w").over(total).alias("_t"),
        F.row_number().over(Window.partitionBy("cur").orderBy(F.col("next").desc())).alias("_from_end"),
    )
    return shares.select(
        "cur", "next",
        ((F.col("_c") - F.col("_w")) / F.col("_t")).alias("lo"),
        # the last interval is closed at 1, whatever the rounding
        F.when(F.col("_from_end") == 1, 1.0).otherwise(F.col("_c") / F.col("_t")).alias("hi"),
    )


class TransitionTable:
    """All intervals as one sorted array of whole numbers: token number, then the interval's end times 2**32.

    A draw of a walk at a token is a number of the same form, so the next tokens of a
    whole batch of walks are one binary search, exactly as by comparing the fractions.
    """

    def __init__(self, cur: list[str], hi: np.ndarray, nxt: list[str]) -> None:
        self.tokens = sorted({SENTINEL, *cur, *nxt})
        number = {t: k for k, t in enumerate(self.tokens)}
        ends = np.ceil(hi * 2.0**32).astype(np.int64)
        keys = np.array([number[c] for c in cur], np.int64) << 33 | ends
        order = np.argsort(keys, kind="stable")
        self.keys, self.next = keys[order], np.array([number[t] for t in nxt], np.int32)[order]
        self.sentinel = number[SENTINEL]

    def walks(self, seed: int, ids: np.ndarray, max_length: int) -> pa.Array:
        """The strings of some candidates, all advanced by one token a step."""
        prefixes = np.array([f"{seed}|{i}|" for i in ids.tolist()], dtype=bytes)
        going, cur = np.arange(len(ids)), np.full(len(ids), self.sentinel, np.int64)
        rows, drawn = [], []
        for step in range(max_length):
            draws = leading_md5(prefixes[going], str(step).encode())
            at = np.searchsorted(self.keys, cur << 33 | draws, side="right")
            if (at == len(self.keys)).any() or (self.keys[at] >> 33 != cur).any():
                raise ValueError("a token without successors")
            cur = self.next[at].astype(np.int64)
            open_ = cur != self.sentinel
            going, cur = going[open_], cur[open_]
            if not len(going):
                break
            rows.append(going)
            drawn.append(cur)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")  # steps are in order already
        offsets = np.searchsorted(row[order], np.arange(len(ids) + 1)).astype(np.int32)
        tokens = pa.array(self.tokens).take(pa.array(np.concatenate(drawn)[order] if drawn else np.zeros(0, np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), "")


def sample(ids: DataFrame, shares: DataFrame, seed: int, max_length: int = MAX_LENGTH, limit: int = TABLE_LIMIT) -> DataFrame:
    """One string per candidate id, drawn token by token until the end sentinel.

    Every draw depends on seed, id and step only. The transition table goes to
    the executors while it is small; a larger one is joined step by step.
    """
    rows = shares.select("cur", "next", "hi").limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return sample_by_join(ids, stage(shares, "transitions"), seed, max_length)
    if not rows.num_rows:
        return ids.select("cand_id", F.lit("").alias("smiles"))
    table = TransitionTable(rows["cur"].to_pylist(), rows["hi"].to_numpy(), rows["next"].to_pylist())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walks = table.walks(seed, batch.column(0).to_numpy(zero_copy_only=False), max_length)
            yield pa.RecordBatch.from_arrays([batch.column(0), walks], ["cand_id", "smiles"])

    return ids.select(F.col("cand_id").cast("bigint").alias("cand_id")).where("cand_id IS NOT NULL").mapInArrow(draw, "cand_id bigint, smiles string")


def range_lookup(shares: DataFrame) -> DataFrame:
    """``cur, slot, lo, hi, next, slots``: the intervals, cut into slots of equal width per token.

    A token has as many slots as successors, rounded up to a power of two, and eight at
    least, so a draw meets one or two intervals by an equi-join, whatever the token,
    and the walks at a frequent token are dealt over its slots. ``slots`` is the number
    of slots of the next token.
    """
    sizes = shares.groupBy("cur").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("cur", F.greatest(F.lit(8), F.pow(2, F.ceil(F.log2("_n")))).cast("int").alias("_s"))
    # the last slot is the one below the interval's end, which it does not contain
    first, last = F.floor(F.col("lo") * F.col("_s")), F.ceil(F.col("hi") * F.col("_s")) - 1
    cut = shares.join(sizes, "cur").withColumn("slot", F.explode(F.sequence(first, F.greatest(first, last))))
    after = sizes.select(F.col("cur").alias("next"), F.col("_s").alias("slots"))
    return cut.join(after, "next", "left").select("cur", F.col("slot").cast("int").alias("slot"), "lo", "hi", "next", F.coalesce("slots", F.lit(1)).alias("slots"))


def sample_by_join(ids: DataFrame, shares: DataFrame, seed: int, max_length: int = MAX_LENGTH, every: int = 5) -> DataFrame:
    """The same strings with one join per step, staged every few steps.

    An ended walk has a null ``cur``.
    """
    lookup = stage(range_lookup(shares), "slots")
    first = lookup.where(F.col("cur") == SENTINEL).agg(F.max("slot")).first()[0]
    going = ids.select("cand_id", F.lit(SENTINEL).alias("cur"), F.lit(1 if first is None else first + 1).alias("slots"), F.lit("").alias("smiles"))
    done = None
    for step in range(max_length):
        going = _step(going, lookup, uniform(seed, F.col("cand_id"), F.lit(step)))
        if (step + 1) % every == 0:
            going = stage(going, "walk")
            ended = going.where("cur IS NULL")
            done = ended if done is None else done.unionByName(ended)
            going = going.where("cur IS NOT NULL")
            if going.isEmpty():
                break
    out = going if done is None else done.unionByName(going)
    return out.select("cand_id", "smiles")


def _step(walks: DataFrame, lookup: DataFrame, u: Column) -> DataFrame:
    """Extend open walks by one token; ended ones pass through."""
    ended = walks.where("cur IS NULL")
    placed = walks.where("cur IS NOT NULL").withColumn("_u", u).withColumn("slot", F.floor(F.col("_u") * F.col("slots")).cast("int")).drop("slots")
    nxt = placed.join(lookup, ["cur", "slot"]).where("_u >= lo AND _u < hi")
    ends = F.col("next") == SENTINEL
    return nxt.select(
        "cand_id",
        F.when(~ends, F.col("next")).alias("cur"),
        "slots",
        F.concat("smiles", F.when(ends, "").otherwise(F.col("next"))).alias("smiles"),
    ).unionByName(ended)
