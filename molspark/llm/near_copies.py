"""Near copies by the Jaccard similarity of five-word shingles, found through SimHash and Golay-code keys.

Words are runs of bytes other than ASCII white space, A-Z lowered. A text of fewer
than five words is one shingle. Two texts are linked if their sets of shingles have
a similarity of 0.8 or more. Texts of equal words are collapsed first, so copies
cost nothing.

At a similarity of 0.8 one in 6.6 bits of a SimHash differs, so 64 bits with the three
segments of :mod:`simhash` would miss nearly all pairs. Here the SimHash has 6,624 bits
in 288 segments of 23. Each segment becomes its likeliest code word of the Golay
code, judged by how narrowly each bit was decided; two segments in a row are a key of
24 bits, 144 a text. A pair of similarity 0.8 shares a key with a probability of
0.9999, a more similar one with a higher one. Another 64 bits are the text's
fingerprint: of the texts that share a key, those joined by fingerprints at most
25 bits apart are a bucket (at 0.8 more bits differ for one pair in a million, of
texts of eight and nine words one in 20,000). A bucket of two goes if a second
fingerprint differs in more bits, so that unlike texts seldom meet in a large corpus.
Buckets that share texts are one group, whose blocks meet two by two; a group of more
than 16,000 texts stays in its buckets. All pairs that meet in a task are compared
exactly by their shingles; of the links only a spanning forest leaves the task, so a large group of near copies makes no rows per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from molspark.llm.graph import components
from molspark.llm.simhash import likely_codes
from molspark.llm.text import slices, small_batches, text_bytes
from molspark.staging import broadcast_checked, stage

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, SEGMENT, NEAR = 144, 23, 25
BROADCAST_ROWS, HALF, BLOCKS = 200_000, 500, 32
_ROWS, _BLOCK, _CELLS, _DECODED, _TOGETHER = 512, 1 << 10, 1 << 22, 1 << 12, 64
_BITS = 2 * BANDS * SEGMENT  # the two fingerprints follow
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, -(-(_BITS + 128) // 64), dtype=np.uint64) | np.uint64(1)
_MIX, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_BIAS = np.random.default_rng(SEED + 1).uniform(-0.25, 0.25, _BITS).astype(np.float32)  # decides ties alike in all texts


def node_of(words: list[bytes]) -> int:
    """Digest of all words of a text, as a signed number."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends)], dtype=np.uint64))


def _added(rows: np.ndarray) -> list[np.ndarray]:
    """How many rows set each bit, as binary digits: the lowest digits of all bits first. Adds three rows to two at a time."""
    digits = []
    while len(rows):
        carried = []
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                odd = a ^ b
                carried.append(a & b | odd & c)
                rows = np.concatenate([odd ^ c, rows[3 * third :]])
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        digits.append(rows[0])
        rows = np.concatenate(carried) if carried else rows[:0]
    return digits


def bit_sums(own: np.ndarray) -> np.ndarray:
    """Per bit of the long SimHash, the shingles that set it less those that do not."""
    total = np.full(64 * len(_FACTORS), -len(own), np.int32)
    for at in range(0, len(own), _BLOCK):
        mixed = own[at : at + _BLOCK, None] * _FACTORS
        mixed ^= mixed >> _SHIFT
        mixed *= _MIX
        mixed ^= mixed >> _SHIFT
        for k, digit in enumerate(_added(mixed)):
            total += np.unpackbits(digit.view(np.uint8), bitorder="little").astype(np.int32) << (k + 1)
    return total


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a row per set, the band in the top bits) and two 64-bit fingerprints of sets of shingles, none of them empty."""
    sums = np.stack([bit_sums(s) for s in sets])
    fingerprints = np.packbits(sums[:, _BITS : _BITS + 128] > 0, axis=1, bitorder="little").view(np.int64)
    segments = (sums[:, :_BITS] + _BIAS).reshape(-1, SEGMENT)
    codes = np.concatenate([likely_codes(segments[at : at + _DECODED]) for at in range(0, len(segments), _DECODED)])
    codes = codes.reshape(len(sets), BANDS, 2).astype(np.int64)
    return np.arange(BANDS) << 24 | codes[:, :, 0] << 12 | codes[:, :, 1], fingerprints


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key per band from a text's shingles; none without shingles."""
    return sketches([own])[0][0] if len(own) else np.zeros(0, np.int64)


def close_groups(fingerprints: np.ndarray, near: int = NEAR) -> list[np.ndarray]:
    """Groups of two or more of the distinct ``fingerprints`` that steps of at most ``near`` bits join, sorted."""
    left, out = np.sort(fingerprints).view(np.uint64), []
    while len(left) > 1:
        group, left = [left[:1]], left[1:]
        for at in group:  # grows while it is read
            for one in at:
                if not len(left):
                    break
                joined = np.bitwise_count(left ^ one) <= near
                if joined.any():
                    group.append(left[joined])
                    left = left[~joined]
        if len(group) > 1:
            out.append(np.sort(np.concatenate(group).view(np.int64)))
    return out


def forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the same of ``nodes`` as all pairs of ``similarity`` or more do."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), sizes), held[column] > 1
    number = np.cumsum(held > 1) - 1  # shingles of one text alone are in no intersection
    row, column, width = row[shared], number[column[shared]], int((held > 1).sum())
    group, out = np.arange(len(sets)), []
    tall = max(1, min(len(sets), _CELLS // max(1, len(sets))))
    wide = max(1, _CELLS // len(sets))
    parts = []
    for low in range(0, width, wide):
        inside = (column >= low) & (column < low + wide)
        parts.append((row[inside], column[inside] - low, min(wide, width - low)))
    for begin in range(0, len(sets), tall):
        end = min(begin + tall, len(sets))
        common = np.zeros((end - begin, len(sets)), np.float32)
        for r, c, w in parts:
            held_in = np.zeros((len(sets), w), np.float32)
            held_in[r, c] = 1
            common += held_in[begin:end] @ held_in.T
        either = sizes[begin:end, None] + sizes[None, :] - common.astype(np.float64)
        left, right = np.nonzero(common / np.maximum(either, 1) >= similarity)
        left += begin
        later = right > left
        for i, j in zip(left[later].tolist(), right[later].tolist()):
            if group[i] != group[j]:
                out.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, node, fp, second, keys`` of every row; ``digest`` is of the text as it stands, the last three are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            texts = [(t or b"").lower().split() for t in text_bytes(batch.column(2))]
            fps, seconds, keys = ([None] * len(texts) for _ in range(3))
            full = [i for i, w in enumerate(texts) if w]
            for at in range(0, len(full), _TOGETHER):
                rows = full[at : at + _TOGETHER]
                for row, own, fp in zip(rows, *sketches([shingles(texts[i]) for i in rows])):
                    (fps[row], seconds[row]), keys[row] = fp.tolist(), own.astype(np.uint32).view(np.int32)
            nodes = pa.array([node_of(w) for w in texts], pa.int64())
            made = [nodes, pa.array(fps, pa.int64()), pa.array(seconds, pa.int64()), pa.array(keys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["id", "digest", "node", "fp", "second", "keys"])

    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, digest bigint, node bigint, fp bigint, second bigint, keys array<int>")


def _buckets(keyed: DataFrame) -> DataFrame:
    """``fps`` from ``key, fp``: the close groups of each key's fingerprints."""
    kind = pa.schema([("fps", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the last key goes on in the next batch

        def found() -> list[np.ndarray]:
            return close_groups(np.unique(np.concatenate(held))) if held else []

        for batch in batches:
            keys, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends, out = np.append(starts[1:], len(keys)), []
            if keys[0] == key:
                held.append(fps[: ends[0]])
                if len(starts) == 1:
                    continue
                starts, ends = starts[1:], ends[1:]
            out += found()
            key, held = keys[-1], [fps[starts[-1] :]]
            for i, j in zip(*(x[:-1][ends[:-1] - starts[:-1] > 1].tolist() for x in (starts, ends))):
                out += close_groups(np.unique(fps[i:j]))
            yield pa.RecordBatch.from_pylist([{"fps": g} for g in out], kind)
        yield pa.RecordBatch.from_pylist([{"fps": g} for g in found()], kind)

    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "fps array<bigint>").distinct()


def _sets(docs: DataFrame, text_col: str, used: DataFrame) -> DataFrame:
    """``node, shingles`` of the distinct texts of ``used``."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            nodes = [node_of((t or b"").lower().split()) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0)], ["node", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            found = [shingles((t or b"").lower().split()).view(np.int64) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(F.col(text_col).alias("text")).mapInArrow(named, "node bigint, text string")
    texts = texts.join(broadcast_checked(used, BROADCAST_ROWS), "node", "left_semi")
    return texts.mapInArrow(cut, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _ties(buckets: DataFrame) -> DataFrame:
    """``a, b`` that join the same fingerprints as the buckets of each Arrow batch do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent: dict[int, int] = {}
            for fps in batch.column(0).to_pylist():
                roots = set()
                for fp in fps:
                    root = fp
                    while parent.setdefault(root, root) != root:
                        parent[root] = root = parent[parent[root]]
                    roots.add(root)
                least = min(roots)
                parent.update((root, least) for root in roots)
            links = [(fp, up) for fp, up in parent.items() if fp != up]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*links) if links else ([], []))], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a bigint, b bigint")


def _members(buckets: DataFrame, texts: DataFrame, half: int = HALF, blocks: int = BLOCKS) -> DataFrame:
    """``key, node``: the texts to be compared with each other, from ``fps`` and ``node, fp, second``.

    Buckets that share fingerprints are one group. Its texts are dealt over blocks of
    some ``half``, and any two blocks are a key, so a text moves once in a small group
    and less often than by its buckets in a larger one. A group of more than
    ``blocks`` blocks is left in its buckets.
    """
    per = stage(texts.groupBy("fp").agg(F.count("*").alias("n"), F.any_value("second").alias("second")), "fingerprints")
    pairs = buckets.where(F.size("fps") == 2)
    for k in (0, 1):
        pairs = pairs.join(per.select(F.col("fp").alias(f"fp{k}"), F.col("n").alias(f"n{k}"), F.col("second").alias(f"second{k}")), F.col("fps")[k] == F.col(f"fp{k}"))
    near = (F.bit_count(F.col("second0").bitwiseXOR(F.col("second1"))) <= NEAR) | (F.col("n0") + F.col("n1") > 2)
    buckets = stage(buckets.where(F.size("fps") > 2).unionByName(pairs.where(near).select("fps")), "near_buckets")
    tied = per.join(components(_ties(buckets)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("label"))
    sizes = tied.groupBy("label").agg(F.sum("n").alias("n")).where("n > 1")
    groups = stage(tied.select("fp", "label").join(sizes, "label"), "groups")
    count = F.greatest(F.lit(2), F.ceil(F.col("n") / half))
    dealt = texts.join(groups.where(count <= blocks), "fp").withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("node"), "count"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1))).where("other != own")
    dealt = dealt.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")
    held = buckets.join(groups.where(count > blocks).select("fp"), F.col("fps")[0] == F.col("fp"), "left_semi")
    held = held.select(F.xxhash64("fps").alias("key"), F.explode("fps").alias("fp"))
    alike = groups.where((count > blocks)).join(per.where("n > 1").select("fp"), "fp").select(F.col("fp").alias("key"), "fp")
    return dealt.unionByName(held.unionByName(alike).join(texts, "fp").select("key", "node"))


def _linked(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` from ``key, node, shingles``: the links within each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def found() -> list[tuple[int, int]]:
            return forest(np.array(nodes, np.int64), sets, similarity) if len(nodes) > 1 else []

        for batch in slices(batches, _ROWS):
            links = []
            lists = batch.column(2)
            values = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            for row, (own, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if own != key:
                    links += found()
                    key, nodes, sets = own, [], []
                nodes.append(node)
                sets.append(values[ends[row - 1] if row else 0 : ends[row]])
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found()], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = members.select("key", "node", "shingles").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id_col, digest, component_id, component_digest``, one row per distinct text.

    ``id_col`` is its smallest id, ``digest`` the least XXH64 of its forms under that
    id (texts of the same words may differ in case and white space); the component's
    columns are the smallest such pair that is reachable over links.

    Null, empty and blank texts are one text, which links to no other. An id is null
    if no row of the text or component has one. The keys are made for a
    ``similarity`` of 0.8 or more.
    """
    small_batches(docs.sparkSession)
    signed = stage(_signed(docs, id_col, text_col), "signatures")
    named = F.when(F.col("id").isNotNull(), F.struct("id", "digest"))
    own = [F.min(named).alias("first"), F.any_value("fp").alias("fp"), F.any_value("second").alias("second")]
    groups = stage(signed.groupBy("node").agg(*own), "texts")
    sketched = signed.where("fp IS NOT NULL").dropDuplicates(["node"])
    buckets = stage(_buckets(sketched.select(F.explode("keys").alias("key"), "fp")), "buckets")
    members = stage(_members(buckets, groups.where("fp IS NOT NULL").select("node", "fp", "second")), "members")
    used = stage(members.select("node").distinct(), "used")
    labels = components(_linked(_sets(docs, text_col, used).join(members, "node"), similarity))
    labelled = groups.join(labels, "node", "left").select("first", F.coalesce("label", "node").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("least"))
    return labelled.join(firsts, "label").select(
        F.col("first.id").alias(id_col), "first.digest", F.col("least.id").alias("component_id"), F.col("least.digest").alias("component_digest")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that start their component; its columns are unchanged.

    Of each component the row with the smallest id stays, once even if it is
    repeated; of several texts of that id in the component, the one of least digest.
    Rows of one id with texts of different components are different documents, and
    each may stay. Rows with a null id cannot be named and stay. Null and empty texts
    are copies of each other. An empty table gives an empty one.
    """
    found = near_copies(docs, id_col, text_col, similarity).where("component_id IS NOT NULL")
    first = stage(found.select("component_id", "component_digest").distinct(), "firsts")
    same = (F.col(f"_row.{id_col}") == F.col("component_id")) & (F.col("_digest") == F.col("component_digest"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.xxhash64(text_col).alias("_digest"))
    kept = rows.join(first, same, "left_semi").select("_row.*", "_digest").dropDuplicates([id_col, "_digest"])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
