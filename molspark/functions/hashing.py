"""Seeded values that depend on the row key alone, never on partitioning."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from molspark.functions.tokens import SENTINEL, TOKEN_PATTERN

FINGERPRINT_BITS = 2048
_TWO_32 = 4294967296.0
_REMEMBERED = 1 << 17  # digests of a worker


def seeded_digest(seed, *keys: Column) -> Column:
    """md5 of ``seed|key|...``; its order is the shuffle order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def leading_bits(digest: Column, hex_digits: int) -> Column:
    """Integer value of the first digits of a digest, in digest order."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def uniform(seed, *keys: Column) -> Column:
    """Number in [0, 1)."""
    return leading_bits(seeded_digest(seed, *keys), 8) / F.lit(_TWO_32)


def normal(seed, *keys: Column) -> Column:
    """Standard normal draw from two halves of one digest."""
    digest = seeded_digest(seed, *keys)
    u1 = (leading_bits(digest, 8) + 1) / F.lit(_TWO_32 + 1)
    u2 = leading_bits(F.substring(digest, 9, 8), 8) / F.lit(_TWO_32)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def fragment_id(fragment: Column) -> Column:
    return leading_bits(F.md5(fragment), 8)


def fragment_set(fragments: Column) -> Column:
    """Sorted distinct hashes of fragments, not folded to a few bits."""
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(fragments), fragment_id)))


class _FragmentIds(dict):
    """:func:`fragment_id` of texts; those met before are remembered, up to a bound."""

    def __missing__(self, fragment: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        out = int.from_bytes(hashlib.md5(fragment.encode()).digest()[:4], "big")
        if len(fragment) <= 64:
            self[fragment] = out
        return out


def gram_set(text: Column, length: int) -> Column:
    """``fragment_set(ngrams(tokenize(text), length))``, for runs of two tokens or more.

    The tokens of a text are found and run together in the task, and a digest is made of
    each different run only once a worker. Null texts give an empty set.
    """
    workers: dict[str, tuple] = {}

    def one(text: str | None) -> np.ndarray:
        if text is None:
            return np.empty(0, np.int64)
        find, ids = workers["own"]
        tokens = [SENTINEL, *find(text), SENTINEL]
        joined = "".join(tokens)
        runs = joined if len(joined) == len(tokens) else tokens
        grams = {"".join(runs[i : i + length]) if runs is tokens else runs[i : i + length] for i in range(len(tokens) - length + 1)}
        return np.unique(np.fromiter(map(ids.__getitem__, grams), np.int64, len(grams)))

    def run(texts: pa.Array) -> pa.Array:
        if not workers:
            workers["own"] = re.compile(TOKEN_PATTERN).findall, _FragmentIds()
        sets = [one(t.as_py()) for t in texts]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))

    return F.arrow_udf(run, returnType="array<bigint>")(text)


def fingerprint(fragments: Column, n_bits: int = FINGERPRINT_BITS) -> Column:
    """Sorted distinct bit positions of hashed fragments."""
    bits = F.transform(
        F.array_distinct(fragments), lambda g: (fragment_id(g) % n_bits).cast("int")
    )
    return F.array_sort(F.array_distinct(bits))


# The additive constants of MD5 by their definition, and its rotations per group of 16 rounds.
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def leading_md5(prefixes: np.ndarray, suffix: bytes) -> np.ndarray:
    """First 32 bits of the md5 of each prefix (bytes) + ``suffix``, as :func:`leading_bits` reads 8 digits."""
    return leading_md5_pair(prefixes, suffix)[0]


def normals(prefixes: np.ndarray, suffix: bytes) -> np.ndarray:
    """The draws of :func:`normal` for keys that :func:`seeded_digest` joins to prefix + ``suffix``."""
    if prefixes.dtype.itemsize + len(suffix) <= 55:
        first, second = leading_md5_pair(prefixes, suffix)
    else:  # longer messages have several blocks
        digests = [hashlib.md5(p + suffix).digest() for p in prefixes.tolist()]
        first, second = np.array([np.frombuffer(d, ">u4", 2) for d in digests], np.int64).reshape(-1, 2).T
    return np.sqrt(-2 * np.log((first + 1) / (_TWO_32 + 1))) * np.cos(2 * np.pi * (second / _TWO_32))


def leading_md5_pair(prefixes: np.ndarray, suffix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and second 32 bits of the md5 of each prefix (bytes) + ``suffix``.

    All digests advance together. A message may have up to 55 bytes.
    """
    width, lengths = prefixes.dtype.itemsize, np.char.str_len(prefixes)
    if width + len(suffix) > 55:
        raise ValueError("messages of up to 55 bytes")
    block = np.zeros((len(prefixes), 64), np.uint8)
    block[:, :width] = prefixes.view(np.uint8).reshape(len(prefixes), width)
    at = np.arange(len(prefixes))
    for k, byte in enumerate([*suffix, 0x80]):
        block[at, lengths + k] = byte
    block[:, 56:58] = ((lengths + len(suffix)) * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(len(prefixes), x, np.uint32) for x in _START)
    for i in range(64):
        group = i // 16
        if group == 0:
            mixed, word = d ^ (b & (c ^ d)), i
        elif group == 1:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif group == 2:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        turned, by = a + mixed + _SINES[i] + words[word], _TURNS[group][i % 4]
        a, d, c, b = d, c, b, b + (turned << np.uint32(by) | turned >> np.uint32(32 - by))
    return tuple((x + np.uint32(start)).byteswap().astype(np.int64) for x, start in ((a, _START[0]), (b, _START[1])))
