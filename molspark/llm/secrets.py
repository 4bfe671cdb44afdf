"""Secrets in texts: fixed patterns, and strings that pass for random.

Everything here is a DataFrame expression. A pattern's matches and the pieces
between them give the positions: both lists together make up the text, so running
sums of their lengths are exact code point positions.

Beyond the patterns, unbroken strings of 20 or more encoding characters, with a
digit and a letter, are candidates. The smallest alphabet that holds the string is
taken as its encoding, and a battery of tests asks whether uniformly random
characters of this alphabet would look like it: a chi-squared test of the counts,
a runs test of the halves of the alphabet, a test of the serial correlation. The
smallest p-value, times the number of tests, is the string's p-value.

Long strings give tests more power than short ones, so strings are judged within
bands of length (powers of two). In each band the Benjamini-Hochberg step-up over
all strings of the corpus picks those that are not random, of which at most the
share ``fdr`` are expected to be random after all; the others are reported. Its
counts come from a histogram of p-values, a few hundred rows at any input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from molspark.staging import stage

# Kinds in order of listing, their patterns and least lengths.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Encodings from the smallest alphabet to the largest.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("upper_hex", "^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("upper_base36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
FDR = 0.01
_BINS_PER_DECADE, _LAST_BIN = 20, 600
MASK = "[secret]"


def _spans(text: Column, pattern: str, kind: str, keep, group: int = 0) -> Column:
    """``start, kind_no, end, value`` of each match whose group passes ``keep``; positions count code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern, -1)
    steps = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), groups.alias("value"))
    number = F.lit(KINDS.index(kind))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,value:string>>")

    def step(acc: Column, s: Column) -> Column:
        start = acc.pos + F.char_length(s.piece)
        end = start + F.coalesce(F.char_length(s.whole), F.lit(0))
        span = F.struct(start.alias("start"), number.alias("kind_no"), end.alias("end"), s.value.alias("value"))
        good = s.whole.isNotNull() & keep(s.value)
        return F.struct(end.alias("pos"), F.when(good, F.array_append(acc.out, span)).otherwise(acc.out).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out")), step, lambda acc: acc.out)
    return F.when(F.exists(groups, keep), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Matches of the three fixed patterns, by start, then kind."""
    def at_least(n: int):
        return lambda v: F.char_length(v) >= n

    long_enough = {kind: at_least(n) for kind, n in LEAST.items()}
    return F.sort_array(F.concat(
        _spans(text, ASSIGN, "assign", long_enough["assign"], group=2),
        _spans(text, ACCESS.replace("+", "{%d,}" % (LEAST["access"] - 4)), "access", long_enough["access"]),
        _spans(text, HEX.replace("+", "{%d,}" % LEAST["hex"]), "hex", long_enough["hex"]),
    ))


def _upper_tail(z: Column) -> Column:
    """Chance of a standard normal value above ``z``, by a logistic approximation (error below 0.0002)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2.0 * _upper_tail(F.abs(z))


def p_value(token: Column) -> Column:
    """Battery p-value of one string under uniform characters of its inferred alphabet."""
    core = F.regexp_replace(token, "=+$", "")
    alphabet = F.coalesce(*(F.when(core.rlike(p), F.lit(a)) for _, p, a in ENCODINGS), F.lit(ENCODINGS[-1][2] + "+/="))
    state = F.struct(F.split(core, "").alias("chars"), F.char_length(core).alias("n"), alphabet.alias("alphabet"))
    return F.transform(F.array(state), _battery)[0]


def _battery(s: Column) -> Column:
    size = F.char_length(s.alphabet).cast("double")
    values = F.transform(s.chars, lambda c: (F.instr(s.alphabet, c) - 1).cast("double"))
    counts = F.transform(F.array_distinct(s.chars), lambda c: F.size(F.filter(s.chars, lambda x: x == c)).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    parts = F.struct(
        s.n.cast("double").alias("n"), size.alias("size"), values.alias("v"),
        total(F.transform(counts, lambda c: c * c)).alias("squares"), total(values).alias("sum"),
        F.slice(values, 1, F.greatest(F.lit(0), s.n - 1)).alias("head"), F.slice(values, 2, F.greatest(F.lit(0), s.n - 1)).alias("tail"),
    )

    def tests(t: Column) -> Column:
        freedom = t["size"] - 1.0
        chi = t["size"] / t.n * t.squares - t.n
        spread = 2.0 / (9.0 * freedom)
        p_counts = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / freedom, 1.0 / 3.0) - (1.0 - spread)) / F.sqrt(spread))
        half = t["size"] / 2.0
        high = F.size(F.filter(t.v, lambda x: x >= half)).cast("double")
        low = t.n - high
        runs = 1.0 + total(F.zip_with(t["head"], t["tail"], lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0)))
        expected = 2.0 * high * low / t.n + 1.0
        variance = (expected - 1.0) * (expected - 2.0) / F.greatest(t.n - 1.0, F.lit(1.0))
        p_runs = F.when(variance > 0.0, _two_sided((runs - expected) / F.sqrt(F.when(variance > 0.0, variance)))).otherwise(F.pow(F.lit(2.0), 1.0 - t.n))
        mean = t["sum"] / t.n
        power = total(F.transform(t.v, lambda x: (x - mean) * (x - mean)))
        product = total(F.zip_with(t["head"], t["tail"], lambda a, b: (a - mean) * (b - mean)))
        p_serial = F.when(power > 0.0, _two_sided((product / F.when(power > 0.0, power) + 1.0 / t.n) * F.sqrt(t.n))).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), 3.0 * F.least(p_counts, p_runs, p_serial))

    return F.transform(F.array(parts), tests)[0]


def _candidates(text: Column, base: Column) -> Column:
    """``start, kind_no, end, value`` of candidate strings that touch no base span."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    found = _spans(text, CANDIDATE, "random", mixed)
    return F.filter(found, lambda c: ~F.exists(base, lambda b: (b.start < c.end) & (c.start < b.end)))


def _band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    """Bin of a p-value, from 0 (p = 1) upwards as p falls."""
    return F.when(p <= 0.0, F.lit(_LAST_BIN)).otherwise(
        F.least(F.lit(_LAST_BIN), F.ceil(-F.log10(F.when(p > 0.0, p)) * _BINS_PER_DECADE - 1e-9).cast("int"))
    )


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` as ``_0, _1, ...``, then ``base`` spans and ``tested`` strings with band and bin."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    found = docs.select(*kept, text.alias("_text")).withColumn("base", base_spans(F.col("_text")))
    found = found.withColumn("cand", _candidates(F.col("_text"), F.col("base")))
    tested = F.transform("cand", lambda c: F.struct(
        c.start.alias("start"), c.kind_no.alias("kind_no"), c.end.alias("end"),
        _band(c.end - c.start).alias("band"), _bin(p_value(c.value)).alias("bin"),
    ))
    slim = F.transform("base", lambda b: F.struct(b.start.alias("start"), b.kind_no.alias("kind_no"), b.end.alias("end")))
    return found.select(*(f"_{i}" for i in range(len(keep))), slim.alias("base"), tested.alias("tested"))


def bin_limits(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """``band, dismissed``: the least bin whose strings are not random, of the bands that have one."""
    counts = scanned.select(F.explode("tested").alias("t")).groupBy("t.band", "t.bin").agg(F.count("*").alias("n"))
    falling = Window.partitionBy("band").orderBy(F.col("bin").desc())
    summed = counts.select(
        "band", "bin", F.sum("n").over(falling).alias("k"), F.sum("n").over(Window.partitionBy("band")).alias("m")
    )
    highest = F.pow(F.lit(10.0), -(F.col("bin") - 1) / _BINS_PER_DECADE)  # largest p-value of the bin
    return summed.where(highest <= fdr * F.col("k") / F.col("m")).groupBy("band").agg(F.min("bin").alias("dismissed"))


def with_spans(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """``scanned``, a written table, with ``base`` and ``spans`` (all spans, by start, then kind)."""
    limits = F.create_map(*(F.lit(x) for r in bin_limits(scanned, fdr).collect() for x in (r.band, r.dismissed)))  # a row per power of two
    limits = limits.cast("map<int,int>")
    random = F.filter("tested", lambda t: t.bin < F.coalesce(F.try_element_at(limits, t.band), F.lit(_LAST_BIN + 1)))
    slim = F.transform(random, lambda t: F.struct(t.start.alias("start"), t.kind_no.alias("kind_no"), t.end.alias("end")))
    return scanned.withColumn("spans", F.sort_array(F.concat("base", slim)))


def _of_kind(number: int):
    return lambda span: span.kind_no == number


def _listed(spans: str) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s.kind_no), s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` by start, then kind; positions count code points,
    ends are exclusive. ``base_sha256`` is the digest of the same list of the fixed
    patterns alone. Null and empty texts have no spans and the digest of the empty
    string. Repeated rows repeat, and their strings count again in the error control.
    Other columns are not read; an empty table gives an empty one.
    """
    found = with_spans(stage(scan(docs, [id_col], text_col), "secrets"), fdr)
    counts = [F.size(F.filter("spans", _of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("_0").alias(id_col), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", fdr: float = FDR) -> DataFrame:
    """``docs`` with each secret in the text replaced by a mask; overlapping spans become one.

    ``length_col``, if there is such a column, follows the new length. Texts without
    secrets, null ones too, stay as they are.
    """
    found = with_spans(stage(scan(docs, docs.columns, text_col), "secrets"), fdr)
    text = F.col(f"_{docs.columns.index(text_col)}")
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc.pos + 1).cast("int"), (s.start - acc.pos).cast("int"))
        return F.when(s.start >= acc.pos, F.struct(s.end.alias("pos"), F.concat(acc.out, before, F.lit(MASK)).alias("out"))).otherwise(
            F.struct(F.greatest(acc.pos, s.end).alias("pos"), acc.out.alias("out"))
        )

    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc.out, F.substring(text, (acc.pos + 1).cast("int"), F.char_length(text))))
    out = {text_col: F.when(F.size("spans") > 0, masked).otherwise(text)}
    if length_col in docs.columns:
        old = F.col(f"_{docs.columns.index(length_col)}")
        out[length_col] = F.when(F.size("spans") > 0, F.char_length(out[text_col]).cast(docs.schema[length_col].dataType)).otherwise(old)
    return found.select(*(out.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)))
