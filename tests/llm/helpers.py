"""Small inputs with the awkward cases: nulls, empty and very long texts, repeats, clashing columns."""

from __future__ import annotations

import random
import re

FOLDER = "/root/testdata/sf0.001"
CLASHING = ("fp", "key", "word", "words", "row", "rule", "score", "ids", "base", "spans", "features", "kept", "label", "_0", "_text", "c", "n", "held")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice(("an", "the", "re", "io", "st", "ou", "é", "ç")) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    out = [(i, prose(rnd, rnd.randrange(5, 150)), rnd.choice(("en", "fr", None)), rnd.choice(("a", "b", None)), 5) for i in range(n)]
    long = prose(rnd, 30_000)
    texts = [None, "", " \n\t ", "one", "one two", long, "A b C " * 50, "x" * 20_000, "é" * 3000, out[0][1], out[0][1] + " more", "\x00\x1c\x85"]
    out += [(1000 + i, t, "en", "a", 5) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, out[5][1], None, None, None), (None, None, None, None, None)]
    return out


def table(spark, data=None):
    """Documents with extra columns that carry names the operators use inside."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    for i, name in enumerate(CLASHING):
        df = df.selectExpr("*", f"{i} AS `{name}`")
    return df


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
