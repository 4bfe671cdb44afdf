"""Registry of the queries over the driver tables and shared building blocks.

A query is a function of (spark, folder); ``sql`` is the same question for
DuckDB. The tables hold no molecules, so strings are read from part names, whole
document texts, or derived per order by ``MOLECULE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from molspark.functions.tokens import STRUCTURAL_TOKENS, TOKEN_PATTERN
from molspark.staging import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def heavy(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for heavy per-row work, spread over the cores if badly split."""
    return spread(table(spark, folder, name))


def r6(value: Column, name: str) -> Column:
    return F.round(value, 6).alias(name)


def joined(values: Column, name: str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), "~").alias(name)


# A molecule-like string per order, valid or not in several ways; reads the same
# in Spark SQL and DuckDB.
MOLECULE = """concat(translate(CAST(o_custkey AS STRING), '0123456789', 'CNOSPFIcno'),
 CASE o_orderkey % 11 WHEN 0 THEN '(=O)C' WHEN 1 THEN 'c1ccccc1' WHEN 2 THEN '[NH3+]' WHEN 3 THEN '.Cl'
 WHEN 4 THEN '(C' WHEN 5 THEN 'C1CC' WHEN 6 THEN '-C' WHEN 7 THEN ')C(' WHEN 8 THEN 'C%12CC%12'
 WHEN 9 THEN '[C@H](N)C' ELSE '' END)"""


def molecules(spark: SparkSession, folder: str) -> DataFrame:
    """``mol_id, smiles, property, custkey`` from orders."""
    return heavy(spark, folder, "orders").select(
        F.col("o_orderkey").alias("mol_id"),
        F.expr(MOLECULE).alias("smiles"),
        (F.col("o_totalprice") / 100000.0).alias("property"),
        F.col("o_custkey").alias("custkey"),
    )


MOLECULES_SQL = f"""molecules AS (SELECT o_orderkey AS mol_id, {MOLECULE} AS smiles,
 o_totalprice / 100000.0::DOUBLE AS property, o_custkey AS custkey FROM orders)"""


STRUCTURAL_SQL = ", ".join(f"'{t}'" for t in STRUCTURAL_TOKENS)


def tok(column: str) -> str:
    return f"list_concat([' '], regexp_extract_all({column}, '{TOKEN_PATTERN}', 1), [' '])"


def body(column: str) -> str:
    return f"regexp_extract_all({column}, '{TOKEN_PATTERN}', 1)"


def digest(seed, key: str) -> str:
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


def hexint(text: str, n: int = 8) -> str:
    return f"CAST('0x' || substr({text}, 1, {n}) AS BIGINT)"


def uniform_sql(seed, key: str) -> str:
    return f"({hexint(digest(seed, key))} / 4294967296.0::DOUBLE)"


def list_text(lst: str) -> str:
    return f"array_to_string({lst}, '~')"


def grams(tokens: str, n: int) -> str:
    """n-gram list over a token list expression."""
    inner = " || ".join(f"_g[i + {j}]" for j in range(n))
    return (f"(SELECT CASE WHEN len(_g) >= {n} THEN list_transform(range(1, len(_g) - {n - 2}), lambda i: {inner}) "
            f"ELSE [] END FROM (SELECT {tokens} AS _g))")


def set_sql(tokens: str, n: int = 8) -> str:
    """Sorted distinct hashes of n-grams."""
    return f"list_sort(list_distinct(list_transform({grams(tokens, n)}, lambda g: {hexint('md5(g)')})))"


def bits_sql(tokens: str, n: int = 2) -> str:
    return f"list_sort(list_distinct(list_transform({grams(tokens, n)}, lambda g: {hexint('md5(g)')} % 2048)))"
