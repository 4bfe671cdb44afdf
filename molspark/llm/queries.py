"""The operators of this subpackage over the driver tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from molspark.llm import adaptive_rules, bpe, collocations, contamination, html_text, lattice_lm, periodic_runs, quality_model, secrets, simhash, token_files, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# Rules (host, path, verdict), and parts of names by which hosts are listed.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_NAMES = ("ads", "bets", "casino", "pills")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(folds: int) -> Column:
    """Number of a document's fold, by the digits of its id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


@_query("op1_simhash_near_duplicates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query("op3_benchmark_contamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Test items found in documents, with their alignment scores."""
    return contamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op7_adaptive_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, the fixed rule and the adaptive verdict of every document."""
    return adaptive_rules.judge(_table(spark, folder, "documents"))


@_query("op6_secret_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.find_secrets(_table(spark, folder, "documents"))


@_query("op8_byte_bpe_round_trip")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them."""
    return bpe.digests(_table(spark, folder, "documents"))


@_query("op10_lattice_likelihood")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and subword-lattice scores of every document; one fold of seven is held out."""
    return lattice_lm.score(_table(spark, folder, "documents"), _fold(7) == 2)


@_query("op9_url_verdicts", f"""
WITH parts AS (
 SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
 SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, RULES))}),
best AS (
 SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
 FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
 GROUP BY page_id)
SELECT page_id, host, path, rule,
 coalesce(rule_verdict, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), {list(LISTED_NAMES)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN best USING (page_id)""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page's url."""
    pages = _table(spark, folder, "pages")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)")
    return url_filter.judge(pages, rules, url_filter.hosts_named(pages, list(LISTED_NAMES)))


@_query("op2_quality_scores")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; one fold of three is held out."""
    return quality_model.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), _fold(3) == 1)


@_query("op5_warc_round_trip")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Digests and record types of all pages, from archives written and read back."""
    return warc.archive_round_trip(_table(spark, folder, "pages"))


@_query("op4_main_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, folder, "pages"))


@_query("op13_packed_token_files")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Places, sizes and checksums of every document's ids, from bit-packed files written and read back."""
    coded = token_files.round_trip(_table(spark, folder, "documents"))
    return coded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts repeat some of their words up to the end, as the digits of the id say."""
    h, g = F.crc32(F.col("doc_id").cast("string")), F.expr("crc32(CAST(doc_id AS STRING)) DIV 10")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(words), repeated)[0]  # so that the words are made once
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of periodically repeated words in every document, the longest one, and digests of all and of the rest."""
    found = periodic_runs.find_runs(_with_periods(_table(spark, folder, "documents")))
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    return found.select("doc_id", "collapsed", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("m"), F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")).alias("lines")).select(
        "doc_id",
        "n_runs",
        F.col("m.s").alias("start"),
        (-F.col("m.l")).alias("length"),
        F.col("m.p").alias("period"),
        F.expr("-1000 * m.l DIV m.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query("op11_phrase_collocations", """
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
 FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
stretches AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS size FROM places),
counted AS (
 SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
 FROM stretches GROUP BY ALL HAVING count(*) >= 100),
listed AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM counted),
inside AS (
 SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS most
 FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM listed)) GROUP BY ALL),
cuts AS (
 SELECT c.lang, c.phrase, c.f AS a, t.n, k, l.f AS l, r.f AS r, CAST(1000 * c.f::HUGEINT * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
 FROM (SELECT *, unnest(range(1, size)) AS k FROM listed WHERE size > 1) c
 LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
 JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
 JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
 JOIN totals t ON t.lang = c.lang
 WHERE i.most IS NULL OR 100 * i.most < 100 * c.f),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language whose words stand together most."""
    return collocations.collocations(_table(spark, folder, "documents"))
