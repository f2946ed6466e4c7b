"""One query for each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, html, licenses, media, mixing, quality, secrets, simhash, suffix, toxicity
from wayfare.llm.common import materialize, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op3_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = materialize(media.pcm_blocks(media.stored(table(spark, sf_dir, "documents"))))
    return media.read_back(blocks).withColumnRenamed("id", "doc_id")


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "_mix.epoch", "_mix.block", "_mix.slot", "_mix.position")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.apply(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), words=suffix.WORDS).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", "_q.kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_main_text, op2_byte_bpe, op3_media_flac, op4_pfair_mix, op5_toxicity, op6_suffix_dedup, op7_simhash, op8_quality_rules, op9_license_scan, op10_secret_scan, pipeline)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

_GRAMS = {k: licenses.bigrams(licenses.normalise(v)) for k, v in sorted(licenses.TEMPLATES.items())}
_LEAST, _LONGEST = licenses.limits(_GRAMS, licenses.THRESHOLD)
_TEMPLATES = ",\n  ".join("('{}', {}, {}, [{}])".format(k, *licenses.bounds(len(v), licenses.THRESHOLD), ", ".join(f"'{g}'" for g in v)) for k, v in _GRAMS.items())

ORACLE_SQL: dict[str, str] = {
    "op9_license_scan": rf"""
WITH templates(name, lo, hi, grams) AS (VALUES
  {_TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}.!?\n]+', ' ', 'g') AS t FROM documents),
parts AS (
  SELECT r, unnest(regexp_split_to_array(t, '\n+')) AS x FROM d
  UNION ALL SELECT r, unnest(regexp_split_to_array(regexp_replace(t, '([.!?]) +', '\1' || chr(10), 'g'), '\n+')) FROM d
  UNION ALL SELECT r, x FROM (SELECT r, unnest(regexp_split_to_array(t, '\n *\n')) AS x FROM d) WHERE regexp_matches(x, '\n|[.!?] ')
  UNION ALL SELECT r, t FROM d WHERE regexp_matches(t, '\n *\n')),
segments AS (SELECT DISTINCT r, trim(regexp_replace(x, '[ .!?\n]+', ' ', 'g')) AS x FROM parts WHERE length(x) > 3 AND length(x) <= {_LONGEST}),
words AS (SELECT r, x, string_split(x, ' ') AS w FROM segments WHERE length(x) - length(replace(x, ' ', '')) >= {_LEAST}),
pairs AS (SELECT r, x, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
scored AS (SELECT r, x, name, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM pairs JOIN templates ON len(g) BETWEEN lo AND hi),
found AS (SELECT r, x, min({{'worse': -CAST(dice AS DOUBLE), 'name': name}}) AS best FROM scored WHERE dice >= {licenses.THRESHOLD} GROUP BY r, x),
byrow AS (SELECT r, count(*) AS n, min(best) AS best, string_agg(DISTINCT best.name, ',' ORDER BY best.name) AS names FROM found GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(best.name, '') AS best_license, round(coalesce(-best.worse, 0.0), 6) AS best_score, coalesce(names, '') AS licenses
FROM d LEFT JOIN byrow USING (r)""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS h FROM d, unnest(range(1, greatest(1, len(w) - 1))) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n BETWEEN 2.0 AND 20.0 AND n_symbols / n <= 0.3 AND n_stop / n >= 0.02
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / n <= 0.5 AS kept
FROM b""",
}
