"""One query per operator over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import ann, byte_bpe, collocations, host_quality, language_id, line_dedup, mixing, ngram_join, secrets, substring_dedup, whitening, word_bpe, word_lm


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.host_quality(_documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removals(_documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return word_lm.cross_entropy_difference(_documents(spark, sf_dir), good)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(table, table.where(F.col("vec_id") % 20 == 0))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_host_quality,
        op2_ngram_join,
        op3_byte_bpe,
        op4_line_dedup,
        op5_mix_sources,
        op6_lm_score,
        op7_language_id,
        op8_nearest_neighbours,
        op9_secret_scan,
        op10_substring_dedup,
        op11_whitening,
        op12_collocations,
        op13_word_bpe,
    )
    return {f.__name__: f for f in every}


def _rate(rule: str) -> str:
    mean = f"({rule}_all / all_docs)"
    strength = f"least(greatest({mean} * (1 - {mean}) / greatest({rule}_sq / all_docs - {mean} * {mean}, 1e-12) - 1, 1.0), 10000.0)"
    return f"({rule} + {mean} * {strength}) / (host_docs + {strength})"


_RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")

OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (
  SELECT rid, unnest(range(len(words) - 4)) AS i, words FROM d WHERE len(words) >= 5),
win AS (
  SELECT rid, i, array_to_string(words[i + 1 : i + 5], ' ') AS five FROM w),
rep AS (
  SELECT rid, unnest(range(i, i + 5)) AS pos
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1),
reps AS (SELECT rid, count(DISTINCT pos)::BIGINT AS n_repeat_words FROM rep GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, d.host, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN reps USING (rid) LEFT JOIN lines USING (rid)),
h AS (
  SELECT host, count(*) AS host_docs,
         count(*) FILTER (n_words < 10)::DOUBLE AS short,
         count(*) FILTER (100 * n_repeat_words > 20 * n_words)::DOUBLE AS repeats,
         count(*) FILTER (10 * n_symbols > n_words)::DOUBLE AS symbols,
         count(*) FILTER (10 * n_dup_lines > 3 * n_lines)::DOUBLE AS dup_lines,
         count(*) FILTER (word_chars < 2 * n_words OR word_chars > 15 * n_words)::DOUBLE AS word_length
  FROM m GROUP BY host),
c AS (
  SELECT sum(host_docs)::DOUBLE AS all_docs,
         {', '.join(f'sum({r}) AS {r}_all, sum({r} * {r} / host_docs) AS {r}_sq' for r in _RULES)}
  FROM h),
v AS (
  SELECT host, host_docs, greatest({', '.join(map(_rate, _RULES))}) AS rate FROM h, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND rate <= 0.5 AS kept,
       host_docs::BIGINT AS host_docs, rate <= 0.5 AS host_ok, round(rate, 9) AS host_rate
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, ':' || text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio,
         sum(source_size) OVER ()::DOUBLE * 1.5 AS budget,
         row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k
  FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM r),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, k) FROM l WHERE level <= ratio)) AS target
  FROM l),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash),
q AS (
  SELECT g.source, hash, words, target - whole * source_size AS rest, source_size, target, whole,
         sum(words) OVER (PARTITION BY g.source ORDER BY hash) AS after
  FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (d.size * (whole + CASE WHEN rest > 0 AND (after <= rest OR (after - words <= rest AND 2 * (rest - (after - words)) >= words))
                          THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.hash = q.hash
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
occurrences AS (
  SELECT lang, unnest([array_to_string(words[i : i + d - 1], ' ') for i in range(1, len(words) - d + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE len(words) >= d),
f AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS path, len(string_split(phrase, ' ')) AS d, f
  FROM (SELECT lang, phrase, count(*)::BIGINT AS f FROM occurrences GROUP BY lang, phrase HAVING count(*) >= 30)),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * p.f // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, array_to_string(path[1 : k], ' ') AS head, array_to_string(path[k + 1 : d], ' ') AS tail
        FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < d) p
  JOIN f x ON x.lang = p.lang AND x.phrase = head
  JOIN f y ON y.lang = p.lang AND y.phrase = tail),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(path[i : i + e - 1], ' ') AS phrase, max(f) AS most
  FROM f, (SELECT unnest([2, 3]) AS e), (SELECT unnest([1, 2, 3]) AS i)
  WHERE e < d AND i + e - 1 <= d GROUP BY 1, 2),
ranked AS (
  SELECT b.lang, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN n USING (lang)
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_host_quality": OP1_SQL, "op5_mix_sources": OP5_SQL, "op12_collocations": OP12_SQL}
