"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import compact_windows, jaccard_join, language_id, line_dedup, mixing, packing, quartile_digest, robust_quality, token_counts, token_files
from quaymark.llm.shared import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), window=1024)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated(documents(spark, sf_dir))


def op6_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.rate(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.stripped(documents(spark, sf_dir), site="source", min_sites=10)
    return out.select("row_.doc_id", "n_lines", "n_removed", "text")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, source, text FROM documents), l AS (
  SELECT nr, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d
), b AS (
  SELECT line, min(doc_id) AS keeper FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 10
), j AS (
  SELECT l.nr, l.doc_id, l.line, l.pos, b.keeper, row_number() OVER (PARTITION BY l.nr, l.line ORDER BY l.pos) AS nth
  FROM l LEFT JOIN b ON l.line = b.line
), r AS (
  SELECT nr, doc_id, line, pos, keeper IS NOT NULL AND NOT (keeper = doc_id AND nth = 1) AS gone FROM j
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM r GROUP BY nr, doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM d WHERE text IS NULL
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.fingerprint(documents(spark, sf_dir))


# What SQL can express of operators that it cannot express whole: the same rows, without the columns that need the method.


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents), w AS (
  SELECT nr, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), i AS (SELECT nr, words, unnest(range(1, len(words) - 6)) AS pos FROM w WHERE len(words) >= 8
), twice AS (SELECT nr, unnest(list(pos)) AS pos FROM (SELECT nr, pos, words[pos:pos + 7] AS seen FROM i) GROUP BY nr, seen HAVING count(*) > 1
), again AS (SELECT nr, count(DISTINCT pos + k) AS n FROM twice, range(8) AS r(k) GROUP BY nr
), l AS (SELECT nr, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (SELECT nr, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY nr)
SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(words) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(words) AS base_failed
FROM w LEFT JOIN dup USING (nr) LEFT JOIN again USING (nr)
"""


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_robust_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3.0 * source_size / weight AS stops, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS given, coalesce(sum(weight) OVER before, 0) AS gone
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT arg_min((total - given) / (weights - gone), stops) AS level FROM o WHERE (total - given) / (weights - gone) <= stops)
SELECT doc_id, size::BIGINT AS size, source_size, least(weight * (SELECT level FROM level), 3.0::DOUBLE * source_size)::DOUBLE AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


EDITS_SQL = """
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS next FROM documents)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(next, length(text) // 2)) AS edited_sha256 FROM n
"""


def digest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quartile_digest(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_packing, op3_token_files, op4_jaccard_join, op5_compact_windows, op6_robust_quality, op7_line_dedup, op8_language_id, op9_mixing, op10_quartile_digest, quality_base_rules, mixing_targets, digest_edits)}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "quality_base_rules": BASE_SQL, "mixing_targets": TARGETS_SQL, "digest_edits": EDITS_SQL}
