"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, languages, main_body, mixing, quality, seen, site_lines, stuffing, term_counts
from tarn.plans.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "postings")).where("mark is not null").select("term", "mark")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "postings")).drop("term_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_rows(table(spark, d, "frontier"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(table(spark, d, "frontier"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(table(spark, d, "frontier")).select("n_rows", "n_new", "n_seen", "n_missed", (F.col("wrong_rate") < 0.01).alias("few_wrong"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.found_lines(table(spark, d, "docs"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.cleaned(table(spark, d, "docs")).select("seq", "doc_id", "url", "content", "removed").distinct()


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_blocks(site_lines.line_ids(table(spark, d, "docs")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "docs"))


def p4_curves(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judged(table(spark, d, "docs")).distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judged(table(spark, d, "docs")).select("seq", "n_words", "n_types").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body.found_blocks(table(spark, d, "fetched"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return main_body.body_texts(table(spark, d, "fetched"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs")
    return languages.found_languages(docs, stuffing.stuffed_pages(docs))


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.judged_lines(table(spark, d, "docs")).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).select("doc_id", "n_chars", "n_words", "n_lines", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("duplicate_lines", 6).alias("duplicate_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        *(p1_found, p1_counts, p2_found, p2_report, p2_totals, p3_found, p3_cleaned, p3_blocks, p4_found, p4_curves, p4_counts),
        *(p5_found, p5_texts, p6_found, p6_languages, p7_ids, p8_found, p8_mixed, p8_shares, p9_found, p9_statistics, p9_counts),
    )
    return {f.__name__: f for f in own}


_SITE = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', '')"
_KEY = r"trim(regexp_replace(regexp_replace(lower(line), '\d+', '0', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))"
_LINES = f"""
d AS (SELECT DISTINCT seq, url, content FROM docs WHERE url IS NOT NULL),
l AS (SELECT seq, url, site, line_no, {_KEY} AS k
      FROM (SELECT seq, url, {_SITE} AS site, unnest(string_split(content, chr(10))) AS line,
                   generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM d)),
s AS (SELECT {_SITE} AS site, count(DISTINCT url) AS site_urls FROM d GROUP BY 1),
k AS (SELECT l.site, k FROM l JOIN s USING (site) WHERE k <> '' GROUP BY l.site, k, site_urls
      HAVING count(DISTINCT url) >= 6 AND count(DISTINCT url) >= 0.2::DOUBLE * site_urls)"""


def oracle_sql() -> dict[str, str]:
    pairs = "p AS (SELECT term, doc_id, coalesce(max(term_freq), 0) AS f FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)"
    marked = f"""WITH {pairs}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p),
c AS (SELECT term, CAST(sum(f) AS BIGINT) AS occurrences, count(*) AS records FROM p GROUP BY 1)
SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.54::DOUBLE * n THEN 'common' END AS mark FROM c, n"""
    return {
        "p1_counts": marked,
        "p1_found": f"SELECT term, mark FROM ({marked}) WHERE mark IS NOT NULL",
        "p2_found": """SELECT DISTINCT f.seq FROM frontier f
JOIN (SELECT url, min(seq) AS s FROM frontier WHERE url IS NOT NULL GROUP BY url) m ON f.url = m.url AND f.seq > m.s""",
        "p2_totals": """WITH r AS (SELECT seq, bool_or(s > 1) AS seen FROM
  (SELECT seq, dense_rank() OVER (PARTITION BY url ORDER BY seq) AS s FROM frontier WHERE url IS NOT NULL AND seq IS NOT NULL) GROUP BY seq)
SELECT count(*) AS n_rows, count(*) FILTER (NOT seen) AS n_new, count(*) FILTER (seen) AS n_seen, CAST(0 AS BIGINT) AS n_missed, true AS few_wrong FROM r""",
        "p3_cleaned": f"""WITH d0 AS (SELECT DISTINCT seq, doc_id, url, content FROM docs), {_LINES},
r AS (SELECT DISTINCT seq, url, line_no FROM l JOIN k USING (site, k)),
x AS (SELECT seq, doc_id, url, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM d0),
kept AS (SELECT x.seq, x.doc_id, x.url, x.content, coalesce(string_agg(line, chr(10) ORDER BY x.line_no) FILTER (r.line_no IS NULL), '') AS text, count(r.line_no) AS removed
  FROM x LEFT JOIN r ON x.seq = r.seq AND x.url = r.url AND x.line_no = r.line_no GROUP BY ALL)
SELECT d0.seq, d0.doc_id, d0.url, CASE WHEN d0.content IS NULL THEN NULL ELSE kept.text END AS content, CAST(coalesce(removed, 0) AS INTEGER) AS removed
FROM d0 LEFT JOIN kept ON d0.seq = kept.seq AND d0.doc_id IS NOT DISTINCT FROM kept.doc_id AND d0.url IS NOT DISTINCT FROM kept.url AND d0.content = kept.content""",
        "p4_counts": r"""WITH w AS (SELECT DISTINCT seq, content, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS words FROM docs WHERE content IS NOT NULL)
SELECT DISTINCT seq, CAST(len(words) AS BIGINT) AS n_words, CAST(len(list_distinct(words)) AS BIGINT) AS n_types FROM w WHERE len(words) > 0""",
        "p9_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+(?:[''’\-][\p{L}\p{M}\p{N}]+)*') AS words,
  list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))), lambda l: l <> '') AS lines FROM d)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
  CASE WHEN len(words) = 0 THEN 0::DOUBLE ELSE round(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words), 6) END AS mean_word_length,
  CASE WHEN len(lines) = 0 THEN 0::DOUBLE ELSE round(1 - len(list_distinct(lines))::DOUBLE / len(lines), 6) END AS duplicate_lines FROM x""",
        "p3_found": f"WITH {_LINES} SELECT DISTINCT seq, CAST(line_no AS INTEGER) AS line_no FROM l JOIN k USING (site, k)",
    }
