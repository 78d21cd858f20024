"""Queries over the corpus inventory: copies, summaries, periods, text quality, series and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..operators import series
from ..sources import files
from .tables import table


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return files.exact_copies(docs, "sha256", "doc_id")


def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.octet_length("text").cast("long").alias("size"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"),
        F.sum("size").alias("n_bytes"),
        F.count_if(F.col("size") > 10_000).alias("large"),
        F.count_if(F.col("lang") == "en").alias("english"),
    )


def extension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extension_summary(table(spark, sf_dir, "documents").select(F.col("source").alias("ext")), "ext")


def period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return files.changed_within(orders, "o_orderdate", 365, "1998-08-01").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed")
    )


def ignored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(".tmp")).alias("name"))
    return files.not_ignored(names, "name", ["red *", "*widget.tmp", "Small Ring.tmp"])


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rounded = [F.round(c, 4).alias(c) for c in ("score", "latin_ratio", "replacement_ratio", "control_ratio", "mojibake_ratio", "other_script_ratio")]
    return told.select("doc_id", *rounded, F.array_join("statuses", ",").alias("statuses"))


def language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.language_hint(F.col("text")).alias("hint"))


def mixed_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th customer's name gets a Cyrillic look-alike, which the operator must find."""
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 50 == 0, F.regexp_replace("c_name", "Cus", "Сus")).otherwise(F.col("c_name")).alias("name")
    )
    found = named.select("c_custkey", quality.mixed_words(F.col("name")).alias("words")).where(F.size("words") > 0)
    return found.select("c_custkey", F.array_join("words", ",").alias("words"))


PAGES = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("dir"),
        F.concat(F.lit("scan_"), F.regexp_extract("url", r"/([0-9]+)", 1)).alias("stem"),
        F.lit(".jpg").alias("ext"),
        F.col("page_id").alias("ord"),
    )


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.page_runs(_page_files(spark, sf_dir), ["dir", "ext"], most_gap=30)
    return found.select("ord", "dir", "stem", "number", F.col("page").cast("long").alias("page"), "total", "page_label", "position")


def multi_volume_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    named = talks.select(
        F.concat(F.lit("dir"), F.col("conv_id") % 7).alias("dir"),
        F.concat(F.lit("Дело "), F.col("conv_id").cast("string"), F.lit(" том "), (F.col("turn") + 1).cast("string")).alias("stem"),
        F.lit(".pdf").alias("ext"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )
    found = series.detect_series(named)
    return found.select("ord", "series_base", "part", "total", series.part_segment(F.col("series_label"), F.col("part"), F.col("total")).alias("segment"))


def page_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sample_pages(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2, 1)


def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.with_quality(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    rolled = series.page_quality(told, "conv_id", "text", "latin_ratio")
    return rolled.select("conv_id", "n_pages", "n_chars", F.round("quality", 4).alias("quality"), F.round("chars_per_page", 4).alias("chars_per_page"), "needs_ocr")


def batch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs of pages; a folder for each fifty of them."""
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") / 50).cast("long").alias("root"), "conv_id")
    return series.batch_segments(talks, "root", "conv_id", 4, 2)


def listing_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), "p_partkey", F.col("p_name").alias("name"))
    return files.listing(parts, "folder", "name", "p_partkey", 5).withColumn("place", F.col("place").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_duplicates, inventory_summary, extension_summary, period_filter, ignored_names, text_quality, language_hint, mixed_alphabet,
        page_runs, multi_volume_series, page_sampling, page_rollup, batch_segments, listing_topn,
    )
}
_COUNTS = """
  length(regexp_replace(p, '[^A-Za-z]', '', 'g')) AS latin,
  len(regexp_extract_all(p, '\\p{L}')) AS letters,
  len(regexp_extract_all(p, '[ÐÑÂÃ°µ¾¸â€ŒŽšœžŸ¤¦§¨©ª«¬­®¯]')) AS moji,
  len(regexp_extract_all(p, chr(65533))) AS repl,
  len(regexp_extract_all(p, '\\p{Cc}')) - len(regexp_extract_all(p, '[\\n\\r\\t]')) AS ctl"""
ORACLE_SQL = {
    "exact_duplicates": """
        SELECT doc_id, source, sha256(text) AS sha256, min(doc_id) OVER w AS original_id, count(*) OVER w AS n_copies,
               doc_id <> min(doc_id) OVER w AS is_copy
        FROM documents WINDOW w AS (PARTITION BY text)""",
    "inventory_summary": """
        SELECT source, count(*) AS found, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes,
               count(*) FILTER (strlen(text) > 10000) AS large, count(*) FILTER (lang = 'en') AS english
        FROM documents GROUP BY source""",
    "extension_summary": """
        WITH c AS (SELECT source AS ext, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY n DESC, ext) AS k FROM c)
        SELECT CASE WHEN k <= 6 THEN ext ELSE '...' END AS ext, CAST(sum(n) AS BIGINT) AS n_files FROM r GROUP BY 1""",
    "period_filter": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS changed FROM orders
        WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY""",
    "ignored_names": """
        SELECT p_partkey, p_name || '.tmp' AS name FROM part
        WHERE NOT (lower(p_name) LIKE 'red %' OR lower(p_name) LIKE '%widget' OR lower(p_name) = 'small ring')""",
    "text_quality": f"""
        WITH p AS (SELECT doc_id, coalesce(text, '') AS p FROM documents),
        c AS (SELECT doc_id, length(p) AS n, {_COUNTS} FROM p),
        r AS (SELECT doc_id, n, latin, letters - latin AS other, CASE WHEN n > 0 THEN latin / n ELSE 0 END AS latin_ratio,
                     CASE WHEN n > 0 THEN repl / n ELSE 0 END AS replacement_ratio, CASE WHEN n > 0 THEN ctl / n ELSE 0 END AS control_ratio,
                     CASE WHEN n > 0 THEN moji / n ELSE 0 END AS mojibake_ratio,
                     CASE WHEN letters > 0 THEN greatest(0, letters - latin) / letters ELSE 0 END AS other_script_ratio FROM c),
        s AS (SELECT *, 1.0 - least(1.0, replacement_ratio * 12) - least(1.0, control_ratio * 20) - least(0.8, mojibake_ratio * 8)
                 - CASE WHEN other > 3 AND other_script_ratio > 0.15 THEN least(0.9, other_script_ratio * 1.2) ELSE 0 END
                 - CASE WHEN n >= 40 AND latin / n < 0.25 THEN 0.25 ELSE 0 END AS raw FROM r)
        SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, raw)) END, 4) AS score, round(latin_ratio, 4) AS latin_ratio,
               round(replacement_ratio, 4) AS replacement_ratio, round(control_ratio, 4) AS control_ratio,
               round(mojibake_ratio, 4) AS mojibake_ratio, round(other_script_ratio, 4) AS other_script_ratio,
               concat_ws(',', CASE WHEN replacement_ratio > 0.005 OR (other > 3 AND other_script_ratio > 0.4) OR control_ratio > 0.02 THEN 'ENCODING_UNCERTAIN' END,
                         CASE WHEN mojibake_ratio > 0.02 THEN 'MOJIBAKE_SUSPECTED' END) AS statuses
        FROM s""",
    "language_hint": """
        WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
                          len(regexp_extract_all(text, '\\p{Cyrillic}')) AS cyr FROM documents)
        SELECT doc_id, CASE WHEN latin + cyr = 0 THEN '' WHEN cyr >= 3 * latin THEN 'ru' WHEN latin >= 3 * cyr THEN 'en' ELSE 'mixed' END AS hint FROM c""",
    "mixed_alphabet": "SELECT c_custkey, 'Сustomer' AS words FROM customer WHERE c_custkey % 50 = 0",
    "page_runs": """
        WITH f AS (SELECT page_id AS ord, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS dir, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages),
        d AS (SELECT *, CAST(num AS INT) AS number, length(num) AS wide,
                     row_number() OVER (PARTITION BY dir, length(num), CAST(num AS INT) ORDER BY ord) AS turn FROM f WHERE num <> ''),
        g AS (SELECT *, CASE WHEN number - lag(number) OVER w > 30 THEN 1 ELSE 0 END AS new FROM d WHERE turn = 1 WINDOW w AS (PARTITION BY dir, wide ORDER BY number)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY dir, wide ORDER BY number) AS run FROM g),
        t AS (SELECT *, row_number() OVER (PARTITION BY dir, wide, run ORDER BY number) AS page, count(*) OVER (PARTITION BY dir, wide, run) AS total FROM r)
        SELECT ord, dir, 'scan_' || num AS stem, number, page, total,
               'стр_' || lpad(CAST(page AS VARCHAR), CAST(length(CAST(total AS VARCHAR)) AS INT), '0') AS page_label, 'tail' AS position FROM t WHERE total >= 2""",
    "multi_volume_series": """
        WITH c AS (SELECT conv_id, turn, max(turn + 1) OVER w AS most, count(DISTINCT turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id))
        SELECT conv_id * 1000 + turn AS ord, 'Дело ' || conv_id AS series_base, CAST(turn + 1 AS INT) AS part, CAST(greatest(most, n) AS INT) AS total,
               'том_' || (turn + 1) AS segment FROM c WHERE n >= 2""",
    "page_sampling": """
        SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS u,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations) WHERE u <= 2 OR d <= 1""",
    "page_rollup": """
        WITH q AS (SELECT conv_id, coalesce(length(text), 0) AS n,
                          CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '[A-Za-z]')) / length(text) END AS s FROM conversations)
        SELECT conv_id, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars, round(avg(s), 4) AS quality,
               round(sum(n) / count(*), 4) AS chars_per_page, sum(n) / count(*) < 24 OR avg(s) < 0.55 AS needs_ocr FROM q GROUP BY conv_id""",
    "batch_segments": """
        WITH RECURSIVE r AS (SELECT CAST(floor(conv_id / 50) AS BIGINT) AS root, conv_id, row_number() OVER (PARTITION BY CAST(floor(conv_id / 50) AS BIGINT) ORDER BY conv_id, turn) AS k FROM conversations),
        f AS (SELECT root, conv_id, k, CAST(0 AS BIGINT) AS batch, 1 AS held FROM r WHERE k = 1
              UNION ALL SELECT r.root, r.conv_id, r.k,
                CASE WHEN (held >= 4 AND r.conv_id <> f.conv_id) OR held >= 8 THEN batch + 1 ELSE batch END,
                CASE WHEN (held >= 4 AND r.conv_id <> f.conv_id) OR held >= 8 THEN 1 ELSE held + 1 END
              FROM f JOIN r ON r.root = f.root AND r.k = f.k + 1)
        SELECT root, conv_id, batch, count(*) AS n_files FROM f GROUP BY ALL""",
    "listing_topn": """
        SELECT folder, p_partkey, name, place, hidden FROM (SELECT p_brand AS folder, p_partkey, p_name AS name,
            row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS place, greatest(0, count(*) OVER (PARTITION BY p_brand) - 5) AS hidden FROM part) WHERE place <= 5""",
}
