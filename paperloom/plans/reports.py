"""Queries of reports, archives and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from .tables import table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions: purchases accepted, clicks edited, errors rejected."""
    events = table(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "click", "edited").when(F.col("event_type") == "error", "rejected").otherwise("shown")
    return events.select("event_id", "ts", "user_id", what.alias("event"), F.concat(F.lit("type"), (F.col("user_id") % 20).cast("string")).alias("document_type"), "value")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_by(reports.decision_totals(_log(spark, sf_dir), ["document_type"]), "document_type", "n", 15)


def quality_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.decision_totals(_log(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"])


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions whose confidence is a hundredth of their value, on files of a kind for each user."""
    k = F.col("user_id")
    log = _log(spark, sf_dir).select((F.col("value") / 100).alias("confidence"), F.when(k % 13 == 0, "").when(k % 13 != 1, F.concat(F.lit(".x"), (k % 13).cast("string"))).alias("extension"))
    return reports.low_confidence(log, "extension", "confidence")


def review_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions with up to two review codes each."""
    k = F.col("event_id")
    code = lambda part: F.concat(F.lit("C"), (part % 17).cast("string"))
    log = _log(spark, sf_dir).select(F.when(k % 3 == 0, F.array(code(k))).when(k % 3 == 1, F.array(code(k), code(k % 5))).alias("codes"))
    return reports.review_codes(log, "codes")


def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each user, merged."""
    log = _log(spark, sf_dir)
    per = log.groupBy("user_id", "document_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == "edited").alias("e"))
    each = per.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("document_type", "n"))).alias("counts"), F.map_from_entries(F.collect_list(F.struct("document_type", "e"))).alias("edits")
    )
    return reports.merge_reports(each, "counts", "edits")


def edit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    day = F.concat(F.lit(" 0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(".01.2024"))
    proposed = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, day).otherwise(""))
    chosen = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("new "), F.col("p_name")))
    return reports.edit_shapes(parts.select("p_partkey", proposed.alias("proposed"), chosen.alias("chosen")), "proposed", "chosen").drop("proposed", "chosen")


def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 newest records of the log: the limit is the operator's."""
    log = _log(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    return reports.latest(log, "ts", "event_id", 5000).select("event_id", "event")


def archive_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the entries of an archive for each brand, size and type."""
    entries = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_type").alias("archive"), F.concat(F.col("p_name"), F.lit(" file.pdf")).alias("name"))
    return reports.archive_theme(entries, "archive", "name")


def archive_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    entries = parts.select(
        F.concat_ws("-", "p_brand", "p_type").alias("archive"), F.when(F.col("p_size") > 8, ".jpg").otherwise(".txt").alias("ext"),
        (F.col("p_size") * 1000).cast("long").alias("size"), (F.col("p_size") % 7 + 1).cast("long").alias("packed"),
    )
    return reports.archive_profile(entries, "archive", "ext", "size", "packed")


def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries, with extensions by their size; the two most frequent extensions and the first five names."""
    suffix = F.element_at(F.array(*map(F.lit, [".PDF", ".jpg", "", ".tar.gz"])), (F.col("p_size") % 4 + 1).cast("int"))
    entries = table(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_brand", "p_type").alias("archive"), "p_partkey", F.concat(F.lit("in.side/"), F.col("p_name"), suffix).alias("name"), (F.col("p_size") == 50).alias("locked")
    )
    told = reports.archive_contents(entries, "archive", "p_partkey", "name", "locked", most=2, sample=5)
    kinds = F.array_join(F.transform("extensions", lambda x: F.concat_ws(":", x["ext"], x["n"].cast("string"))), ",")
    return told.select("archive", kinds.alias("extensions"), F.array_join("sample", "|").alias("sample"), "encrypted")


def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    fact = lambda c, s: F.struct(F.lit(c).alias("confidence"), F.lit(s).alias("source"))
    facts = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(k % 2 == 0, F.struct(F.lit("document_type"), fact(0.95, "regex"))),
                F.when(k % 3 == 0, F.struct(F.lit("document_date"), fact(0.88, "filesystem"))),
                F.when(k % 5 == 0, F.struct(F.lit("person"), fact(0.7, "llm"))),
                F.when(k % 7 == 0, F.struct(F.lit("subject"), fact(0.6, "metadata"))),
            )
        )
    )
    statuses = F.array_compact(F.array(F.when(k % 4 == 0, F.lit("ENCODING_UNCERTAIN")), F.when(k % 9 == 0, F.lit("MOJIBAKE_SUSPECTED"))))
    media = reports.media_confidence(F.when(k % 3 != 0, F.lit("d")), F.when(k % 2 == 0, "filesystem").otherwise("exif"), F.when(k % 5 == 0, "cam"), k % 9 == 0)
    return orders.select("o_orderkey", F.round(reports.weighted_confidence(facts, statuses), 4).alias("confidence"), F.round(media, 4).alias("media"))


QUERIES = {
    f.__name__: f
    for f in (quality_report, quality_totals, low_confidence, review_codes, merge_reports, edit_shapes, keep_latest, archive_theme, archive_profile, archive_contents, confidence_score)
}
_LOG = """WITH l AS (SELECT *, 'type' || (user_id % 20) AS document_type, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'edited' WHEN 'error' THEN 'rejected' ELSE 'shown' END AS event FROM events)"""
_TOTALS = """count(*) AS n, count(*) FILTER (event = 'accepted') AS accepted, count(*) FILTER (event = 'edited') AS edited,
        count(*) FILTER (event = 'rejected') AS rejected, round(count(*) FILTER (event = 'edited') / count(*), 4) AS edited_share"""
ORACLE_SQL = {
    "quality_report": f"{_LOG} SELECT document_type, {_TOTALS} FROM l GROUP BY document_type ORDER BY n DESC, document_type LIMIT 15",
    "quality_totals": f"{_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, {_TOTALS} FROM l GROUP BY 1",
    "low_confidence": """
        SELECT CASE WHEN user_id % 13 < 2 THEN '—' ELSE '.x' || user_id % 13 END AS extension, count(*) AS n FROM events WHERE coalesce(value / 100, 0) < 0.6
        GROUP BY 1 ORDER BY n DESC, extension LIMIT 10""",
    "review_codes": """
        WITH c AS (SELECT 'C' || event_id % 17 AS code FROM events WHERE event_id % 3 < 2 UNION ALL SELECT 'C' || (event_id % 5) % 17 FROM events WHERE event_id % 3 = 1)
        SELECT code, count(*) AS n FROM c GROUP BY code ORDER BY n DESC, code LIMIT 10""",
    "merge_reports": f"""{_LOG} SELECT document_type AS type, count(*) AS n, count(*) FILTER (event = 'edited') AS edited,
        round(count(*) FILTER (event = 'edited') / count(*), 4) AS edit_share FROM l GROUP BY 1 ORDER BY edited DESC, type LIMIT 15""",
    "edit_shapes": """SELECT p_partkey, p_partkey % 3 = 0 OR p_name LIKE 'new %' AS kept_first_word, p_partkey % 2 = 0 AS dropped_date,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 ELSE p_partkey % 2 = 0 END AS shorter FROM part""",
    "keep_latest": f"{_LOG} SELECT event_id, event FROM l ORDER BY ts DESC, event_id DESC LIMIT 5000",
    "archive_theme": """
        WITH e AS (SELECT p_brand || '-' || p_type AS archive, p_partkey, lower(p_name) || ' file.pdf' AS name FROM part),
        w AS (SELECT DISTINCT archive, p_partkey, unnest(string_split_regex(name, '[\\s_.-]+')) AS word FROM e),
        c AS (SELECT archive, word, count(*) AS hits FROM w WHERE length(word) >= 4 GROUP BY ALL), n AS (SELECT archive, count(*) AS n_entries FROM e GROUP BY 1),
        b AS (SELECT archive, word AS theme, hits, row_number() OVER (PARTITION BY archive ORDER BY hits DESC, word) AS k FROM c)
        SELECT archive, theme, hits, n_entries FROM b JOIN n USING (archive) WHERE k = 1 AND hits >= greatest(3, n_entries // 2)""",
    "archive_profile": """
        SELECT p_brand || '-' || p_type AS archive, count(*) AS n_entries, CAST(sum(p_size * 1000) AS BIGINT) AS n_bytes,
               round(sum(p_size * 1000) / sum(p_size % 7 + 1), 4) AS ratio, sum(p_size * 1000) / sum(p_size % 7 + 1) > 200 AS suspicious,
               count(*) FILTER (p_size > 8) / count(*) >= 0.8 AS holds_scans FROM part GROUP BY 1""",
    "archive_contents": """
        WITH e AS (SELECT p_brand || '-' || p_type AS archive, p_partkey, 'in.side/' || p_name || ['.PDF', '.jpg', '', '.tar.gz'][p_size % 4 + 1] AS name,
            ['.pdf', '.jpg', '', '.gz'][p_size % 4 + 1] AS ext, p_size = 50 AS locked, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS t FROM part),
        c AS (SELECT archive, ext, count(*) AS n, row_number() OVER (PARTITION BY archive ORDER BY count(*) DESC, ext) AS t FROM e GROUP BY archive, ext),
        k AS (SELECT archive, string_agg(ext || ':' || n, ',' ORDER BY t) AS extensions FROM c WHERE t <= 2 GROUP BY archive)
        SELECT archive, extensions, string_agg(name, '|' ORDER BY p_partkey) FILTER (t <= 5) AS sample, bool_or(locked) AS encrypted
        FROM e JOIN k USING (archive) GROUP BY archive, extensions""",
    "confidence_score": """
        WITH k AS (SELECT o_orderkey AS k FROM orders),
        w AS (SELECT k, CASE WHEN k % 2 = 0 THEN 3.0 ELSE 0 END AS a, CASE WHEN k % 3 = 0 THEN 3.0 ELSE 0 END AS b, CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0 END AS c, CASE WHEN k % 7 = 0 THEN 2.0 ELSE 0 END AS d FROM k)
        SELECT k AS o_orderkey, round(CASE WHEN a + b + c + d > 0 THEN (a * 0.95 + b * 0.88 * 0.5 + c * 0.7 * 0.9 + d * 0.6)::DOUBLE / (a + b + c + d) ELSE 0 END
               * CASE WHEN k % 4 = 0 THEN 0.8 ELSE 1 END * CASE WHEN k % 9 = 0 THEN 0.6 ELSE 1 END, 4) AS confidence,
               round(CASE WHEN k % 3 = 0 THEN 0.4 ELSE CASE WHEN k % 5 = 0 THEN least(0.99, CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.97 END + 0.02) ELSE CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.97 END END
                          * CASE WHEN k % 9 = 0 THEN 0.6 ELSE 1 END END, 4)::DOUBLE AS media FROM w""",
}
