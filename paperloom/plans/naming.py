"""Queries of names: stems, safety, review and whole names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import naming
from .rendered import SQL, rendered
from .tables import table

STEMS = ("IMG_0032", "20260818_142203", "Новый документ 2", "Договор займа", "седой дом газ", "final_v2", "scan of contract", "Отчёт", "Иск Иванова к Петрову", "")
MEANINGFUL = (False, False, False, True, True, False, True, False, True, False)


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.withColumn("stem", F.element_at(F.array(*map(F.lit, STEMS)), (F.col("p_partkey") % len(STEMS) + 1).cast("int")))


def meaningful_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stems(spark, sf_dir).select("p_partkey", naming.meaningful_stem(F.col("stem")).alias("meaningful"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " / "), F.lit(":<"), F.col("p_size").cast("string"), F.lit(">?. "))
    return parts.select("p_partkey", naming.safe_filename(raw, F.lit("PDF")).alias("name"), naming.is_safe_filename(raw).alias("raw_is_safe"))


def build_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(spark, sf_dir).select(
        "doc_id", "kind", F.col("doc_date").cast("string").alias("doc_date"), F.col("doc_id").cast("string").alias("number"), "person",
        F.when(F.col("doc_id") % 10 == 0, "том_1").alias("series"), F.lit(".PDF").alias("ext"),
    )
    return naming.build_names(docs).select("doc_id", "name")


def name_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one fault each, in turn."""
    docs = rendered(spark, sf_dir)
    day = F.date_format("doc_date", "dd.MM.yyyy")
    name = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Акт_"), day, F.lit("_01.01.2001.pdf")))
        .when(F.col("doc_id") % 5 == 1, F.lit("Акт_01.01.1901.pdf"))
        .when(F.col("doc_id") % 5 == 2, F.lit("акт__сверки.pdf"))
        .when(F.col("doc_id") % 5 == 3, F.lit("Акт?.pdf"))
        .otherwise(F.concat(F.lit("Акт_"), day, F.lit(".pdf")))
    )
    told = docs.select("doc_id", naming.review_name(name, expected_date=day).alias("issues"))
    return told.select("doc_id", F.array_join("issues", ",").alias("issues"), naming.is_blocking(F.col("issues")).alias("blocking"))


QUERIES = {f.__name__: f for f in (meaningful_stem, safe_names, build_names, name_review)}
_YES = ", ".join(str(i) for i, m in enumerate(MEANINGFUL) if m)
ORACLE_SQL = {
    "meaningful_stem": f"SELECT p_partkey, p_partkey % {len(STEMS)} IN ({_YES}) AS meaningful FROM part",
    "safe_names": "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size || '.pdf' AS name, false AS raw_is_safe FROM part",
    "build_names": f"""
        WITH r AS ({SQL}) SELECT doc_id, replace(kind, ' ', '_') || CASE WHEN length(CAST(doc_id AS VARCHAR)) > 0 THEN '_' || doc_id ELSE '' END || '_'
            || split_part(person, ' ', 1) || '_' || left(split_part(person, ' ', 2), 1) || '.' || left(split_part(person, ' ', 3), 1)
            || '_' || strftime(doc_date, '%d.%m.%Y') || CASE WHEN doc_id % 10 = 0 THEN '_том_1' ELSE '' END || '.pdf' AS name FROM r""",
    "name_review": f"""
        WITH r AS ({SQL}) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'many_dates' WHEN 1 THEN 'wrong_date' WHEN 2 THEN 'double_separator,lowercase_start' WHEN 3 THEN 'unsafe' ELSE '' END AS issues,
            doc_id % 5 IN (0, 1, 3) AS blocking FROM r""",
}
