"""Queries of typed extraction over documents rendered from orders; expected rows are the orders' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from .rendered import SQL, rendered
from .tables import TEXTS, table


def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_dates(rendered(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "kind", "value", "role")


def pick_document_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.pick_date(extract.extract_dates(rendered(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return found.select("doc_id", F.col("value").alias("doc_date"), "kind")


def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_identifiers(rendered(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "kind", "value")


def pick_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.pick_identifier(extract.extract_identifiers(rendered(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return found.select("doc_id", "kind", "value")


def pick_case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions that name two cases and a proceeding; in every second one far from the start."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.when(k % 2 == 0, F.repeat(F.lit("слово "), F.lit(400))).otherwise(""), F.lit("Решение по делу № А40-"), (k % 1000000).cast("string"), F.lit("/2024. Производство 12345/24/"),
        (k % 1000 + 1000).cast("string"), F.lit("-ИП, затем дело № А41-7/2023."),
    )
    found = extract.extract_identifiers(table(spark, sf_dir, "orders", TEXTS).select("o_orderkey", text.alias("text")), ["o_orderkey"])
    return extract.pick_case_numbers(found, ["o_orderkey"]).select("o_orderkey", F.col("rank").cast("long").alias("rank"), "value")


def taxid_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered ids are valid; the same with the last digit moved on are not."""
    ids = rendered(spark, sf_dir).select("doc_id", "tax_id")
    moved = F.concat(F.left("tax_id", F.lit(9)), ((F.right("tax_id", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return ids.select("doc_id", extract.valid_inn(F.col("tax_id")).alias("valid"), extract.valid_inn(moved).alias("moved_valid"))


def extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_amounts(rendered(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("amount").cast("double").alias("amount"), "currency", "rank")


def extract_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_persons(rendered(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("value").alias("person"), "role")


#: Names of lists: surname, first name, patronymic.
LISTED = (
    "Иванов Иван Иванович", "Петров Пётр Олегович", "Сидоров Семён Павлович", "Кузнецов Андрей Борисович", "Орлов Глеб Денисович",
    "Соколов Егор Захарович", "Волков Кирилл Львович", "Зайцев Матвей Никитич",
)
OFFICES = ("управление образования города", "министерство культуры края", "отдел судебных приставов", "прокуратура области")


def person_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of one to eight names: initials behind, signatures one below the other, initials in front, capitals."""
    k = F.col("o_orderkey")
    full = F.slice(F.array(*map(F.lit, LISTED)), 1, (k % 8 + 1).cast("int"))
    part = lambda n, i: F.split(n, " ")[i]
    initials = lambda n: F.concat(F.left(part(n, 1), F.lit(1)), F.lit("."), F.left(part(n, 2), F.lit(1)), F.lit("."))
    behind = F.transform(full, lambda n: F.concat_ws(" ", part(n, 0), initials(n)))
    front = F.transform(full, lambda n: F.concat_ws(" ", initials(n), part(n, 0)))
    form = F.floor(k / 8) % 4
    body = F.when(form == 0, F.array_join(behind, " ")).when(form == 1, F.array_join(front, "\n")).when(form == 2, F.array_join(front, ", ")).otherwise(F.array_join(F.transform(full, F.upper), ", "))
    docs = table(spark, sf_dir, "orders", TEXTS).select("o_orderkey", F.concat(F.lit("Присутствовали: "), body).alias("text"))
    return extract.extract_persons(docs, ["o_orderkey"]).select("o_orderkey", F.col("value").alias("person"))


def organization_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of companies and authorities."""
    k = F.col("o_orderkey")
    offices = F.array_join(F.slice(F.array(*map(F.lit, OFFICES)), 1, (k % 4 + 1).cast("int")), " и ")
    number = (k % 1000).cast("string")
    company = F.concat(F.lit("ООО «Альфа "), number, F.lit("», общество с ограниченной ответственностью «Бета "), number, F.lit("»"))
    docs = table(spark, sf_dir, "orders", TEXTS).select("o_orderkey", F.concat(F.lit("Стороны: "), company, F.lit(", "), offices).alias("text"))
    return extract.extract_organizations(docs, ["o_orderkey"]).select("o_orderkey", F.col("value").alias("organization"), "role")


def doc_type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame(
        [("Договор займа", ["договор займа"], 9), ("Договор", ["договор"], 5), ("Акт", ["акт сверки", "акт"], 5), ("Иск", ["исковое заявление"], 8), ("Постановление", ["постановление"], 7)],
        "canonical string, markers array<string>, priority int",
    )
    found = extract.pick_type(extract.match_types(rendered(spark, sf_dir), ["doc_id"], kinds), ["doc_id"])
    return found.select("doc_id", F.col("canonical").alias("doc_type"))


def table_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of a customer's documents, as a table would hold them."""
    docs = rendered(spark, sf_dir).select("doc_id", "custkey", "text")
    dates = extract.extract_dates(docs, ["doc_id", "custkey"]).where("kind <> 'short_year' AND role <> 'personal_date'")
    return extract.table_period(dates, ["custkey"])


QUERIES = {
    f.__name__: f
    for f in (
        extract_dates, pick_document_date, extract_identifiers, pick_identifier, pick_case_numbers, taxid_checksum, extract_amounts, extract_persons, person_lists, organization_lists,
        doc_type_match, table_period,
    )
}
_R = f"WITH r AS ({SQL})"
_KIND = "CASE style WHEN 0 THEN 'numeric' WHEN 1 THEN 'iso' ELSE 'verbal' END"
_NUMBERED = "(kind <> 'Договор займа' AND NOT contains(tax_id, CAST(doc_id AS STRING)))"
ORACLE_SQL = {
    "extract_dates": _R
    + f""" SELECT doc_id, {_KIND} AS kind, CAST(doc_date AS STRING) AS value, 'document_date' AS role FROM r
        UNION ALL SELECT doc_id, 'numeric', '1975-03-05', 'personal_date' FROM r
        UNION ALL SELECT doc_id, 'short_year', '11.12.24', 'ambiguous_year' FROM r""",
    "pick_document_date": _R + f" SELECT doc_id, CAST(doc_date AS STRING) AS doc_date, {_KIND} AS kind FROM r",
    "extract_identifiers": _R
    + f""" SELECT doc_id, 'inn' AS kind, tax_id AS value FROM r
        UNION ALL SELECT doc_id, 'contract_number', CAST(doc_id AS STRING) FROM r WHERE kind = 'Договор займа'
        UNION ALL SELECT doc_id, 'document_number', CAST(doc_id AS STRING) FROM r WHERE {_NUMBERED}""",
    "pick_identifier": _R
    + f""" SELECT doc_id, CASE WHEN kind = 'Договор займа' THEN 'contract_number' ELSE 'document_number' END AS kind, CAST(doc_id AS STRING) AS value
        FROM r WHERE kind = 'Договор займа' OR {_NUMBERED}""",
    "pick_case_numbers": """SELECT o_orderkey, r AS rank, CASE WHEN (o_orderkey % 2 = 0) = (r = 1) THEN '12345/24/' || (o_orderkey % 1000 + 1000) || '-ИП' ELSE 'А40-' || (o_orderkey % 1000000) || '/2024' END AS value
        FROM orders, (VALUES (1), (2)) AS ranks(r)""",
    "taxid_checksum": _R + " SELECT doc_id, true AS valid, false AS moved_valid FROM r",
    "extract_amounts": _R + " SELECT doc_id, CAST(amount AS DOUBLE) AS amount, 'RUB' AS currency, 1 AS rank FROM r WHERE amount > 0",
    "extract_persons": _R + " SELECT doc_id, person, 'applicant' AS role FROM r",
    "person_lists": f"""
        WITH n AS (SELECT i, ({list(LISTED)})[i] AS name FROM range(1, 9) t(i))
        SELECT o_orderkey, CASE WHEN (o_orderkey // 8) % 4 = 3 THEN name
            ELSE split_part(name, ' ', 1) || ' ' || left(split_part(name, ' ', 2), 1) || '.' || left(split_part(name, ' ', 3), 1) || '.' END AS person
        FROM orders JOIN n ON i <= o_orderkey % 8 + 1""",
    "organization_lists": f"""
        SELECT o_orderkey, 'ООО "Альфа ' || (o_orderkey % 1000) || '"' AS organization, 'company' AS role FROM orders
        UNION ALL SELECT o_orderkey, 'ООО "Бета ' || (o_orderkey % 1000) || '"', 'company' FROM orders
        UNION ALL SELECT o_orderkey, ({list(OFFICES)})[i], 'authority' FROM orders JOIN range(1, 5) t(i) ON i <= o_orderkey % 4 + 1""",
    "doc_type_match": _R
    + """ SELECT doc_id, CASE kind WHEN 'Договор займа' THEN 'Договор займа' WHEN 'Акт сверки' THEN 'Акт' WHEN 'Исковое заявление' THEN 'Иск'
        ELSE 'Постановление' END AS doc_type FROM r""",
    "table_period": _R
    + """ SELECT custkey, count(DISTINCT doc_date) AS n_dates,
               CASE WHEN year(min(doc_date)) = year(max(doc_date)) THEN CAST(year(min(doc_date)) AS STRING)
                    ELSE CAST(year(min(doc_date)) AS STRING) || '-' || CAST(year(max(doc_date)) AS STRING) END AS period
        FROM r GROUP BY custkey HAVING count(DISTINCT doc_date) >= 4 AND strftime(min(doc_date), '%Y-%m') <> strftime(max(doc_date), '%Y-%m')""",
}
