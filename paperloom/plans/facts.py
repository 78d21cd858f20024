"""Queries of chosen facts, decoding, prompts and the grounding of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from ..sources import decoding, profiles
from .rendered import SQL, rendered
from .tables import table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered document's type and date as facts; each third has no date, each fifth only a weak model's one without evidence."""
    fact = lambda value, source, evidence, confidence: F.struct(value.alias("value"), F.lit(source).alias("source"), evidence.alias("evidence"), F.lit(confidence).alias("confidence"))
    docs = rendered(spark, sf_dir)
    day = F.col("doc_date").cast("string")
    date = F.when(F.col("doc_id") % 5 == 0, fact(day, "llm", F.lit(""), 0.8)).when(F.col("doc_id") % 3 != 0, fact(day, "regex", F.lit("от"), 0.9))
    return docs.select("doc_id", "custkey", fact(F.col("kind"), "regex", F.col("kind"), 0.95).alias("document_type"), date.alias("document_date"))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.evidence_rows(_facts(spark, sf_dir), ["doc_id"], ["document_type", "document_date"])


def explain_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir)
    return rows.select("doc_id", facts.explain_card(rows, {"document_type": "Вид", "document_date": "Дата"}).alias("card"))


def series_fact_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = facts.share_in_series(_facts(spark, sf_dir), "custkey", "document_date", "doc_id")
    return shared.select("doc_id", F.col("document_date.value").alias("value"), F.col("document_date.source").alias("source"), F.round("document_date.confidence", 4).alias("confidence"))


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(spark, sf_dir)
    return docs.select("doc_id", facts.prompt(F.col("text"), F.array("kind", "tax_id"), 100, 50).alias("prompt"))


def ground_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are right, invented, or quote the source in other case."""
    docs = rendered(spark, sf_dir)
    said = F.when(F.col("doc_id") % 3 == 0, F.col("tax_id")).when(F.col("doc_id") % 3 == 1, F.lit("0000000000")).otherwise(F.upper("person"))
    raw = F.concat(F.lit('Вот ответ: {"number": {"value": "'), said, F.lit('", "evidence": ""}, "kind": {"value": "'), "kind", F.lit('", "evidence": "x"}} готово'))
    return facts.ground(docs.select("doc_id", raw.alias("raw")), docs, "doc_id", ["number", "kind"])


def ground_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in other words, invented ones, and some without a quotation; dates that are the source's, or a day later."""
    docs = rendered(spark, sf_dir)
    k = F.col("doc_id") % 4
    label = F.when(k == 0, F.concat(F.lit("Заявителя документы, "), F.lower("kind"))).when(k == 1, F.lit("Приговор суда присяжных")).when(k == 2, F.col("kind")).otherwise(F.lit("Bailiff order"))
    quote = F.when(k == 2, F.lit("")).otherwise(F.concat(F.upper("kind"), F.lit("  №")))
    day = F.date_add("doc_date", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("string")
    raw = F.to_json(F.struct(F.struct(label.alias("value"), quote.alias("evidence")).alias("label"), F.struct(day.alias("value"), F.lit("").alias("evidence")).alias("day")))
    return facts.ground(docs.select("doc_id", raw.alias("raw")), docs, "doc_id", ["label", "day"], labels=("label",), dates=("day",))


def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered texts as bytes of UTF-8, and of UTF-8 and UTF-16 in both orders with a mark in front."""
    docs = rendered(spark, sf_dir)
    body = F.encode("text", "UTF-8")
    k = F.col("doc_id") % 4
    wide = lambda mark, page: F.concat(F.unhex(F.lit(mark)), F.encode("text", page))
    content = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), body)).when(k == 1, wide("FFFE", "UTF-16LE")).when(k == 2, wide("FEFF", "UTF-16BE")).otherwise(body)
    found = decoding.decode_bytes(docs.select("doc_id", content.alias("content")), "content")
    return found.select("doc_id", "encoding", F.sha2("text", 256).alias("text_sha256"))


def unread_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as the pages of a run, in folders that a person or a device named."""
    people = table(spark, sf_dir, "customer")
    folder = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("Договоры страны "), F.col("c_nationkey").cast("string"))).otherwise("scan001")
    pages = people.select("c_custkey", "c_nationkey", folder.alias("folder"), ((F.col("c_nationkey") % 3 == 0) & (F.col("c_custkey") % 2 == 0)).alias("informative"))
    return facts.name_unread_runs(pages, "c_nationkey", "folder", "informative").select("c_custkey", "label")


def date_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    picked = facts.date_fallback(F.when(k % 3 == 0, day), F.when(k % 2 == 0, day), day)
    return orders.select("o_orderkey", picked.alias("d")).select("o_orderkey", "d.*")


def json_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties one level further in."""
    events = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "more": {"props": '), "props", F.lit(', "list": [{"ok": true}]}}'))
    return events.select("event_id", F.array_join(profiles.json_fragments(text), "; ").alias("fragments"))


QUERIES = {f.__name__: f for f in (evidence_rows, explain_card, series_fact_sharing, prompt_context, ground_answers, ground_labels, decode_bytes, unread_run_names, date_sources, json_fragments)}
_R = f"WITH r AS ({SQL})"
_OWN = "doc_id % 5 <> 0 AND doc_id % 3 <> 0"
ORACLE_SQL = {
    "evidence_rows": _R
    + f""" SELECT doc_id, 'document_type' AS kind, kind AS value, 'regex' AS source, kind AS evidence, 0.95::DOUBLE AS confidence FROM r
        UNION ALL SELECT doc_id, 'document_date', CAST(doc_date AS STRING), 'regex', 'от', 0.9::DOUBLE FROM r WHERE {_OWN}""",
    "explain_card": _R + f" SELECT doc_id, 'Вид: ' || kind || ' (' || kind || ')' || CASE WHEN {_OWN} THEN chr(10) || 'Дата: ' || CAST(doc_date AS STRING) || ' (от)' ELSE '' END AS card FROM r",
    "series_fact_sharing": _R
    + f""", d AS (SELECT custkey, arg_min(CAST(doc_date AS STRING), doc_id) AS v FROM r WHERE {_OWN} GROUP BY custkey)
        SELECT doc_id, CASE WHEN {_OWN} THEN CAST(doc_date AS STRING) ELSE v END AS value,
               CASE WHEN {_OWN} THEN 'regex' WHEN v IS NOT NULL THEN 'series' END AS source,
               CASE WHEN {_OWN} THEN 0.9::DOUBLE WHEN v IS NOT NULL THEN round(0.9::DOUBLE * 0.85::DOUBLE, 4) END AS confidence
        FROM r LEFT JOIN d USING (custkey)""",
    "prompt_context": _R + " SELECT doc_id, kind || chr(10) || tax_id || chr(10) || '---' || chr(10) || left(text, 100) || chr(10) || '...' || chr(10) || right(text, 50) AS prompt FROM r",
    "ground_answers": _R
    + """ SELECT doc_id, 'number' AS kind, CASE doc_id % 3 WHEN 0 THEN tax_id WHEN 1 THEN '0000000000' ELSE upper(person) END AS value, doc_id % 3 <> 1 AS supported FROM r
        UNION ALL SELECT doc_id, 'kind', kind, true FROM r""",
    "ground_labels": _R
    + """ SELECT doc_id, 'label' AS kind, CASE doc_id % 4 WHEN 0 THEN 'Заявителя документы, ' || lower(kind) WHEN 1 THEN 'Приговор суда присяжных' WHEN 2 THEN kind ELSE 'Bailiff order' END AS value,
            doc_id % 4 = 0 AS supported FROM r
        UNION ALL SELECT doc_id, 'day', CAST(CAST(doc_date + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS DATE) AS VARCHAR), doc_id % 3 <> 0 FROM r""",
    "decode_bytes": _R + " SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 'utf-16' ELSE 'utf-8' END AS encoding, sha256(text) AS text_sha256 FROM r",
    "unread_run_names": """
        WITH n AS (SELECT c_nationkey, bool_or(c_nationkey % 3 = 0 AND c_custkey % 2 = 0) AS known FROM customer GROUP BY 1)
        SELECT c_custkey, CASE WHEN NOT known THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Договоры страны ' || c_nationkey ELSE 'Скан' END END AS label FROM customer JOIN n USING (c_nationkey)""",
    "date_sources": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'regex' WHEN o_orderkey % 2 = 0 THEN 'metadata' ELSE 'filesystem' END AS source,
            CASE WHEN o_orderkey % 3 = 0 THEN 0.9::DOUBLE WHEN o_orderkey % 2 = 0 THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
            CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'DATE_SOURCE_FILE_PROPERTY' ELSE 'DATE_SOURCE_FILESYSTEM' END AS status FROM orders""",
    "json_fragments": "SELECT event_id, 'type: ' || event_type || '; k: ' || (props->>'k') || '; ok: true' AS fragments FROM events",
}
