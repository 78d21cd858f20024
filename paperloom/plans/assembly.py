"""Queries of the assembly of facts, of names by category, and of the smaller tests and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assembly, naming, planning
from ..sources import decoding, readers
from .rendered import SQL, rendered
from .tables import table

#: Categories in turn, by the order's key.
TURNS = ("document", "image", "data", "email", "archive", "geodata", "image")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each rendered document; its category and what it lacks follow its number."""
    docs = rendered(spark, sf_dir)
    at = F.col("doc_id")
    day = F.col("doc_date").cast("string")
    some = lambda test, value: F.when(test, value)
    return docs.select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, TURNS)), (at % 7 + 1).cast("int")).alias("category"),
        some((at % 7 == 0) | ((at % 7 == 6) & (at % 2 == 0)), F.col("kind")).alias("kind"),
        some(at % 3 == 0, day).alias("text_date"), some(at % 3 < 2, F.concat(F.lit("2001"), F.substring(day, 5, 6))).alias("property_date"), day.alias("file_date"),
        F.col("tax_id").alias("number"), some(at % 2 == 0, F.array("person")).alias("persons"), F.array(F.concat(F.lit("ООО "), F.col("custkey").cast("string"))).alias("organizations"),
        F.lit("t").alias("title"), some(at % 5 > 0, F.col("doc_date").cast("timestamp")).alias("taken"), F.lit("2020-01-02 03:04:05").cast("timestamp").alias("modified"),
        F.lit("Camera").alias("device"), F.col("person").alias("correspondent"), F.concat(F.lit("Re "), F.col("custkey").cast("string")).alias("mail_subject"),
        some(at % 2 == 0, F.lit("отчёты")).alias("theme"), F.concat(F.lit("Маршрут "), F.col("custkey").cast("string")).alias("track_name"), day.alias("track_date"),
        some(at % 4 == 0, F.lit("2019-2021")).alias("table_period"),
    )


def fact_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = assembly.assemble_facts(_files(spark, sf_dir))
    value = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(""))
    return told.select(
        "doc_id", "category", value("document_type").alias("type"), value("document_date").alias("date"), F.coalesce("document_date.source", F.lit("")).alias("date_source"),
        value("document_number").alias("number"), F.array_join("people", "; ").alias("people"), value("subject").alias("subject"), F.array_join("statuses", ",").alias("statuses"),
    )


def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = assembly.assemble_facts(_files(spark, sf_dir).drop("organizations").withColumn("organizations", F.array().cast("array<string>")))
    files = files.withColumns({"stem": F.lit("Договор займа"), "keep": F.col("doc_id") % 10 == 3, "ext": F.lit(".dat"), "series": F.lit(None).cast("string")})
    return naming.category_names(files).select("doc_id", "name")


def person_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the sections that the bits of a key choose; every second one long."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    parts = [F.when(F.col("o_orderkey").bitwiseAND(1 << i) != 0, F.lit(f"{words[0].upper()}: x\n")) for i, words in enumerate(assembly.PERSON_SECTIONS[:8])]
    text = F.concat(F.array_join(F.array_compact(F.array(*parts)), ""), F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("q "), 700)).otherwise(""))
    return orders.select("o_orderkey", assembly.person_sections(text).alias("n_sections"), assembly.is_person_report(text).alias("is_report"))


def large_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    width = F.when(F.col("p_partkey") % 9 > 0, F.col("p_size") * 50)
    return parts.select("p_partkey", assembly.is_large_image(width, F.lit(600)).alias("large"))


def metadata_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    size = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    later = F.col("l_shipdate").cast("timestamp") + F.when((F.col("l_linenumber") % 2 == 0) | (F.col("l_quantity") > 25), F.expr("INTERVAL '1' SECOND")).otherwise(F.expr("INTERVAL '2' SECOND"))
    kept = planning.metadata_preserved(size, F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")), F.col("l_shipdate").cast("timestamp"), later)
    return lines.select("l_orderkey", "l_linenumber", kept.alias("preserved"))


def plan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    name = F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))
    plan = orders.select(F.col("o_custkey").alias("dir"), name.alias("name"), F.concat(F.lit("T"), name).alias("target"), F.lit(True).alias("selected"), F.lit("OK").alias("status"))
    other = F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    fresh = orders.withColumn("_least", other).where("o_orderkey % 3 = 0")
    target = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("tn"), F.col("_least").cast("string"))).otherwise(F.concat(F.lit("new"), name))
    fresh = fresh.select(F.col("o_custkey").alias("dir"), name.alias("name"), target.alias("target"), F.lit(True).alias("selected"), F.lit("OK").alias("status"))
    return planning.upsert(plan, fresh, order=F.substring("name", 2, 20).cast("long"))


def plan_upsert_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row of a folder is analysed again; half of those want one new name, the others that of a row that is replaced, too."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    name = F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))
    plan = orders.select(F.col("o_custkey").alias("dir"), name.alias("name"), F.concat(F.lit("T"), name).alias("target"), F.lit(True).alias("selected"), F.lit("OK").alias("status"))
    again = orders.where("o_orderkey % 2 = 0").withColumn("_next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    target = F.when(F.col("o_orderkey") % 4 == 0, F.when(F.col("o_orderkey") % 3 == 0, "X.txt").otherwise("x.TXT")).otherwise(F.concat(F.lit("tN"), F.coalesce("_next", "o_orderkey").cast("string")))
    fresh = again.select(F.col("o_custkey").alias("dir"), name.alias("name"), target.alias("target"), F.lit(True).alias("selected"), F.lit("OK").alias("status"))
    return planning.upsert(plan, fresh, order=F.substring("name", 2, 20).cast("long"))


def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return planning.merge_histories(orders, "o_custkey", "o_orderkey")


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_discount").cast("double").alias("confidence"),
    )
    return assembly.top_candidates(lines, ["doc_id"], 5)


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(spark, sf_dir)
    rows = lambda value, kind, confidence: docs.select("doc_id", F.lit(kind).alias("kind"), value.alias("value"), F.lit(confidence).alias("confidence"))
    text = rows(F.col("doc_date").cast("string"), "date", 0.93).unionByName(rows(F.col("tax_id"), "inn", 0.97))
    day = F.when(F.col("doc_id") % 2 == 0, F.col("doc_date")).otherwise(F.date_add("doc_date", 1)).cast("string")
    name = rows(day, "date", 0.95).unionByName(rows(F.col("doc_id").cast("string"), "number", 0.95))
    return assembly.with_name_candidates(text, name, ["doc_id"])


def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", F.upper("p_brand"), F.initcap("p_name"), F.lower("p_brand")), " ").alias("words"))
    return parts.select("p_partkey", F.array_join(assembly.distinct_in_order(F.col("words")), "|").alias("words"))


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    size = (F.col("l_orderkey") * F.pow(F.lit(32.0), F.col("l_linenumber"))).cast("long")
    return lines.select("l_orderkey", "l_linenumber", assembly.size_label(size).alias("label"), assembly.confidence_bucket(F.col("l_linenumber") / 5.0 - 0.07).alias("bucket"))


def sheet_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    tabs = F.array(F.concat(F.lit("Лист"), F.col("p_partkey").cast("string")), F.lit("Sheet 2"), F.lit(" 2024 "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))
    types = F.array("p_brand", F.element_at(F.split("p_name", " "), 1))
    return parts.select("p_partkey", assembly.sheet_subject(tabs, F.col("p_brand")).alias("subject"), F.coalesce(assembly.type_on_sheet(types, F.array_compact(tabs)), F.lit("")).alias("type"))


def opening_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(spark, sf_dir)
    told = assembly.opening_type(F.lit("Письмо"), F.when(F.col("doc_id") % 3 == 0, 0.8).otherwise(0.3), F.col("text"), F.array(*map(F.lit, ("договор", "Договор займа", "акт"))))
    found = docs.select("doc_id", told.alias("told"))
    return found.select("doc_id", F.coalesce("told.value", F.lit("")).alias("type"), F.coalesce("told.confidence", F.lit(0.0)).alias("confidence"))


def run_fact_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages; each third has a type, each fifth a date."""
    fact = lambda v, c: F.struct(v.alias("value"), F.lit("regex").alias("source"), v.alias("evidence"), c.alias("confidence"))
    pages = rendered(spark, sf_dir).select(
        "custkey", "doc_id", F.when(F.col("doc_id") % 3 == 0, fact(F.col("kind"), F.lit(0.9))).alias("document_type"),
        F.when(F.col("doc_id") % 5 == 0, fact(F.col("doc_date").cast("string"), F.lit(0.8))).alias("document_date"),
        F.when(F.col("doc_id") % 2 == 0, F.array("person")).otherwise(F.array().cast("array<string>")).alias("people"),
    )
    shared = assembly.share_in_run(pages, "custkey", "doc_id", ["document_type", "document_date"], "people")
    value = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(""))
    return shared.select("doc_id", value("document_type").alias("type"), value("document_date").alias("date"), F.coalesce("document_date.confidence", F.lit(0.0)).alias("confidence"), F.array_join("people", "; ").alias("people"))


def finalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decoding.finalized(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return told.select("doc_id", F.length("text").cast("long").alias("n_chars"), "truncated", F.array_contains("statuses", "EMPTY_DOCUMENT").alias("empty"), F.array_contains("statuses", "MIXED_ALPHABET_SUSPECTED").alias("mixed"), "hint")


def reader_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a text, a JSON and an XML file, in turn."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    at = F.col("p_partkey") % 4
    kind = F.element_at(F.array(*map(F.lit, ("txt", "json", "xml", "bin"))), (at + 1).cast("int"))
    body = F.when(at == 1, F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))).when(at == 2, F.concat(F.lit("<a><b>"), F.col("p_name"), F.lit("</b><c>"), F.col("p_brand"), F.lit("</c></a>"))).otherwise(F.col("p_name"))
    files = parts.select("p_partkey", kind.alias("kind"), F.lit("other").alias("category"), body.alias("content"))
    return readers.read_all(files, "content").select("p_partkey", F.coalesce("text", F.lit("")).alias("text"), "reader")


QUERIES = {
    f.__name__: f
    for f in (
        fact_assembly, category_names, person_report, large_images, metadata_preserved, plan_upsert, plan_upsert_clash, history_merge, top_candidates, name_candidates,
        distinct_in_order, size_labels, sheet_subjects, opening_types, run_fact_sharing, finalize_text, reader_registry,
    )
}
_R = f"WITH r AS ({SQL})"
_F = f"""
    WITH r AS ({SQL}), f AS (
      SELECT *, ['document', 'image', 'data', 'email', 'archive', 'geodata', 'image'][doc_id % 7 + 1] AS category, CAST(doc_date AS VARCHAR) AS day,
             CASE WHEN doc_id % 7 = 0 OR (doc_id % 7 = 6 AND doc_id % 2 = 0) THEN kind END AS k,
             CASE WHEN doc_id % 3 = 0 THEN CAST(doc_date AS VARCHAR) END AS text_date, CASE WHEN doc_id % 3 < 2 THEN '2001' || substr(CAST(doc_date AS VARCHAR), 5, 6) END AS property_date
      FROM r), g AS (
      SELECT *, category = 'image' AND k IS NULL AS media FROM f), a AS (
      SELECT *, CASE WHEN media THEN '' ELSE coalesce(k, CASE category WHEN 'email' THEN 'Письмо' WHEN 'archive' THEN 'Архив' WHEN 'geodata' THEN 'Трек' WHEN 'data' THEN 'Таблица' END, '') END AS type,
             CASE WHEN media THEN CASE WHEN doc_id % 5 > 0 THEN day || '_00-00-00' ELSE '2020-01-02_03-04-05' END
                  WHEN category = 'email' THEN coalesce(property_date, text_date, day) WHEN category = 'geodata' THEN day
                  WHEN category = 'data' AND doc_id % 4 = 0 THEN '2019-2021' ELSE coalesce(text_date, property_date, day) END AS date,
             CASE WHEN media THEN CASE WHEN doc_id % 5 > 0 THEN 'metadata' ELSE 'filesystem' END
                  WHEN category = 'email' THEN CASE WHEN property_date IS NOT NULL THEN 'metadata' WHEN text_date IS NOT NULL THEN 'regex' ELSE 'filesystem' END
                  WHEN category = 'geodata' THEN 'metadata' WHEN category = 'data' AND doc_id % 4 = 0 THEN 'content'
                  WHEN text_date IS NOT NULL THEN 'regex' WHEN property_date IS NOT NULL THEN 'metadata' ELSE 'filesystem' END AS date_source,
             CASE WHEN category IN ('document', 'data') OR k IS NOT NULL THEN tax_id ELSE '' END AS number,
             CASE WHEN media THEN 'Camera' WHEN category = 'email' THEN 'Re ' || custkey WHEN category = 'archive' THEN CASE WHEN doc_id % 2 = 0 THEN 'отчёты' ELSE '' END
                  WHEN category = 'geodata' THEN 'Маршрут ' || custkey ELSE 't' END AS subject
      FROM g)"""
_SECTIONS = " + ".join(f"CASE WHEN o_orderkey & {1 << i} <> 0 THEN 1 ELSE 0 END" for i in range(8))
ORACLE_SQL = {
    "fact_assembly": _F + """
        SELECT doc_id, category, type, date, date_source, number,
               CASE WHEN media OR category IN ('archive', 'geodata') THEN '' WHEN category = 'email' THEN person
                    ELSE CASE WHEN doc_id % 2 = 0 THEN person || '; ' ELSE '' END || 'ООО ' || custkey END AS people, subject,
               concat_ws(',', CASE WHEN date_source = 'filesystem' AND NOT media THEN 'DATE_SOURCE_FILESYSTEM' END,
                 CASE WHEN date_source = 'metadata' AND category IN ('document', 'archive') THEN 'DATE_SOURCE_FILE_PROPERTY' END) AS statuses
        FROM a""",
    "category_names": _F + """,
        n AS (SELECT *, regexp_replace(date, '^(\\d{4})-(\\d{2})-(\\d{2})', '\\3.\\2.\\1') AS day_in_name FROM a),
        p AS (SELECT *, CASE WHEN custkey % 4 = 0 THEN 'Иванов_И.И' WHEN custkey % 4 = 1 THEN 'Петрова_А.С' WHEN custkey % 4 = 2 THEN 'Сидоров_П.О' ELSE 'Кузнецова_М.И' END AS who FROM n)
        SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'Договор займа' || CASE WHEN date_source = 'filesystem' OR (date_source = 'metadata' AND category IN ('document', 'archive')) THEN '' ELSE '_' || day_in_name END || '.dat' ELSE concat_ws('_',
            CASE WHEN media THEN NULL ELSE replace(type, ' ', '_') END,
            CASE WHEN NOT media AND category IN ('document', 'data', 'image') THEN number END,
            CASE WHEN category = 'email' THEN who WHEN NOT media AND category IN ('document', 'data', 'image') AND doc_id % 2 = 0 THEN who END,
            CASE WHEN category = 'geodata' THEN 'Маршрут_' || custkey WHEN category = 'email' THEN 'Re_' || custkey WHEN category = 'archive' AND doc_id % 2 = 0 THEN 'отчёты' END,
            day_in_name, CASE WHEN media THEN 'Camera' END) || '.dat' END AS name
        FROM p""",
    "person_report": f"SELECT o_orderkey, {_SECTIONS} AS n_sections, {_SECTIONS} >= 5 OR ({_SECTIONS} = 4 AND o_orderkey % 2 = 0) AS is_report FROM orders",
    "large_images": "SELECT p_partkey, p_partkey % 9 = 0 OR p_size * 50 * 600 >= 700000 AS large FROM part",
    "metadata_preserved": """SELECT l_orderkey, l_linenumber, (l_linenumber = 3 OR l_orderkey % 7 <> 0) AND (l_linenumber % 2 = 0 OR l_quantity > 25) AS preserved FROM lineitem""",
    "plan_upsert": """
        WITH o AS (SELECT o_custkey AS dir, o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_custkey) AS least FROM orders),
        f AS (SELECT *, 'Tn' || k AS old, CASE WHEN k % 2 = 0 THEN 'tn' || least ELSE 'newn' || k END AS new, k % 3 = 0 AS updated FROM o),
        t AS (SELECT f.*, updated AND EXISTS (SELECT 1 FROM f g WHERE g.dir = f.dir AND g.k <> f.k
                AND lower(CASE WHEN g.updated AND g.k < f.k THEN g.new ELSE g.old END) = lower(f.new)) AS taken FROM f)
        SELECT dir, 'n' || k AS name, CASE WHEN updated THEN new ELSE old END AS target, NOT taken AS selected,
               CASE WHEN taken THEN 'NAME_COLLISION_RESOLVED' ELSE 'OK' END AS status, updated FROM t""",
    "plan_upsert_clash": """
        WITH o AS (SELECT o_custkey AS dir, o_orderkey AS k, o_orderkey % 2 = 0 AS updated, 'Tn' || o_orderkey AS old FROM orders),
        n AS (SELECT dir, k, lead(k) OVER (PARTITION BY dir ORDER BY k) AS nk FROM o WHERE updated),
        f AS (SELECT o.*, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'X.txt' ELSE 'x.TXT' END ELSE 'tN' || coalesce(nk, k) END AS new FROM o LEFT JOIN n USING (dir, k)),
        t AS (SELECT f.*, updated AND EXISTS (SELECT 1 FROM f g WHERE g.dir = f.dir AND g.k <> f.k
                AND lower(CASE WHEN g.updated AND g.k < f.k THEN g.new ELSE g.old END) = lower(f.new)) AS taken FROM f)
        SELECT dir, 'n' || k AS name, CASE WHEN updated THEN new ELSE old END AS target, NOT taken AS selected,
               CASE WHEN taken THEN 'NAME_COLLISION_RESOLVED' ELSE 'OK' END AS status, updated FROM t""",
    "history_merge": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "top_candidates": """
        SELECT doc_id, kind, value, position, confidence FROM (
          SELECT l_suppkey AS doc_id, l_returnflag AS kind, l_orderkey || '-' || l_linenumber AS value, l_orderkey * 10 + l_linenumber AS position, CAST(l_discount AS DOUBLE) AS confidence,
                 row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) AS t FROM lineitem) WHERE t <= 5""",
    "name_candidates": _R + """
        SELECT doc_id, 'date' AS kind, CAST(doc_date AS VARCHAR) AS value, 0.93::DOUBLE AS confidence FROM r UNION ALL SELECT doc_id, 'inn', tax_id, 0.97 FROM r
        UNION ALL SELECT doc_id, 'date', CAST(doc_date + 1 AS VARCHAR), 0.88 FROM r WHERE doc_id % 2 <> 0 UNION ALL SELECT doc_id, 'number', CAST(doc_id AS VARCHAR), 0.95 FROM r""",
    "distinct_in_order": """
        SELECT p_partkey, array_to_string(list_filter(w, lambda v, i: list_position(k, lower(v)) = i), '|') AS words
        FROM (SELECT *, list_transform(w, lambda v: lower(v)) AS k FROM (SELECT p_partkey, string_split(p_name || ' ' || upper(p_brand) || ' ' || upper(p_name) || ' ' || lower(p_brand), ' ') AS w FROM part))""",
    "size_labels": """
        WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 32.0 ** l_linenumber AS BIGINT) AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN n || ' Б' WHEN n < 1048576 THEN printf('%.0f КБ', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f МБ', n / 1048576.0)
               ELSE printf('%.1f ГБ', n / 1073741824.0) END AS label, printf('%.1f', least(1.0, greatest(0.0, l_linenumber / 5.0 - 0.07))) AS bucket FROM s""",
    "sheet_subjects": """
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN left(p_name, 60) ELSE left(p_brand, 60) END AS subject,
               CASE WHEN p_partkey % 2 = 0 AND length(split_part(p_name, ' ', 1)) >= 4 THEN split_part(p_name, ' ', 1) ELSE '' END AS type FROM part""",
    "opening_types": _R + """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Письмо' WHEN kind = 'Договор займа' THEN 'Договор займа' WHEN kind LIKE 'Акт%' THEN 'акт' ELSE '' END AS type,
               CASE WHEN doc_id % 3 = 0 THEN 0.8 WHEN kind = 'Договор займа' OR kind LIKE 'Акт%' THEN 0.7 ELSE 0 END::DOUBLE AS confidence FROM r""",
    "run_fact_sharing": _R + """
        , q AS (SELECT *, doc_id % 3 = 0 AS t, doc_id % 5 = 0 AS d, doc_id % 2 = 0 AS p FROM r),
        n AS (SELECT custkey, arg_min(doc_id, CASE WHEN t THEN 0 ELSE 4 END + CASE WHEN p THEN 0 ELSE 2 END + CASE WHEN d THEN 0 ELSE 1 END + doc_id / 1e12) AS donor FROM q WHERE t OR d GROUP BY custkey),
        j AS (SELECT q.*, donor, x.kind AS xk, x.doc_date AS xd, x.t AS xt, x.d AS xdate, x.p AS xp, x.person AS xperson, donor IS NULL OR donor = q.doc_id AS own
              FROM q LEFT JOIN n USING (custkey) LEFT JOIN q x ON x.doc_id = donor)
        SELECT doc_id, CASE WHEN own THEN CASE WHEN t THEN kind ELSE '' END WHEN xt THEN xk ELSE '' END AS type,
               CASE WHEN own THEN CASE WHEN d THEN CAST(doc_date AS VARCHAR) ELSE '' END WHEN xdate THEN CAST(xd AS VARCHAR) ELSE '' END AS date,
               CASE WHEN own THEN CASE WHEN d THEN 0.8 ELSE 0 END WHEN xdate THEN 0.76 ELSE 0 END::DOUBLE AS confidence,
               CASE WHEN own THEN CASE WHEN p THEN person ELSE '' END WHEN xp THEN xperson ELSE '' END AS people FROM j""",
    "finalize_text": """
        WITH c AS (SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '\\p{Cyrillic}')) AS cyr FROM documents)
        SELECT doc_id, length(text) AS n_chars, false AS truncated, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS empty, false AS mixed,
               CASE WHEN coalesce(latin, 0) + coalesce(cyr, 0) = 0 THEN '' WHEN cyr > 1.5 * latin THEN 'ru' WHEN latin > 1.5 * cyr THEN 'en' ELSE 'mixed' END AS hint FROM c""",
    "reader_registry": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'name: ' || p_name || chr(10) || 'brand: ' || p_brand WHEN 2 THEN p_name || chr(10) || p_brand ELSE '' END AS text,
               ['txt', 'json', 'xml', ''][p_partkey % 4 + 1] AS reader FROM part""",
}
