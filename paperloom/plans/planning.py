"""Queries of folder roll-ups, the rename plan, its verification, history and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folders, planning
from ..sources import manifest
from .rendered import SQL, rendered
from .tables import table


def folder_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(spark, sf_dir).select(
        "custkey", "kind", "person", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("А40-"), F.col("custkey").cast("string"))).alias("case_number"),
        F.col("doc_date").cast("string").alias("doc_date"), "doc_id",
    )
    found = folders.profile(docs, "custkey", "kind", "person", "case_number", "doc_date", "doc_id")
    return found.withColumns({"type_share": F.round("type_share", 4), "confidence": F.round("confidence", 4)})


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a tree of brands and types; sizes below 3 lie one folder further in."""
    parts = table(spark, sf_dir, "part")
    deep = F.when(F.col("p_size") < 3, F.lit("/small")).otherwise("")
    return parts.select(F.concat(F.lit("root/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), deep, F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = folders.files_of_folders(_tree(spark, sf_dir), "path")
    return placed.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def folder_name_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders inside regions; some are named like their region, which then loses its name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    inner = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("/", F.lit("all"), "r_name", "n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, F.lower("r_name")).otherwise(F.col("n_name")).alias("name")
    )
    outer = region.select(F.concat_ws("/", F.lit("all"), "r_name").alias("path"), F.col("r_name").alias("name"))
    return folders.without_inner_copies(outer.unionByName(inner), "path", "name").select("path", "name")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that renames each part to its name and extension inside its brand."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dir"),
        F.concat(F.lit("scan"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("name"),
        F.concat(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(".pdf")).alias("proposed"),
        F.col("p_partkey").alias("ord"),
    )


def resolve_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    found = planning.resolve_collisions(plan, plan.select("dir", "name"))
    return found.select("dir", "name", "target", "collided")


def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    ext = F.element_at(F.array(*map(F.lit, [".jpg", ".mov", ".xmp", ".pdf"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    named = items.select((F.col("l_orderkey") % 50).alias("dir"), F.concat(F.lit("IMG_"), F.col("l_orderkey").cast("string")).alias("stem"), ext.alias("ext")).distinct()
    return planning.related(named)


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: their status decides what the plan says."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("o_orderkey").cast("string"))).alias("target"),
        F.when(F.col("o_orderkey") % 13 == 0, "SIDECAR_DETECTED").alias("related"),
        (F.col("o_orderstatus") == "P").alias("good_name"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0.5).otherwise(0.9).alias("confidence"),
        F.when(F.col("o_custkey") % 17 == 0, "2024-01-01").alias("renamed_on"),
    )
    return planning.plan_status(orders).select("ord", "status", "selected")


def plan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.counters(rename_plan(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as an inventory, and the same some time later: some gone, larger, touched or rewritten."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    before = orders.select(
        k.cast("string").alias("path"), (k * 3).alias("size"), F.col("o_orderdate").cast("timestamp").alias("mtime"), F.sha2(k.cast("string"), 256).alias("sha256")
    )
    later = F.when(k % 19 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 5 SECOND")).otherwise(F.col("o_orderdate").cast("timestamp"))
    after = orders.where(k % 23 != 0).select(
        k.cast("string").alias("path"), F.when(k % 29 == 0, k * 3 + 1).otherwise(k * 3).alias("size"), later.alias("mtime"),
        F.sha2(F.when(k % 31 == 0, F.lit("x")).otherwise(k.cast("string")), 256).alias("sha256"),
    )
    return before, after


def plan_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.verify(*_snapshots(spark, sf_dir)).select("path", "verified")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (x.select("path", "size", "sha256") for x in _snapshots(spark, sf_dir))
    return planning.snapshot_diff(before, after).select("path", "size", "side")


def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as renames by month; parts found by hash or by name get the newest stamp."""
    items = table(spark, sf_dir, "lineitem")
    records = items.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("session"), F.date_format("l_shipdate", "yyyy-MM").alias("stamp"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), F.concat(F.lit("Part"), F.col("l_partkey").cast("string")).alias("new_name"),
    )
    parts = table(spark, sf_dir, "part")
    now = parts.select(
        "p_partkey", F.concat(F.lit("PART"), F.col("p_partkey").cast("string")).alias("name"),
        F.sha2(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("new"), 256).alias("sha256"),
    )
    known = planning.history(records, "session", "stamp", keep=24)
    return planning.renamed_on(now, known).select("p_partkey", "renamed_on")


def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, after = _snapshots(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = F.concat(F.lit("d/"), F.when(k % 37 == 0, k).otherwise(k + 10_000_000).cast("string"), F.lit(".pdf"))
    records = orders.select(
        (k % 10).alias("session"), k.alias("seq"), F.concat(F.lit("d/"), k.cast("string"), F.when(k % 41 == 0, ".doc").otherwise(".pdf")).alias("new_path"),
        old.alias("old_path"), F.sha2(k.cast("string"), 256).alias("sha256"),
    )
    ext = F.when(F.col("path").cast("long") % 41 == 0, ".doc").otherwise(".pdf")
    now = after.select(F.concat(F.lit("d/"), F.col("path"), ext).alias("path"), "sha256")
    return planning.undo_plan(records, now).select("session", "seq", "undo", F.col("turn").cast("long").alias("turn"))


def incomplete_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event users as sessions: signups are headers, purchases footers, completed by their value, the rest records."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "header").when((F.col("event_type") == "purchase") & (F.col("value") > 45), "footer").otherwise("record")
    journal = events.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session"), kind.alias("type"), (F.col("value") > 50).alias("completed"))
    return planning.incomplete_sessions(journal)


def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir).withColumn("target", F.concat(F.lit("t"), F.col("ord").cast("string"), F.lit(".pdf")))
    wish = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("T"), (F.col("ord") + 1).cast("string"), F.lit(".pdf"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("own"), F.col("ord").cast("string"), F.lit(".PDF"))).otherwise("x.doc")
    chosen = plan.where("ord % 4 = 0").select("dir", "name", wish.alias("chosen"))
    return planning.override(plan, chosen).select(F.col("ord"), "target", "override")


def apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "folder").otherwise("file")
    path = F.concat_ws("/", F.lit("r"), F.repeat(F.lit("d/"), (F.col("p_size") % 3).cast("int")), F.lpad(F.col("p_partkey").cast("string"), F.lit(9), F.lit("0")))
    rows = parts.select((F.col("p_partkey") % 3).alias("session"), "p_partkey", "p_size", kind.alias("kind"), path.alias("path"))
    return planning.apply_order(rows, "session", "kind", "path").select("p_partkey", F.col("turn").cast("long").alias("turn"))


def merge_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as scans that are merged to one document."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    named = items.select("l_orderkey", "l_linenumber", F.concat(F.lit("doc"), F.col("l_orderkey").cast("string")).alias("base"), F.concat(F.lit("scan "), F.col("l_linenumber").cast("string"), F.lit("x")).alias("stem"), F.lit(".jpg").alias("ext"))
    return planning.merge_as_document(named, "l_orderkey", "base", "stem", "ext", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("page").cast("long").alias("page"), "target")


def manifest_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal lines, every seventh torn."""
    events = table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 45), "footer").otherwise("record")
    rows = events.select(kind.alias("type"), F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("completed"))
    lines = manifest.journal_lines(rows)
    torn = lines.withColumn("value", F.when(F.get_json_object("value", "$.seq").cast("long") % 7 == 0, F.left("value", F.lit(25))).otherwise(F.col("value")))
    return manifest.recovered(torn).select("session", "seq", "finished")


QUERIES = {
    f.__name__: f
    for f in (
        folder_profile, folder_files, folder_name_dedupe, resolve_collisions, related_files, rename_plan, plan_counters, plan_verify,
        snapshot_diff, history_lookup, undo_plan, incomplete_sessions, manual_overrides, apply_order,
        merge_numbering, manifest_recovery,
    )
}
_TOP = "SELECT custkey, arg_max({0}, (n * 1000000000 - f)) AS v, max(n) AS c FROM (SELECT custkey, {0}, count(*) AS n, min(doc_id) AS f FROM d WHERE {0} IS NOT NULL GROUP BY ALL) GROUP BY custkey"
_STATUS = """
    SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN 'NO_NAME_PROPOSED' WHEN o_orderkey % 7 = 0 THEN 'NAME_UNCHANGED'
        WHEN o_orderkey % 13 = 0 THEN 'SIDECAR_DETECTED' WHEN o_orderstatus = 'P' THEN 'GOOD_NAME_KEPT'
        WHEN o_orderpriority = '5-LOW' THEN 'SKIPPED_LOW_CONFIDENCE' WHEN o_custkey % 17 = 0 THEN 'ALREADY_RENAMED' ELSE 'OK' END AS status FROM orders"""
ORACLE_SQL = {
    "folder_profile": f"""
        WITH r AS ({SQL}), d AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'А40-' || custkey END AS case_number FROM r),
        b AS (SELECT custkey, count(*) AS n, CAST(min(doc_date) AS VARCHAR) AS a, CAST(max(doc_date) AS VARCHAR) AS z FROM d GROUP BY custkey),
        t AS ({_TOP.format("kind")}), p AS ({_TOP.format("person")}), c AS ({_TOP.format("case_number")}),
        j AS (SELECT b.*, t.v AS kind, t.c / n AS share, CASE WHEN p.c >= CASE WHEN n <= 2 THEN 1 ELSE greatest(2, n // 3) END THEN p.v END AS person,
                     CASE WHEN c.c >= 2 THEN c.v END AS case_number, p.c AS pc
              FROM b LEFT JOIN t USING (custkey) LEFT JOIN p USING (custkey) LEFT JOIN c USING (custkey)),
        l AS (SELECT *, CASE WHEN share >= 0.6 THEN kind WHEN person IS NOT NULL OR case_number IS NOT NULL THEN 'Документы' END AS label FROM j)
        SELECT custkey, n AS files_inside, label, round(share, 4) AS type_share, person, case_number,
               CASE WHEN a = z THEN a WHEN a[1:4] = z[1:4] THEN a[1:4] ELSE a[1:4] || '-' || z[1:4] END AS period,
               round(CASE WHEN label IS NOT NULL THEN least(0.97, 0.35 + CASE WHEN share >= 0.6 THEN 0.25 + 0.1 * round(share, 3) ELSE 0.1 END
                     + CASE WHEN person IS NOT NULL THEN 0.3 * least(0.95, 0.6 + pc / n * 0.35) ELSE 0 END
                     + CASE WHEN case_number IS NOT NULL THEN 0.2 ELSE 0 END + 0.05 + CASE WHEN n >= 3 THEN 0.05 ELSE 0 END) END, 4) AS confidence FROM l""",
    "folder_files": """
        WITH f AS (SELECT p_brand AS b, p_type AS t, p_size < 3 AS deep FROM part)
        SELECT 'root/' || b || '/' || t AS folder, CASE WHEN bool_and(deep) THEN count(*) ELSE count(*) FILTER (NOT deep) END AS n_files FROM f GROUP BY b, t
        UNION ALL SELECT 'root/' || b || '/' || t || '/small', count(*) FROM f WHERE deep GROUP BY b, t
        UNION ALL SELECT 'root/' || b, count(*) FROM f GROUP BY b UNION ALL SELECT 'root', count(*) FROM f""",
    "folder_name_dedupe": """
        SELECT 'all/' || r_name AS path, CASE WHEN NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 5 = 0) THEN r_name END AS name FROM region
        UNION ALL SELECT 'all/' || r_name || '/' || n_name, CASE WHEN n_nationkey % 5 = 0 THEN lower(r_name) ELSE n_name END FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "resolve_collisions": """
        WITH p AS (SELECT p_brand AS dir, 'scan' || p_partkey || '.pdf' AS name, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS stem,
                          row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part)
        SELECT dir, name, stem || CASE WHEN k > 1 THEN '_' || lpad(CAST(k AS VARCHAR), greatest(2, CAST(length(CAST(k AS VARCHAR)) AS INT)), '0') ELSE '' END || '.pdf' AS target, k > 1 AS collided FROM p""",
    "related_files": """
        WITH f AS (SELECT DISTINCT l_orderkey % 50 AS dir, 'IMG_' || l_orderkey AS stem, ['.jpg', '.mov', '.xmp', '.pdf'][l_linenumber % 4 + 1] AS ext FROM lineitem)
        SELECT dir, stem, ext, CASE WHEN bool_or(ext = '.xmp') OVER w THEN 'SIDECAR_DETECTED' WHEN bool_or(ext = '.jpg') OVER w AND bool_or(ext = '.mov') OVER w THEN 'LIVE_PHOTO_PAIR_DETECTED' END AS related
        FROM f WINDOW w AS (PARTITION BY dir, stem)""",
    "rename_plan": f"SELECT ord, status, status = 'OK' AS selected FROM ({_STATUS})",
    "plan_counters": f"SELECT status, count(*) AS n, count(*) FILTER (status = 'OK') AS n_selected FROM ({_STATUS}) GROUP BY status",
    "plan_verify": """
        SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 23 = 0 THEN 'missing' WHEN o_orderkey % 29 = 0 THEN 'size_changed'
            WHEN o_orderkey % 19 = 0 THEN 'time_changed' WHEN o_orderkey % 31 = 0 THEN 'content_changed' ELSE 'ok' END AS verified FROM orders""",
    "snapshot_diff": """
        WITH k AS (SELECT o_orderkey AS k FROM orders)
        SELECT CAST(k AS VARCHAR) AS path, k * 3 AS size, 'removed' AS side FROM k WHERE k % 23 = 0 OR k % 29 = 0 OR k % 31 = 0
        UNION ALL SELECT CAST(k AS VARCHAR), CASE WHEN k % 29 = 0 THEN k * 3 + 1 ELSE k * 3 END, 'added' FROM k WHERE k % 23 <> 0 AND (k % 29 = 0 OR k % 31 = 0)""",
    "history_lookup": """
        WITH s AS (SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS m FROM lineitem),
        n AS (SELECT DISTINCT m FROM s ORDER BY m DESC LIMIT 24), k AS (SELECT l_partkey, max(m) AS m FROM s SEMI JOIN n USING (m) GROUP BY l_partkey)
        SELECT p_partkey, m AS renamed_on FROM part LEFT JOIN k ON l_partkey = p_partkey""",
    "undo_plan": """
        SELECT o_orderkey % 10 AS session, o_orderkey AS seq,
            CASE WHEN o_orderkey % 23 = 0 THEN 'missing' WHEN o_orderkey % 31 = 0 THEN 'changed'
                 WHEN o_orderkey % 41 = 0 THEN 'other_extension' ELSE 'ok' END AS undo,
            row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey DESC) AS turn FROM orders""",
    "incomplete_sessions": """
        WITH j AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session, CASE WHEN event_type = 'signup' THEN 'header' WHEN event_type = 'purchase' AND value > 45 THEN 'footer' ELSE 'record' END AS type, value > 50 AS done FROM events)
        SELECT session, count(*) FILTER (type = 'record') AS n_records FROM j GROUP BY session
        HAVING count(*) FILTER (type = 'record') >= 1 AND NOT coalesce(bool_or(type = 'footer' AND done), false)""",
    "manual_overrides": """
        WITH p AS (SELECT p_brand AS dir, p_partkey AS ord FROM part), x AS (SELECT *, ord % 4 = 0 AS wish FROM p)
        SELECT ord, CASE WHEN wish AND ord % 3 = 1 THEN 'own' || ord || '.PDF' WHEN wish AND ord % 3 = 0 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.dir = x.dir AND q.ord = x.ord + 1)
                    THEN 'T' || (ord + 1) || '.pdf' ELSE 't' || ord || '.pdf' END AS target,
               CASE WHEN NOT wish THEN 'unchanged' WHEN ord % 3 = 2 THEN 'extension' WHEN ord % 3 = 0 AND EXISTS (SELECT 1 FROM p q WHERE q.dir = x.dir AND q.ord = x.ord + 1) THEN 'taken' ELSE 'manual' END AS override
        FROM x""",
    "apply_order": """
        WITH p AS (SELECT p_partkey, p_partkey % 3 AS session, p_partkey % 4 = 0 AS folder, p_size % 3 AS deep,
            'r/' || repeat('d/', p_size % 3) || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path FROM part)
        SELECT p_partkey, row_number() OVER (PARTITION BY session ORDER BY folder, CASE WHEN folder THEN -deep ELSE 0 END, encode(path)) AS turn FROM p""",
    "merge_numbering": """
        WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
        k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS page, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i)
        SELECT l_orderkey, l_linenumber, page, 'doc' || l_orderkey || '_стр_' || lpad(CAST(page AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INT), '0') || '.jpg' AS target FROM k""",
    "manifest_recovery": """
        WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, event_type = 'purchase' AND value > 45 AS footer, value > 50 AS done FROM events WHERE event_id % 7 <> 0),
        s AS (SELECT session, coalesce(bool_or(footer AND done), false) AS finished FROM e GROUP BY session)
        SELECT session, seq, finished FROM e JOIN s USING (session) WHERE NOT footer""",
}
