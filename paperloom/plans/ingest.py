"""Queries of the readers' work: types by bytes, and profiles of HTML, CSV, JSON, XML, tracks, tags and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files, profiles
from .tables import table

#: Leading bytes given to documents in turn, the extension they carry and the type that is right.
HEADS = (
    ("255044462D312E34", ".pdf", "pdf"), ("FFD8FFE0", ".png", "jpg"), ("504B0304776F72642F646F63756D656E742E786D6C", ".docx", "docx"),
    ("D0CF11E0A1B11AE1", ".xls", "xls"), ("52494646000000005741564520", ".wav", "wav"), ("0000001866747970686569630000", ".heic", "heic"),
    ("3C3F786D6C2076657273696F6E3D22312E30223F3E3C677078", ".gpx", "gpx"), ("", ".txt", "txt"), ("", ".csv", "csv"), ("00FF00", ".bin", "bin"),
)


def type_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pick = lambda i: F.element_at(F.array(*[F.lit(h[i]) for h in HEADS]), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    made = docs.select("doc_id", F.concat(F.unhex(pick(0)), F.encode(F.concat(F.lit("x"), F.regexp_replace("text", r"\P{Print}", "?")), "UTF-8")).alias("content"), pick(1).alias("ext"))
    told = made.withColumn("t", files.detect_type(F.col("content"), F.col("ext")))
    return told.select("doc_id", F.col("t.kind").alias("kind"), files.category(F.col("t.kind")).alias("category"), files.extension_mismatch(F.col("t.kind"), F.col("t.method"), F.col("ext")).alias("mismatch"))


def technical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    pick = F.element_at(F.array(*map(F.lit, ["Thumbs.db", "~$a.docx", ".hidden", "x.TMP", "a.pdf"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return parts.select("p_partkey", files.technical_reason(pick).alias("reason"))


def html_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = profiles.html_profile(table(spark, sf_dir, "pages").select("page_id", "html"))
    return told.select("page_id", "title", F.size("headings").cast("long").alias("n_headings"), F.get("headings", F.lit(0)).alias("first_heading"), F.length("visible").cast("long").alias("n_visible"), "charset")


def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a small CSV text, with commas or semicolons in turn."""
    orders = table(spark, sf_dir, "orders")
    sep = F.when(F.col("o_custkey") % 2 == 0, ",").otherwise(";")
    lines = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.concat_ws("|", F.lit("key")), sep, F.lit("date"), sep, F.lit("price\n"), F.repeat(F.concat(F.lit("1"), sep, F.lit("2"), sep, F.lit("3\n")), F.col("n").cast("int")))
    told = profiles.csv_profile(lines.select("o_custkey", text.alias("text")), "text")
    return told.select("o_custkey", "delimiter", F.array_join("headers", "/").alias("headers"), F.col("n_rows").cast("long").alias("n_rows"))


def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("["), "props", F.lit(", 2]"))).when(F.col("event_id") % 10 == 1, "{bad").otherwise(F.col("props")).alias("j"))
    told = profiles.json_profile(events, "j")
    return told.select("event_id", "root", F.array_join("keys", ",").alias("keys"), F.col("n_items").cast("long").alias("n_items"))


def xml_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    xml = F.concat(F.lit('<?xml version="1.0"?><part><name>'), "p_name", F.lit("</name><brand> "), "p_brand", F.lit(" &amp; co</brand><size>"), F.col("p_size").cast("string"), F.lit("</size></part>"))
    told = profiles.xml_profile(parts.select("p_partkey", xml.alias("x")), "x")
    return told.select("p_partkey", "root", F.array_join("texts", "/").alias("texts"))


def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as points of a track and way points in turn, every fourth without a time, written as GPX and read back."""
    events = table(spark, sf_dir, "events")
    k = F.col("event_id")
    kind = F.when(k % 2 == 0, "trkpt").otherwise("wpt")
    stamp = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("<time> "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</time>")))
    point = F.concat(F.lit("<"), kind, F.lit(' lat="'), F.round(F.col("value") / 10, 3).cast("string"), F.lit("\" lon='"), (k % 90).cast("string"), F.lit("'>"), stamp, F.lit("</"), kind, F.lit(">"))
    tracks = events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", point.alias("p")))), lambda s: s["p"]), "").alias("body"))
    gpx = tracks.select("user_id", F.concat(F.lit("<gpx><!-- <name>no</name> --><name>way of "), F.col("user_id").cast("string"), F.lit("</name><trkpt lat='x' lon='1'/>"), "body", F.lit("<trkpt lat=")).alias("x"))
    told = profiles.track_summary(profiles.track_points(gpx, "user_id", "x"), "user_id").withColumn("km", F.round("km", 3))
    return told.join(gpx.select("user_id", profiles.track_name(F.col("x")).alias("name")), "user_id")


def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with meta elements of their own id and address put in front; every fifth has a second description."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    k = F.col("page_id").cast("string")
    second = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<meta NAME=description content=later"), k, F.lit(">"))).otherwise("")
    made = F.concat(
        F.lit('<meta name="Description" content="of > '), k, F.lit(' name=x"/><META content=\'u&amp;'), k, F.lit("' property='og:url'><meta name=empty content=\"\">"), second, F.col("html")
    )
    told = profiles.html_profile(pages.select("page_id", made.alias("html")))
    return told.select("page_id", F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|").alias("meta"))


def kml_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as placemarks of a KML text."""
    events = table(spark, sf_dir, "events")
    k = F.col("event_id")
    mark = F.concat(
        F.lit("<Placemark id='p'><name>e"), k.cast("string"), F.lit("</name><TimeStamp><when>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("</when></TimeStamp><Point><coordinates> "), (k % 180).cast("string"), F.lit(","), (k % 90).cast("string"), F.lit(",0 1,1,0 </coordinates></Point></Placemark>"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", mark.alias("p")))), lambda s: s["p"]), "")
    made = events.groupBy("user_id").agg(body.alias("body"))
    kml = F.concat(F.lit("<kml xmlns='http://www.opengis.net/kml/2.2'><Document><!-- <name>no</name> --><name>user "), F.col("user_id").cast("string"), F.lit(" &amp; co</name>"), F.col("body"), F.lit("</Document></kml>"))
    told = profiles.kml_summary(made.select("user_id", kml.alias("x")), "x")
    return told.select("user_id", "kml_name", F.col("placemarks").cast("long").alias("placemarks"), "first_coordinate", F.array_join("timestamps", "|").alias("timestamps"))


def tag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"))
    tag = F.element_at(F.array(*map(F.lit, ["CreateDate", "Model", "DateTimeOriginal", "Artist", "GPSLatitude", "GPSLongitude"])), (F.col("l_linenumber") % 6 + 1).cast("int"))
    k = F.col("l_orderkey")
    degrees = F.when((k % 7 == 0) & (tag == "GPSLongitude"), "unknown").otherwise(F.concat((k % 90).cast("string"), F.lit(".5")))
    value = F.when(tag == "Model", F.concat(F.lit("cam"), F.col("l_linenumber").cast("string"))).when(tag.startswith("GPS"), degrees).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return profiles.tag_pivot(items.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ord"), tag.alias("tag"), value.alias("value")), "file_id")


def cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the cells of a workbook for each customer: a row for each order, two columns."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.lit("s").alias("sheet"), place.alias("row"), "o_orderpriority", "o_orderstatus")
    cells = orders.select("book", "sheet", "row", F.posexplode(F.array("o_orderpriority", F.when(F.col("row") % 2 == 0, F.col("o_orderstatus")).otherwise(" "))).alias("col", "value"))
    return profiles.cell_sample(cells, "book", most=6)


QUERIES = {
    f.__name__: f
    for f in (type_from_bytes, technical_files, html_profile, csv_profile, json_profile, xml_profile, track_length, tag_pivot, cell_sample, html_meta, kml_summary)
}
_CASE = " ".join(f"WHEN {i} THEN '{h[2]}'" for i, h in enumerate(HEADS))
ORACLE_SQL = {
    "type_from_bytes": f"""
        SELECT doc_id, CASE doc_id % 10 {_CASE} END AS kind,
            CASE doc_id % 10 WHEN 1 THEN 'image' WHEN 4 THEN 'audio' WHEN 5 THEN 'image' WHEN 6 THEN 'geodata' WHEN 8 THEN 'data' WHEN 9 THEN 'other' ELSE 'document' END AS category,
            doc_id % 10 = 1 AS mismatch FROM documents""",
    "technical_files": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'cache' WHEN 1 THEN 'lock' WHEN 2 THEN 'hidden' WHEN 3 THEN 'temporary' END AS reason FROM part",
    "html_profile": r"""
        WITH h AS (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t,
            regexp_extract_all(html, '(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>', 1) AS hs,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b[^>]*>.*?</head\s*>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
                '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS v FROM pages),
        c AS (SELECT page_id, html, hs, {0} AS title, {1} AS visible, {2} AS first_heading FROM h)
        SELECT page_id, title, len(hs) AS n_headings, first_heading, length(visible) AS n_visible, lower(regexp_extract(html, '(?i)<meta[^>]+charset=["'']?([\w-]+)', 1)) AS charset FROM c""".format(
        *[
            f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))"
            for c in ("t", "v", "hs[1]")
        ]
    ),
    "csv_profile": "SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN ',' ELSE ';' END AS delimiter, 'key/date/price' AS headers, count(*) AS n_rows FROM orders GROUP BY o_custkey",
    "json_profile": """
        SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'array' WHEN 1 THEN 'invalid' ELSE 'object' END AS root,
            CASE WHEN event_id % 10 < 2 THEN '' ELSE array_to_string(json_keys(props), ',') END AS keys,
            CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE len(json_keys(props)) END AS n_items FROM events""",
    "xml_profile": "SELECT p_partkey, 'part' AS root, p_name || '/' || p_brand || ' & co/' || p_size AS texts FROM part",
    "track_length": """
        WITH p AS (SELECT user_id, event_id, ts, round(value / 10, 3) AS lat, event_id % 90 AS lon, lag(round(value / 10, 3)) OVER w AS a, lag(event_id % 90) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, count(*) AS n_points, round(sum(CASE WHEN a IS NULL THEN 0 ELSE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2)))) END), 3) AS km,
               strftime(min(ts) FILTER (event_id % 4 <> 0), '%Y-%m-%dT%H:%M:%S') AS first_ts, strftime(max(ts) FILTER (event_id % 4 <> 0), '%Y-%m-%dT%H:%M:%S') AS last_ts,
               'way of ' || user_id AS name FROM p GROUP BY user_id""",
    "html_meta": """
        SELECT page_id, 'description=' || CASE WHEN page_id % 5 = 0 THEN 'later' || page_id ELSE 'of > ' || page_id || ' name=x' END || '|og:url=u&' || page_id AS meta FROM pages""",
    "kml_summary": """
        WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events)
        SELECT user_id, 'user ' || user_id || ' & co' AS kml_name, count(*) AS placemarks, (min(event_id) % 180) || ',' || (min(event_id) % 90) || ',0' AS first_coordinate,
               string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY event_id) FILTER (t <= 5) AS timestamps FROM e GROUP BY user_id""",
    "tag_pivot": """
        WITH i AS (SELECT l_orderkey, l_linenumber AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS d FROM lineitem GROUP BY ALL)
        SELECT l_orderkey AS file_id, coalesce(arg_min(d, n) FILTER (n % 6 = 2), arg_min(d, n) FILTER (n % 6 = 0)) AS taken, arg_min('cam' || n, n) FILTER (n % 6 = 1) AS device,
               CASE WHEN bool_or(n = 4) AND bool_or(n = 5) AND l_orderkey % 7 <> 0 THEN l_orderkey % 90 + 0.5::DOUBLE END AS latitude,
               CASE WHEN bool_or(n = 4) AND bool_or(n = 5) AND l_orderkey % 7 <> 0 THEN l_orderkey % 90 + 0.5::DOUBLE END AS longitude
        FROM i WHERE n % 6 <> 3 GROUP BY l_orderkey""",
    "cell_sample": """
        WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row FROM orders),
        c AS (SELECT o_custkey AS book, 's' AS sheet, row, 0 AS col, o_orderpriority AS value FROM o
            UNION ALL SELECT o_custkey, 's', row, 1, o_orderstatus FROM o WHERE row % 2 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY row, col) AS t FROM c WHERE row < 200)
        SELECT book, sheet, row, string_agg(value, ' | ' ORDER BY col) AS line FROM k WHERE t <= 6 GROUP BY book, sheet, row""",
}
