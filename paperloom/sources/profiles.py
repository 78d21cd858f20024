"""Profiles of HTML, CSV, JSON, XML, tracks, tags and workbook cells, on columns that hold the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import let

#: The character references that are decoded natively, in order; the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for reference, char in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """What a page shows: no scripts, styles, head or comments."""
    visible = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|head)\b[^>]*>.*?</\1\s*>", " ")
    return _plain(F.regexp_replace(visible, r"(?s)<!--.*?-->", " "))


#: An attribute of a start tag: its name, and its value in quotes of either kind or bare.
ATTRIBUTE = r"""(?s)([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute(found: Column, name: str) -> Column:
    """The value of the first attribute of a name among the attributes of a tag; empty if it is not there."""
    named = F.filter(found, lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE, 1)) == name)
    value = F.regexp_extract(F.get(named, F.lit(0)), ATTRIBUTE, 2)
    return F.coalesce(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit(""))


def meta_pairs(html: Column, most: int = 50) -> Column:
    """map of the names (or properties, in lower case) of a page's first `most` meta elements to their contents; the last one of a name counts."""
    tags = F.slice(F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?:"[^"]*"|'[^']*'|[^>"'])*+>"""), F.lit(0)), 1, most)

    def pair(tag: Column) -> Column:
        found = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
        name = F.coalesce(F.nullif(_attribute(found, "name"), F.lit("")), _attribute(found, "property"))
        return F.struct(F.lower(name).alias("name"), decoded(_attribute(found, "content")).alias("content"))

    told = F.filter(F.transform(tags, pair), lambda p: (p["name"] != "") & (p["content"] != ""))
    last = let(told, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, most), lambda later: later["name"] == p["name"])))
    return F.map_from_entries(last)


def html_profile(df: DataFrame, html: str = "html", headings: int = 20) -> DataFrame:
    """Add title, headings (h1 to h3), visible text, charset and meta pairs. Scripts, styles and the head are not visible."""
    body = F.coalesce(F.col(html), F.lit(""))
    heads = F.regexp_extract_all(body, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"), F.lit(1))
    return df.withColumns(
        {
            "title": _plain(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)),
            "headings": F.slice(F.filter(F.transform(heads, _plain), lambda h: h != ""), 1, headings),
            "visible": visible_text(body),
            "charset": F.lower(F.regexp_extract(body, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)),
            "meta": meta_pairs(body),
        }
    )


def csv_profile(df: DataFrame, text: str, columns: int = 32, rows: int = 5000) -> DataFrame:
    """Add delimiter (most frequent in the first line, `;` before `,`, tab, `|` on ties), headers and n_rows."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda x: x != "")
    told = df.withColumn("_lines", lines).withColumn("_first", F.coalesce(F.get("_lines", F.lit(0)), F.lit("")))
    counts = [F.struct(F.regexp_count("_first", F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, p) in enumerate(((";", ";"), (",", ","), ("\t", "\t"), ("|", r"\|")))]
    told = told.withColumn("_best", F.array_max(F.array(*counts))).withColumn("delimiter", F.when(F.col("_best.n") > 0, F.col("_best.c")).otherwise(","))
    headers = F.slice(F.transform(F.split("_first", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))), F.trim), 1, columns)
    return told.withColumns({"headers": headers, "n_rows": F.least(F.lit(rows), F.greatest(F.size("_lines") - 1, F.lit(0)))}).drop("_lines", "_first", "_best")


def json_profile(df: DataFrame, json: str, keys: int = 50) -> DataFrame:
    """Add root (object, array, value or invalid), its sorted keys and n_items; parsed once as a variant."""
    parsed = F.try_parse_json(F.col(json))
    kind = F.schema_of_variant(parsed)
    root = F.when(parsed.isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("value")
    told = df.withColumn("root", root)
    names = F.when(F.col("root") == "object", F.array_sort(F.json_object_keys(F.col(json))))
    return told.withColumns({"keys": F.coalesce(F.slice(names, 1, keys), F.array().cast("array<string>")), "n_items": F.when(F.col("root") == "array", F.json_array_length(F.col(json))).when(F.col("root") == "object", F.size(names)).otherwise(0)})


def xml_texts(xml: Column) -> Column:
    """array<string>: the text nodes that are not blank, in order."""
    nodes = F.regexp_extract_all(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), F.lit(r">([^<]+)<"), F.lit(1))
    return F.filter(F.transform(nodes, lambda t: decoded(F.trim(t))), lambda t: t != "")


def xml_profile(df: DataFrame, xml: str, nodes: int = 4000) -> DataFrame:
    """Add root tag and texts: the first text nodes that are not blank."""
    return df.withColumns({"root": F.regexp_extract(xml, r"<([A-Za-z][\w:.-]*)", 1), "texts": F.slice(xml_texts(F.col(xml)), 1, nodes)})


#: A point of a track, route or way, with what is inside it.
POINT = r"(?is)<(?:\w+:)?(trkpt|wpt|rtept)(?:\s[^>]*?)?(?:/>|>(.*?)</(?:\w+:)?\1\s*>)"


def _inside(xml: Column, tags: str) -> Column:
    """array<string>: the texts that are not blank of the elements of these names, in order."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?i)<(?:\w+:)?(?:{tags})(?:\s[^>]*)?>([^<]*)<"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.trim(decoded(t))), lambda t: t != "")


def track_name(xml: Column) -> Column:
    """The first name in a GPX or KML text; empty if there is none."""
    return F.coalesce(F.get(_inside(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), "name"), F.lit(0)), F.lit(""))


def track_points(df: DataFrame, ident: str, xml: str) -> DataFrame:
    """(ident, seq, lat, lon, ts) of a GPX text's points in file order; points without two numbers are passed over.

    Read by patterns: a torn text gives the points before the tear and doesn't stop the job.
    """

    def point(element: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_extract(element, "^<[^>]*>", 0), F.lit(ATTRIBUTE), F.lit(0))
        place = {name: _attribute(found, name).try_cast("double") for name in ("lat", "lon")}
        return F.struct(*[value.alias(name) for name, value in place.items()], F.get(_inside(element, "time"), F.lit(0)).alias("ts"))

    elements = F.regexp_extract_all(F.regexp_replace(F.col(xml), r"(?s)<!--.*?-->", ""), F.lit(POINT), F.lit(0))
    kept = F.filter(F.transform(elements, point), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return df.select(ident, F.posexplode(kept).alias("seq", "p")).select(ident, "seq", "p.lat", "p.lon", "p.ts")


def track_summary(points: DataFrame, track: str) -> DataFrame:
    """Points, length in km (haversine), first and last time of each track."""
    along = Window.partitionBy(track).orderBy("seq")
    rad = lambda c: F.radians(c)
    told = points.withColumns({"_lat": F.lag("lat").over(along), "_lon": F.lag("lon").over(along)})
    half = F.pow(F.sin(rad(F.col("lat") - F.col("_lat")) / 2), 2) + F.cos(rad(F.col("_lat"))) * F.cos(rad(F.col("lat"))) * F.pow(F.sin(rad(F.col("lon") - F.col("_lon")) / 2), 2)
    step = F.when(F.col("_lat").isNull(), 0.0).otherwise(2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), half))))
    return told.withColumn("_step", step).groupBy(track).agg(F.count(F.lit(1)).alias("n_points"), F.sum("_step").alias("km"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def kml_summary(df: DataFrame, xml: str, times: int = 5) -> DataFrame:
    """Add kml_name (the first name), placemarks, first_coordinate and the first `times` timestamps of a KML text."""
    body = F.regexp_replace(F.coalesce(F.col(xml), F.lit("")), r"(?s)<!--.*?-->", "")
    first = lambda values: F.coalesce(F.get(values, F.lit(0)), F.lit(""))
    return df.withColumns(
        {
            "kml_name": track_name(body),
            "placemarks": F.regexp_count(body, F.lit(r"(?i)<(?:\w+:)?placemark(?=[\s/>])")),
            "first_coordinate": F.regexp_extract(first(_inside(body, "coordinates")), r"^\S+", 0),
            "timestamps": F.slice(_inside(body, "when|begin|end"), 1, times),
        }
    )


#: Tags of a wanted fact, the most trusted first.
TAG_ORDER = {"taken": ("DateTimeOriginal", "CreateDate", "MediaCreateDate"), "device": ("Model", "CameraModelName")}
PLACE = ("GPSLatitude", "GPSLongitude")


def tag_pivot(tags: DataFrame, ident: str) -> DataFrame:
    """taken, device and place of each file: the first non-empty value of the most trusted tag. tags: (ident, ord, tag, value).

    latitude and longitude are numbers, both or neither.
    """
    wanted = tags.where(F.col("tag").isin(*[t for ts in TAG_ORDER.values() for t in ts], *PLACE) & (F.trim("value") != ""))
    pick = lambda names: F.coalesce(*[F.min_by(F.when(F.col("tag") == n, F.col("value")), F.when(F.col("tag") == n, F.col("ord"))) for n in names])
    told = wanted.groupBy(ident).agg(*[pick(names).alias(fact) for fact, names in TAG_ORDER.items()], *[pick([tag]).try_cast("double").alias(f"_{tag}") for tag in PLACE])
    both = F.col(f"_{PLACE[0]}").isNotNull() & F.col(f"_{PLACE[1]}").isNotNull()
    place = {out: F.when(both, F.col(f"_{tag}")) for out, tag in zip(("latitude", "longitude"), PLACE)}
    return told.withColumns(place).drop(*[f"_{tag}" for tag in PLACE])


def cell_sample(cells: DataFrame, book: str, rows: int = 200, columns: int = 30, most: int = 1500) -> DataFrame:
    """Text lines of a workbook's sheets from the first rows, columns and non-empty cells. cells: (book, sheet, row, col, value)."""
    inside = cells.where((F.col("row") < rows) & (F.col("col") < columns) & (F.trim("value") != ""))
    turn = F.row_number().over(Window.partitionBy(book).orderBy("sheet", "row", "col"))
    kept = inside.withColumn("_turn", turn).where(F.col("_turn") <= most)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), " | ")
    return kept.groupBy(book, "sheet", "row").agg(line.alias("line"))


def first_json(text: Column) -> Column:
    """The part of a noisy text from its first brace to its last, if that parses; else null."""
    part = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(part).isNotNull(), part)


def display_name(address: Column) -> Column:
    """The person of a mail address: the name in front of it, otherwise its local part with spaces."""
    name = F.trim(F.regexp_replace(F.regexp_extract(address, r"^([^<]*)<", 1), "[\"']", ""))
    local = F.regexp_replace(F.substring_index(F.regexp_extract(address, r"([\w.+-]+@[\w.-]+)", 1), "@", 1), r"[._+-]+", " ")
    return F.when(name != "", name).otherwise(local)


def safe_metadata(values: Column) -> Column:
    """A map without its empty values, the others trimmed."""
    return F.map_filter(F.transform_values(values, lambda k, v: F.trim(v)), lambda k, v: v.isNotNull() & (v != ""))


def json_fragments(json: Column, most: int = 200, longest: int = 200) -> Column:
    """`key: value` of the short leaves of a JSON text, at any depth, in order."""
    leaf = r'"([^"\\]{1,80})"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false)'
    found = F.regexp_extract_all(json, F.lit(leaf), F.lit(0))
    told = F.transform(found, lambda m: F.concat_ws(": ", F.regexp_extract(m, leaf, 1), F.regexp_replace(F.regexp_extract(m, leaf, 2), '^"|"$', "")))
    return F.slice(F.filter(told, lambda t: F.length(t) <= longest), 1, most)
