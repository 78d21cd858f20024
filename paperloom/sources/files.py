"""The file inventory: scan, ignore list, period, extensions, technical files, type by leading bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, with_content: bool = False, changed_after: str | None = None) -> DataFrame:
    """files(path, dir, name, stem, ext, size, mtime[, content]) of a folder and all below it.

    Without content Spark lists files and reads none of them; `changed_after` is applied while listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if changed_after:
        reader = reader.option("modifiedAfter", changed_after)
    found = reader.load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    told = found.select(
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        name.alias("name"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)).alias("ext"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        *(["content"] if with_content else []),
    )
    return told


def not_ignored(df: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Rows whose name matches none of the exact or glob patterns, ignoring case; one compiled alternation."""
    one = lambda p: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.lower())
    return df.where(~F.lower(name).rlike("^(?:" + "|".join(map(one, patterns)) + ")$")) if patterns else df


def changed_within(df: DataFrame, mtime: str, days: int, now: str) -> DataFrame:
    """Rows changed in the last `days` before `now`; 0 keeps all, an unknown time is kept. A plain comparison, so it reaches the scan."""
    if days <= 0:
        return df
    kind = dict(df.dtypes)[mtime]
    oldest = F.lit(now).cast(kind) - F.expr(f"INTERVAL '{days}' DAY")
    return df.where(F.col(mtime).isNull() | (F.col(mtime) >= oldest))


def exact_copies(df: DataFrame, digest: str, ident: str) -> DataFrame:
    """Add original_id (the least id of the content), n_copies and is_copy; rows without a digest are copies of each other."""
    first = df.groupBy(F.col(digest).alias("_digest")).agg(F.min(ident).alias("original_id"), F.count(F.lit(1)).alias("n_copies"))
    joined = df.join(first, F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest")
    return joined.withColumn("is_copy", F.col(ident) != F.col("original_id"))


def extension_summary(df: DataFrame, ext: str, top: int = 6) -> DataFrame:
    """Files by extension: the `top` most frequent, ties by name, and one row `...` for the rest."""
    counts = df.groupBy(ext).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.orderBy(F.col("n").desc(), ext).limit(top).withColumn("_top", F.lit(True)).select(F.col(ext), "_top")
    named = counts.join(F.broadcast(largest), ext, "left").withColumn(ext, F.when(F.col("_top"), F.col(ext)).otherwise("..."))
    return named.groupBy(ext).agg(F.sum("n").alias("n_files"))


def listing(df: DataFrame, folder: str, name: str, ident: str, top: int) -> DataFrame:
    """The first `top` entries of each folder, ignoring case, with the number of hidden ones."""
    order = Window.partitionBy(folder).orderBy(F.lower(name), ident)
    counts = df.groupBy(folder).agg(F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - top).alias("hidden"))
    shown = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return shown.join(counts, folder).select(folder, ident, name, "place", "hidden")


#: Names, endings and reasons of technical files.
TECHNICAL_NAMES = {"thumbs.db": "cache", "desktop.ini": "system", ".ds_store": "system"}
TECHNICAL_EXTENSIONS = {".tmp": "temporary", ".bak": "backup", ".lnk": "shortcut", ".part": "download", ".crdownload": "download", ".dll": "program", ".exe": "program", ".sys": "system"}


def technical_reason(name: Column) -> Column:
    """Why a file is technical, or null: a known name, a lock file, a leading dot, a known ending."""
    low = F.lower(name)
    out = F.when(low.isin(*TECHNICAL_NAMES), F.create_map(*[F.lit(x) for kv in TECHNICAL_NAMES.items() for x in kv])[low])
    out = out.when(low.startswith("~$"), "lock").when(low.startswith("."), "hidden")
    for ext, reason in TECHNICAL_EXTENSIONS.items():
        out = out.when(low.endswith(ext), reason)
    return out


#: Leading bytes in hexadecimal, at an offset, and the type they mean. Order matters.
SIGNATURES = (
    (0, "255044462D", "pdf"), (0, "D0CF11E0A1B11AE1", "ole2"), (0, "7B5C727466", "rtf"), (0, "FFD8FF", "jpg"),
    (0, "89504E470D0A1A0A", "png"), (0, "474946383761", "gif"), (0, "474946383961", "gif"), (0, "424D", "bmp"),
    (0, "49492A00", "tiff"), (0, "4D4D002A", "tiff"), (8, "57454250", "webp"), (8, "57415645", "wav"), (8, "41564920", "avi"),
    (0, "4F676753", "ogg"), (0, "664C6143", "flac"), (0, "494433", "mp3"), (0, "377ABCAF271C", "7z"),
    (0, "526172211A0700", "rar"), (0, "526172211A070100", "rar"), (0, "1F8B", "gz"), (257, "7573746172", "tar"),
    (0, "2321414D52", "amr"), (8, "41494646", "aiff"), (8, "41494643", "aiff"), (0, "3026B2758E66CF11", "wma"),
)
RIFF, FORM = {"webp", "wav", "avi"}, {"aiff"}
#: What a ZIP holds, by an entry's name.
ZIP_ENTRIES = (("xl/vbaProject.bin", "xlsm"), ("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("mimetypeapplication/epub", "epub"), (".kml", "kmz"), ("mimetype", "odf"))
#: Brands of ISO media, by their beginning.
BRANDS = (("heic", "heic"), ("heix", "heic"), ("hevc", "heic"), ("mif1", "heic"), ("msf1", "heic"), ("heim", "heic"), ("avif", "avif"), ("avis", "avif"), ("qt", "mov"), ("crx", "raw"), ("m4a", "m4a"))
#: Types by category.
CATEGORIES = {
    "document": "pdf docx xlsx xlsm pptx doc xls ppt rtf txt md log html",
    "data": "csv xml json",
    "image": "jpg png gif bmp tiff webp heic avif dng raw",
    "video": "mp4 mov avi mkv webm mts",
    "audio": "mp3 m4a wav flac ogg wma aiff amr",
    "email": "eml msg",
    "archive": "zip 7z rar tar gz",
    "geodata": "gpx kml kmz",
}
#: Extensions that fit a type, where they are not just its name.
ALIASES = {
    "jpg": ".jpg .jpeg .jpe", "tiff": ".tif .tiff", "heic": ".heic .heif .hif", "mp4": ".mp4 .m4v .3gp .3g2", "mov": ".mov .qt",
    "mkv": ".mkv .mka", "m4a": ".m4a .m4b .aac", "html": ".html .htm .xhtml", "txt": ".txt .log .md .ini .cfg .srt .sub",
    "xml": ".xml .kml .gpx .rss .svg .xsd .xsl", "zip": ".zip .kmz .epub .odt .ods .odp .jar .apk", "gpx": ".gpx .xml",
    "kml": ".kml .xml", "kmz": ".kmz .zip", "gz": ".gz .tgz", "dng": ".dng .tif .tiff", "ogg": ".ogg .oga .opus .ogv",
    "doc": ".doc .dot", "xls": ".xls .xlt", "ppt": ".ppt .pps .pot", "docx": ".docx .docm .dotx", "xlsx": ".xlsx .xlsm .xltx",
    "pptx": ".pptx .pptm .potx .ppsx", "raw": ".cr2 .cr3 .nef .arw .raf .orf .rw2 .pef",
}


def _is_text(head: Column) -> Column:
    """No zero byte and less than 2% control bytes in the first 4,096."""
    codes = F.hex(F.substring(head, 1, 4096))
    pairs = F.regexp_extract_all(codes, F.lit("(..)"), F.lit(1))
    control = F.size(F.filter(pairs, lambda b: ((b < "09") | (b > "0D")) & (b < "20")))
    return ~F.array_contains(pairs, "00") & (control < 0.02 * F.size(pairs)) & (F.size(pairs) > 0)


def detect_type(content: Column, ext: Column) -> Column:
    """struct<kind, method>: by signature, then as text, then by extension. All on the binary column, no codec."""
    at = lambda offset, length: F.hex(F.substring(content, offset + 1, length))
    brand = F.lower(F.trim(F.decode(F.substring(content, 9, 4), "US-ASCII")))
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    start = F.ltrim(head)
    within = lambda text: F.contains(F.decode(content, "ISO-8859-1"), F.lit(text))

    zipped = F.lit("zip")
    for entry, kind in reversed(ZIP_ENTRIES):
        zipped = F.when(within(entry), kind).otherwise(zipped)
    kind = F.when(at(0, 4).isin("504B0304", "504B0506"), zipped)
    for offset, code, name in SIGNATURES:
        test = at(offset, len(code) // 2) == code
        if name in RIFF:
            test = test & (at(0, 4) == "52494646")
        if name in FORM:
            test = test & (at(0, 4) == "464F524D")
        kind = kind.when(test, name)
    kind = kind.when(at(0, 4) == "1A45DFA3", F.when(F.contains(F.left(head, F.lit(64)), F.lit("webm")), "webm").otherwise("mkv"))
    media = F.lit("mp4")
    for begin, name in reversed(BRANDS):
        media = F.when(brand.startswith(begin), name).otherwise(media)
    kind = kind.when(at(4, 4) == "66747970", media)
    xml = F.when(F.contains(head, F.lit("<gpx")), "gpx").when(F.contains(head, F.lit("<kml")), "kml").otherwise("xml")
    kind = kind.when(start.startswith("<?xml"), xml).when(start.startswith("<!doctype html") | start.startswith("<html"), "html")
    kind = kind.when(start.rlike("^(return-path|received|message-id|from):"), "eml")
    low = F.lower(ext)
    legacy = F.when((kind == "ole2") & low.isin(".doc", ".xls", ".ppt", ".msg"), F.substring(low, 2, 10)).otherwise(kind)
    as_text = F.when(low.isin(".txt", ".md", ".csv", ".log", ".json", ".html", ".xml"), F.substring(low, 2, 10)).otherwise("txt")
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.struct(F.lit("").alias("kind"), F.lit("empty").alias("method")))
        .when(legacy.isNotNull(), F.struct(legacy.alias("kind"), F.lit("signature").alias("method")))
        .when(_is_text(content), F.struct(as_text.alias("kind"), F.lit("text").alias("method")))
        .otherwise(F.struct(F.substring(low, 2, 10).alias("kind"), F.lit("extension").alias("method")))
    )


def category(kind: Column) -> Column:
    out = F.lit("other")
    for name, kinds in CATEGORIES.items():
        out = F.when(kind.isin(*kinds.split()), name).otherwise(out)
    return out


def extension_mismatch(kind: Column, method: Column, ext: Column) -> Column:
    """True where the content's type, if it is known by more than the extension, has other extensions."""
    fits = ext == F.concat(F.lit("."), kind)
    for name, exts in ALIASES.items():
        fits = F.when(kind == name, F.lower(ext).isin(*exts.split())).otherwise(fits)
    return method.isin("signature", "text") & (kind != "") & (ext != "") & ~fits
