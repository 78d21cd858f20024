"""Reports over decisions: quality of proposals, merged reports, shapes of edits, archives, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decision_totals(log: DataFrame, by: list[str]) -> DataFrame:
    """Decisions, accepted, edited and rejected ones and the edited share, by the given columns."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event") == "accepted").alias("accepted"),
        F.count_if(F.col("event") == "edited").alias("edited"),
        F.count_if(F.col("event") == "rejected").alias("rejected"),
    ).withColumn("edited_share", F.round(F.col("edited") / F.col("n"), 4))


def top_by(counts: DataFrame, value: str, n: str, top: int) -> DataFrame:
    """The `top` values by count, then by value; a distributed top-k, no global window."""
    return counts.orderBy(F.col(n).desc(), F.col(value)).limit(top)


def low_confidence(log: DataFrame, extension: str, confidence: str, least: float = 0.6, top: int = 10) -> DataFrame:
    """The extensions with the most decisions below `least`; none counts as 0, and no extension as a dash."""
    weak = log.where(F.coalesce(confidence, F.lit(0.0)) < least)
    kind = F.coalesce(F.nullif(F.col(extension), F.lit("")), F.lit("—"))
    return top_by(weak.groupBy(kind.alias("extension")).agg(F.count(F.lit(1)).alias("n")), "extension", "n", top)


def review_codes(log: DataFrame, codes: str, top: int = 10) -> DataFrame:
    """The codes that names were held back for most often; a code counts each time that a decision lists it."""
    return top_by(log.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code", "n", top)


def merge_reports(reports: DataFrame, counts: str, edits: str, top: int = 15) -> DataFrame:
    """Sum many reports' maps key by key; the types with the most edits first.

    reports: a row for each report with maps of counts and of edits by type.
    """
    both = reports.select(F.explode(counts).alias("type", "n"), F.lit(0).cast("long").alias("edited")).unionByName(
        reports.select(F.explode(edits).alias("type", "edited"), F.lit(0).cast("long").alias("n"))
    )
    summed = both.groupBy("type").agg(F.sum("n").alias("n"), F.sum("edited").alias("edited"))
    shared = summed.withColumn("edit_share", F.round(F.col("edited") / F.greatest("n", F.lit(1)), 4))
    return shared.orderBy(F.col("edited").desc(), "type").limit(top)


def shape(name: Column) -> Column:
    """struct<length, words, has_date, has_digits, has_page> of a name."""
    return F.struct(
        F.length(name).alias("length"),
        F.size(F.filter(F.split(name, r"[\s_]+"), lambda w: w != "")).alias("words"),
        name.rlike(r"\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}").alias("has_date"),
        name.rlike(r"\d").alias("has_digits"),
        name.rlike("(?i)стр_?\\d|page_?\\d").alias("has_page"),
    )


def edit_shapes(edits: DataFrame, proposed: str, chosen: str) -> DataFrame:
    """Add kept_first_word, dropped_date and shorter: how a chosen name differs from the proposed one, without its content."""
    first = lambda c: F.lower(F.regexp_extract(c, r"^[\s_]*([^\s_.]+)", 1))
    return edits.withColumns(
        {
            "kept_first_word": first(F.col(proposed)) == first(F.col(chosen)),
            "dropped_date": shape(F.col(proposed))["has_date"] & ~shape(F.col(chosen))["has_date"],
            "shorter": F.length(chosen) < F.length(proposed),
        }
    )


def latest(log: DataFrame, stamp: str, ident: str, keep: int) -> DataFrame:
    """The newest `keep` records; a top-k on the sort columns alone, then a filter by its last row."""
    last = log.select(stamp, ident).orderBy(F.col(stamp).desc(), F.col(ident).desc()).limit(keep).agg(F.min(F.struct(stamp, ident)).alias("m"))
    return log.join(F.broadcast(last), F.struct(F.col(stamp), F.col(ident)) >= F.col("m")).drop("m")  # one row


def archive_theme(entries: DataFrame, archive: str, name: str) -> DataFrame:
    """The word of four letters or more that most names of an archive have, in a third of a half of them at least."""
    words = entries.select(archive, F.monotonically_increasing_id().alias("_row"), F.explode(F.array_distinct(F.split(F.lower(name), r"[\s_\-.]+"))).alias("word"))
    counts = words.where((F.length("word") >= 4) & ~F.col("word").rlike(r"^\d+$")).groupBy(archive, "word").agg(F.count(F.lit(1)).alias("hits"))
    sizes = entries.groupBy(archive).agg(F.count(F.lit(1)).alias("n_entries"))
    best = counts.groupBy(archive).agg(F.min(F.struct((-F.col("hits")).alias("n"), "word")).alias("b"))
    joined = best.join(sizes, archive).withColumn("hits", -F.col("b.n"))
    return joined.where(F.col("hits") >= F.greatest(F.lit(3), F.floor(F.col("n_entries") / 2))).select(archive, F.col("b.word").alias("theme"), "hits", "n_entries")


#: Extensions of scans.
SCANS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".pdf", ".bmp")


def archive_profile(entries: DataFrame, archive: str, ext: str, size: str, packed: str) -> DataFrame:
    """Per archive: entries, bytes, ratio and its flag over 200, and if four fifths are scans."""
    per = entries.groupBy(archive).agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(size).alias("n_bytes"), F.sum(packed).alias("_packed"), F.count_if(F.lower(ext).isin(*SCANS)).alias("_scans")
    )
    ratio = F.when(F.col("_packed") > 0, F.col("n_bytes") / F.col("_packed")).otherwise(F.lit(0.0))
    return per.withColumns({"ratio": F.round(ratio, 4), "suspicious": ratio > 200, "holds_scans": F.col("_scans") / F.col("n_entries") >= 0.8}).drop("_packed", "_scans")


def archive_contents(entries: DataFrame, archive: str, order: str, name: str, encrypted: str, most: int = 10, sample: int = 50) -> DataFrame:
    """Per archive: extensions, the `most` frequent as array<struct<ext, n>>, the first `sample` names and if an entry is encrypted.

    Counts meet before they move, and only the first names of each archive do.
    """
    last = F.regexp_extract(name, r"[^/\\]*$", 0)
    told = entries.withColumn("_ext", F.lower(F.regexp_extract(last, r"(?<!^)\.[^.]+$", 0)))
    counts = told.groupBy(archive, "_ext").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce(encrypted, F.lit(False))).alias("_locked"))
    turn = F.row_number().over(Window.partitionBy(archive).orderBy(F.col("_n").desc(), "_ext"))
    ranked = counts.withColumn("_turn", turn)
    listed = lambda turn, value, until: F.transform(F.array_sort(F.collect_list(F.when(F.col(turn) <= until, F.struct(F.col(turn).alias("t"), value.alias("v"))))), lambda x: x["v"])
    kinds = ranked.groupBy(archive).agg(listed("_turn", F.struct(F.col("_ext").alias("ext"), F.col("_n").alias("n")), most).alias("extensions"), F.bool_or("_locked").alias("encrypted"))
    first = entries.withColumn("_turn", F.row_number().over(Window.partitionBy(archive).orderBy(order, name))).where(F.col("_turn") <= sample)
    names = first.groupBy(F.col(archive).alias("_archive")).agg(listed("_turn", F.col(name), sample).alias("sample"))
    return kinds.join(names, F.col(archive).eqNullSafe(F.col("_archive"))).drop("_archive")


#: Weights of facts and factors of diagnostic states.
WEIGHTS = {"document_type": 3.0, "document_date": 3.0, "document_number": 2.0, "case_number": 2.0, "person": 1.0, "organization": 1.0, "subject": 1.0}
RELIABILITY = {"llm": 0.9, "filesystem": 0.5}
PENALTIES = {"ENCODING_UNCERTAIN": 0.8, "MOJIBAKE_SUSPECTED": 0.6, "PDF_TEXT_LAYER_LOW_QUALITY": 0.9, "DATE_SOURCE_FILESYSTEM": 0.85, "PARTIAL_SUPPORT_LEGACY_OFFICE": 0.9}


def accepted(value: Column, confidence: Column, source: Column, evidence: Column) -> Column:
    """A fact counts if it has a value and confidence, and evidence where a model gave it."""
    return value.isNotNull() & (value != "") & (confidence > 0) & ((source != "llm") | (F.coalesce(evidence, F.lit("")) != ""))


def weighted_confidence(facts: Column, statuses: Column) -> Column:
    """Weighted mean of the facts' confidences (map of kind to struct<confidence, source>), lowered by each status.

    A subject that the file's own metadata gives weighs 2.
    """
    parts = []
    for kind, weight in WEIGHTS.items():
        fact = F.try_element_at(facts, F.lit(kind))
        trust = F.lit(1.0)
        for source, factor in RELIABILITY.items():
            trust = F.when(fact["source"] == source, factor).otherwise(trust)
        w = F.when(fact["source"] == "metadata", 2.0).otherwise(weight) if kind == "subject" else F.lit(weight)
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fact["confidence"])) * trust
        parts.append((F.when(fact.isNotNull(), value * w).otherwise(0.0), F.when(fact.isNotNull(), w).otherwise(0.0)))
    total = sum((w for _, w in parts), F.lit(0.0))
    score = F.when(total > 0, sum((v for v, _ in parts), F.lit(0.0)) / total).otherwise(0.0)
    for status, factor in PENALTIES.items():
        score = score * F.when(F.array_contains(statuses, status), factor).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def media_confidence(date: Column, source: Column, device: Column, garbled: Column) -> Column:
    """Confidence of photos, video and audio: by the source of their time, a little more with a device."""
    base = F.when(date.isNull(), 0.4).when(source == "filesystem", 0.9).otherwise(0.97)
    more = F.when(date.isNotNull() & (F.coalesce(device, F.lit("")) != ""), F.least(F.lit(0.99), base + 0.02)).otherwise(base)
    return more * F.when(date.isNotNull() & garbled, 0.6).otherwise(1.0)
