"""Roll-ups of facts over folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIXED_LABEL = "Документы"
TYPE_SHARE = 0.6


def top_value(df: DataFrame, folder: str, value: str, order: str, out: str) -> DataFrame:
    """The most frequent non-null value of each folder with its count; the first seen on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(folder, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.max(F.struct(F.col("_n"), (-F.col("_first")).alias("_early"), F.col(value).alias("v")))
    return counts.groupBy(folder).agg(best.alias("_b")).select(folder, F.col("_b.v").alias(out), F.col("_b._n").alias(f"{out}_count"))


def period(first: Column, last: Column) -> Column:
    """One date, one year, or a range of years."""
    a, b = F.substring(first, 1, 4), F.substring(last, 1, 4)
    return F.when(first == last, first).when(a == b, a).otherwise(F.concat_ws("-", a, b))


def profile(files: DataFrame, folder: str, kind: str, person: str, case: str, date: str, order: str) -> DataFrame:
    """Per folder: dominant type (share of all files 0.6 or more), person, case number, period and confidence.

    Counts are added up before they are shuffled; no folder's files meet in one task.
    """
    base = files.groupBy(folder).agg(
        F.count(F.lit(1)).alias("files_inside"), F.min(date).alias("_from"), F.max(date).alias("_to")
    )
    for value, name in ((kind, "type"), (person, "person"), (case, "case")):
        base = base.join(top_value(files, folder, value, order, name), folder, "left")
    n = F.col("files_inside")
    share = F.col("type_count") / n
    needed = F.when(n <= 2, 1).otherwise(F.greatest(F.lit(2), F.floor(n / 3)))
    person_kept, case_kept = F.col("person_count") >= needed, F.col("case_count") >= 2
    told = base.withColumns(
        {
            "type_share": F.coalesce(share, F.lit(0.0)),
            "person": F.when(person_kept, F.col("person")),
            "person_confidence": F.when(person_kept, F.least(F.lit(0.95), 0.6 + F.col("person_count") / n * 0.35)),
            "case_number": F.when(case_kept, F.col("case")),
            "period": period(F.col("_from"), F.col("_to")),
        }
    )
    own = F.col("type_share") >= TYPE_SHARE
    shared = F.col("person").isNotNull() | F.col("case_number").isNotNull()
    told = told.withColumns({"label": F.when(own, F.col("type")).when(shared, MIXED_LABEL), "mixed": ~own & shared})
    score = (
        F.lit(0.35)
        + F.when(F.col("mixed"), 0.1).when(F.col("label").isNotNull(), 0.25 + 0.1 * F.round(F.col("type_share"), 3)).otherwise(0.0)
        + F.coalesce(0.3 * F.col("person_confidence"), F.lit(0.0))
        + F.when(F.col("case_number").isNotNull(), 0.2).otherwise(0.0)
        + F.when(F.col("period").isNotNull(), 0.05).otherwise(0.0)
        + F.when(n >= 3, 0.05).otherwise(0.0)
    )
    told = told.withColumn("confidence", F.when(F.col("label").isNotNull(), F.least(F.lit(0.97), score)))
    return told.select(folder, "files_inside", "label", "type_share", "person", "case_number", "period", "confidence")


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, from the top: a/b/c gives a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def files_of_folders(files: DataFrame, path: str) -> DataFrame:
    """(folder, path) of direct children, or of all descendants where a folder has no file of its own.

    An equi-join on exploded ancestors: depth times the rows, no pairs of folders and files.
    """
    placed = files.select(path, F.posexplode(F.reverse(ancestors(F.col(path)))).alias("above", "folder"))
    nearest = placed.groupBy("folder").agg(F.min("above").alias("nearest"))
    return placed.join(nearest, "folder").where((F.col("nearest") > 0) | (F.col("above") == 0)).select("folder", path)


def without_inner_copies(folders: DataFrame, path: str, name: str) -> DataFrame:
    """Proposed names of folders, dropped (null) where a folder further in has the same one."""
    inner = folders.where(F.col(name).isNotNull()).select(F.explode(ancestors(F.col(path))).alias(path), F.lower(name).alias("_fold")).distinct()
    hit = folders.withColumn("_fold", F.lower(name)).join(inner.withColumn("_hit", F.lit(True)), [path, "_fold"], "left")
    return hit.withColumn(name, F.when(F.col("_hit").isNull(), F.col(name))).drop("_hit", "_fold")
