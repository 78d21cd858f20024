"""The manifest and the plan as tables: append-only journal lines, recovery of torn files, versioned plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "type string, session string, seq bigint, old_path string, new_path string, sha256 string, status string, completed boolean"


def journal_lines(records: DataFrame) -> DataFrame:
    """One JSON line for each record."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


#: What makes a record of a session one and the same.
RECORD_KEY = ("session", "type", "seq")


def append(records: DataFrame, folder: str) -> None:
    """Append records to the journal, a folder for each session; the journal only grows.

    Records that it has already (by RECORD_KEY) are not written again. Two writers at once, or a task that is run again
    by a torn append, may still leave copies; `journal` folds them on reading.
    """
    spark = records.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(_stored(records)).parquet(folder).select(*RECORD_KEY).distinct()
        same = [records[k].eqNullSafe(known[k]) for k in RECORD_KEY]
        records = records.join(known, same[0] & same[1] & same[2], "left_anti")
    records.withColumn("written", F.current_timestamp()).write.mode("append").partitionBy("session").parquet(folder)


def _stored(records: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in [*records.dtypes, ("written", "timestamp")])


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a journal, each once: the one that was written first."""
    rows = spark.read.parquet(folder)
    turn = Window.partitionBy(*RECORD_KEY).orderBy("written", *[c for c in rows.columns if c not in (*RECORD_KEY, "written")])
    return rows.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn", "written")


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Write a journal's records, each once, to another folder with few files a session."""
    once = journal(spark, folder).withColumn("written", F.current_timestamp())
    once.repartition("session").write.partitionBy("session").parquet(to)


def recovered(lines: DataFrame, value: str = "value", schema: str = RECORD) -> DataFrame:
    """Records of journal lines; a line that a crash tore is passed over, header and footer fold into the session.

    Each record has its session's `finished`: the last footer says it completed.
    """
    parsed = lines.select(F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"}).alias("r")).where("r.session IS NOT NULL AND r.type IS NOT NULL").select("r.*")
    state = parsed.groupBy("session").agg(F.coalesce(F.bool_or((F.col("type") == "footer") & F.col("completed")), F.lit(False)).alias("finished"))
    return parsed.where("type = 'record'").drop("type", "completed").join(state, "session")


def load(spark: SparkSession, folder: str) -> DataFrame:
    return recovered(spark.read.text(folder))


def save_plan(plan: DataFrame, folder: str, version: int) -> None:
    """A version of a plan with its rows; its counters are an aggregate of them (plan_counters) and not stored twice."""
    plan.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)


def forensic(plan: DataFrame, facts: DataFrame, folder: str) -> None:
    """A report without any change: the facts and the plan as tables side by side. A report written again replaces its own."""
    facts.write.mode("overwrite").parquet(f"{folder}/facts")
    plan.write.mode("overwrite").parquet(f"{folder}/plan")


def fingerprint(config: Column) -> Column:
    """Digest of a settings struct or map."""
    return F.sha2(F.to_json(config), 256)
