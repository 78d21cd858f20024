"""Helpers that several operators share."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: a run of that white space, as a Java regular expression.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def ship_by_value(module: str) -> None:
    """Send the functions of `module` to executors in full, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`, which all executors share.

    Where it is unset, a session on one machine (tests, a shell) gets a folder of its own; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def joined_to_keys(many: DataFrame, one: DataFrame, key: str, held: str, hot: int, salts: int = 64) -> DataFrame:
    """`many` joined to `one`, which has one row for each key with `held`, the number of rows of `many` that have it.

    Keys with more than `hot` rows are dealt out over `salts` copies of their row, so that no task gets all rows of a
    key. There are at most rows / hot such keys; they are found in `many` by a join that broadcasts them if Spark's
    size check allows it.
    """
    large = one.where(F.col(held) > hot).select(key)
    if not large.limit(1).count():
        return many.join(one.drop(held), key)
    salt, flag = fresh(many.join(one.limit(0), key), "join_salt", "join_flag")
    dealt = many.join(large.withColumn(flag, F.lit(True)), key, "left")
    turn = F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.lit(salts))
    dealt = dealt.withColumn(salt, F.when(F.col(flag), turn).otherwise(F.lit(0).cast("long"))).drop(flag)
    copies = F.when(F.col(held) > hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(one.withColumn(salt, F.explode(copies)).drop(held), [key, salt]).drop(salt)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once for each row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space; none for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has (nor each other), starting with the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def next_power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def in_order(df: DataFrame, keys: list[Column], width: int | None = None) -> tuple[DataFrame, str]:
    """Rows dealt out by ranges of `keys` and written down, with the number of each row's range.

    A later window partitions by that number, so no task holds more than a range; what crosses
    ranges is one row a range. The write fixes the ranges: a rerun of a later stage sees the same.
    """
    (part,) = fresh(df, "range_no")
    width = width or shuffle_width(df.sparkSession)
    dealt = df.repartitionByRange(width, *keys).withColumn(part, F.spark_partition_id())
    return checkpointed(dealt), part


def numbered_groups(cells: DataFrame, group: list[str], order: list[str], count: str, out: str) -> DataFrame:
    """Running total of `count` before each cell of a group: an offset for the rows of the cell."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(out, F.coalesce(F.sum(count).over(window), F.lit(0)).cast("long"))
