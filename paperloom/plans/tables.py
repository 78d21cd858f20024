from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows that one task makes texts of and reads them.
TEXTS = 25_000


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """Deal out a table that is read in far fewer parts than there are cores (one small file); any other stays as it is.

    Only such small inputs are shuffled here: a table of a size that matters has more parts than a cluster has cores.
    That is so unless a row is much more work than its bytes tell: `most` is the number of rows that a part may hold then.
    """
    parts, needed = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    if most:
        needed = max(needed, -(-df.count() // most))
    return df.repartition(needed) if 2 * parts <= needed else df


def table(spark: SparkSession, sf_dir: str, name: str, most: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), most)
