"""Mix sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, the source's target over its size.
The prefix sum of those is taken over the source in a fixed order, one random offset of the source is
added, and a document is emitted once for each integer that its step crosses. The order is: buckets of
ids, then size, then id; sorting by size inside a bucket spreads long and short texts evenly, so the
words taken come near the target.

A source is never in one task: prefix sums are taken in each bucket and, over the buckets' counts,
between them. The number of buckets follows the number of rows, not the cluster, so reruns agree
wherever they run.

Defined results: null texts have size 0 and are sampled like others; a null source is a source, last
in order; a source without words has target 0 and nothing is taken; repeated rows are each sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, in_order, next_power_of_two, numbered_groups, words_of

#: The weights that sources take in turn.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Rows that a bucket of a source which held all rows would have, about.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 256


@dataclass(frozen=True)
class Mix:
    """The sources' totals and targets, and the cells (source, bucket) with their offsets."""

    sources: DataFrame
    cells: DataFrame
    buckets: int


def source_key(source: Column) -> Column:
    """Never null, and in the order of code points with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def bucket_of(key: Column, buckets: int) -> Column:
    """A bucket of an id, spread by a multiplication; null ids share one."""
    return F.coalesce(F.pmod(F.pmod(key, F.lit(65_537)) * 40_502 + F.pmod(key, F.lit(65_521)), F.lit(buckets)), F.lit(0)).cast("int")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _weights(sources: DataFrame) -> DataFrame:
    """Sources in order of their key take the weights in turn; ranks are counted in ranges of keys."""
    written, part = in_order(sources, [F.col("key").asc()])
    sizes = written.groupBy(part).agg(F.count(F.lit(1)).alias("held"))
    before = numbered_groups(sizes.withColumn("all", F.lit(0)), ["all"], [part], "held", "before")
    inside = Window.partitionBy(part).orderBy("key")
    ranked = written.join(F.broadcast(before.select(part, "before")), part)  # a row for each range
    place = F.col("before") + F.row_number().over(inside) - 1
    turn = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    return ranked.withColumn("weight", turn[(place % len(WEIGHTS)).cast("int")]).drop(part, "before")


def _targets(sources: DataFrame) -> DataFrame:
    """Share SHARE of all sizes by weight; what exceeds MOST times a source goes to the others by weight."""
    held = checkpointed(_weights(sources).withColumn("cap", MOST * F.col("source_size")))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        row = held.agg(
            F.sum(F.when(F.col("cap") < level * F.col("weight"), F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(F.col("cap") < level * F.col("weight"), 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(F.col("cap") < level * F.col("weight")).alias("n"),
        ).first()
        if not row["open"] or row["n"] == capped:
            break
        capped, level = row["n"], (SHARE * total - row["full"]) / row["open"]
    return held.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def offset_of(key: Column) -> Column:
    """One number in [0, 1) for a source, from a digest of the seed and its key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0


def plan(sized: DataFrame, key: str, size: str, ident: str) -> Mix:
    """Targets and offsets from one pass over (source key, size, id)."""
    counted = sized.select(key, size, ident)
    total = counted.count()
    buckets = max(LEAST_BUCKETS, next_power_of_two(-(-total // BUCKET_ROWS)))
    cells = checkpointed(
        counted.groupBy(F.col(key).alias("key"), bucket_of(F.col(ident), buckets).alias("bucket")).agg(
            F.count(F.lit(1)).alias("held"), F.sum(size).alias("cell_size")
        )
    )
    sources = cells.groupBy("key").agg(F.sum("cell_size").alias("source_size"))
    targets = _targets(sources)
    cells = numbered_groups(cells, ["key"], ["bucket"], "held", "before")
    cells = cells.join(targets, "key").select(
        "key", "bucket", "before", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"),
    )
    return Mix(targets, cells, buckets)


def with_copies(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id") -> DataFrame:
    """Add size, source_size, target and n_copies (0, 1 or 2) to each row; columns with these names are replaced."""
    names = fresh(docs, "mixed_text", "mixed_source", "mixed_ident")
    inner = docs.withColumns({names[0]: docs[text], names[1]: docs[source], names[2]: docs[ident]})
    told = _with_copies(inner.drop("size", "source_size", "target", "n_copies"), *names)
    return told.drop(*names)


def _with_copies(docs: DataFrame, text: str, source: str, ident: str) -> DataFrame:
    key, bucket, place, before, expected = fresh(docs, "mix_key", "mix_bucket", "mix_place", "mix_before", "mix_expected")
    sized = docs.withColumn("size", word_count(F.col(text))).withColumn(key, source_key(F.col(source)))
    mix = plan(sized.select(key, "size", F.col(ident)), key, "size", ident)
    cells = mix.cells.select(
        F.col("key").alias(key), F.col("bucket").alias(bucket), F.col("before").alias(before),
        "source_size", "target", F.col("copies").alias(expected),
    )
    # Cells and rows meet on the keys of the window, so each row is dealt out once for both.
    joined = sized.withColumn(bucket, bucket_of(F.col(ident), mix.buckets)).join(cells, [key, bucket])
    inside = Window.partitionBy(key, bucket).orderBy("size", F.col(ident))
    placed = joined.withColumn(place, F.col(before) + F.row_number().over(inside))
    start = offset_of(F.col(key))
    crossed = F.floor(F.col(place) * F.col(expected) + start) - F.floor((F.col(place) - 1) * F.col(expected) + start)
    return placed.withColumn("n_copies", crossed.cast("long")).drop(key, bucket, place, before, expected)


def mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id") -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of `docs`."""
    names = fresh(docs, "mix_text", "mix_source", "mix_ident")
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias(names[0]), docs[source].alias(names[1]), docs[ident].alias(names[2]))
    taken = _with_copies(inner, *names).where("n_copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("n_copies").cast("int"))).alias("row")).select("row.*")
