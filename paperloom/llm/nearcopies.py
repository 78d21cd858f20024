"""Near copies: texts whose sets of word shingles have a Jaccard similarity of `SIMILARITY` or more.

Candidates share one of their first items. With the items of every set in one order (by value, which for hashes is as good
as any), two sets that are similar enough share an item among the first n - ceil(`SIMILARITY` * n) + 1 of both, so no
link is left out. A few more are taken of each (`MORE` of n): a text of which more of these are its own than a copy may
lack has no copy, which rules out texts that share a passage only. Every link is then checked by the exact Jaccard
similarity of the shingle sets.

Pairs of a key are not all formed. What a text shares with no other candidate bounds its similarity to any of
them: with n shingles of which u are its own, a and b share min(n_a - u_a, n_b - u_b) at most and have u_a + u_b
apart. Texts that no bound admits are done. Of each key the text with the smallest own share is the head, and all
others that the bound admits are checked against it: one pair for a text and key. Only where a key then still holds
several components, their texts meet once more: across components, where the bound admits it with `own` now counting
the shingles that no other component has, and only on their rarest shingles, of which similar sets must share one.
All steps are exact; no group is cut.

Texts of equal wording are one node (by 64-bit hash). Defined results: null is an empty text; texts without words are
copies of each other; fewer words than a shingle are one shingle; repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined_to_keys, ship_by_value
from .simhash import HOT_ROWS, components, content_of, hashes_of, least_rows

SHINGLE = 5
SIMILARITY = 0.8
#: Part of a set's items that are keys besides those that similar sets must share one of.
MORE = 0.05
#: Pairs of one text that a task checks together.
PAIRS = 64

ship_by_value(__name__)


def shingles_of(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text."""
    return np.unique(hashes_of(text, shingle).astype(np.uint64))


def n_keys(n: int, similarity: float) -> int:
    """How many of the n items of a set are its keys."""
    return min(n, n - math.ceil(similarity * n - 1e-9) + 1 + math.floor(MORE * n))


def keys_of(items: np.ndarray, similarity: float) -> np.ndarray:
    """The first items of a set, of which any similar set has one among its own first; one key for all empty sets."""
    return (items[: n_keys(len(items), similarity)] if len(items) else np.zeros(1, np.uint64)).view(np.int64)


def _n_keys(n: Column, similarity: float) -> Column:
    return F.greatest(F.lit(1), F.least(n, n - F.ceil(similarity * n - 1e-9) + 1 + F.floor(MORE * n)))


def _signer(shingle: int, similarity: float):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py(), shingle) for t in batch.column(1)]
            keys = pa.array([keys_of(s, similarity) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, keys], names=["content", "n", "keys"])

    return sign


def _lister(shingle: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles_of(t.as_py(), shingle).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["content", "items"])

    return listed


def _close(least: Column, most: Column, similarity: float) -> Column:
    return least >= similarity * most - 1e-9


def _possible(n_a: Column, own_a: Column, n_b: Column, own_b: Column, similarity: float) -> Column:
    """Whether two sets with so many items of their own can be similar enough."""
    shared = F.least(n_a - own_a, n_b - own_b)
    either = F.greatest(n_a + own_b, n_b + own_a, shared + own_a + own_b)
    return _close(shared, either, similarity)


def _sets(rows: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(content, items) of the wanted contents, each from one row, found by id and content: copies do not meet."""
    named = classes.join(wanted, "content", "left_semi").select(F.col("content").alias("wanted"), "least_id")
    texts = rows.join(named, (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
    texts = texts.dropDuplicates(["content", "doc_id"])  # a content's least id is one; texts moved by these for the join
    return checkpointed(texts.select("content", "text").mapInArrow(_lister(shingle), "content bigint, items array<bigint>"))


def _checked(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The `pairs` (a, b) of contents that are similar enough."""
    # A text with many pairs is dealt out as often as they need.
    parts = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("parts")).where("parts > 1"))
    dealt = pairs.join(parts, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).drop("parts")
    heads = sets.select(F.col("content").alias("a"), F.col("items").alias("items_a")).join(parts, "a", "left")
    heads = heads.select("a", "items_a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = dealt.join(sets.select(F.col("content").alias("b"), F.col("items").alias("items_b")), "b").join(heads, ["a", "part"])
    met = met.withColumn("shared", F.size(F.array_intersect("items_a", "items_b")))
    alike = _close(F.col("shared"), F.size("items_a") + F.size("items_b") - F.col("shared"), similarity)
    return checkpointed(met.where(alike).select("a", "b"))


def _across(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of contents of different roots that may be similar enough. sets: (content, items, root).

    Items are ordered by the number of sets that have them, rarest first. The first item that two similar sets share
    stands so early in both that enough items are left to share (the prefix and positional filters of set joins), and
    it is an item that both roots have.
    """
    items = sets.select("content", "root", F.explode("items").alias("item"))
    stats = items.groupBy("item").agg(F.count(F.lit(1)).alias("held"), (F.min("root") == F.max("root")).alias("lone"))
    stats = checkpointed(stats.withColumn("spread", F.col("held")))
    each = joined_to_keys(items, stats, "item", "held", HOT_ROWS).groupBy("content", "root").agg(
        F.sort_array(F.collect_list(F.struct("spread", "item", "lone"))).alias("all"), F.count_if("lone").alias("own")
    )
    n = F.size("all").cast("long")
    each = each.withColumn("n", n).where(_close(n - F.col("own"), n, similarity))
    first = F.slice("all", 1, (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    rare = each.select("content", "root", "n", "own", F.posexplode(F.transform(first, lambda x: F.struct(x["item"], x["lone"]))).alias("at", "x"))
    rare = checkpointed(rare.where("NOT x.lone").select("content", "root", "n", "own", "at", "x.item"))
    left, right = (rare.select("item", *[F.col(c).alias(f"{c}_{x}") for c in ("content", "n", "root", "own", "at")]) for x in "ab")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("content_a") < F.col("content_b")))
    left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = _close(left_over, F.col("n_a") + F.col("n_b") - left_over, similarity)
    fits = _possible(F.col("n_a"), F.col("own_a"), F.col("n_b"), F.col("own_b"), similarity)
    met = left.join(right, (left["item"] == right["item"]) & (F.col("root_a") != F.col("root_b")) & smaller & enough & fits)
    return checkpointed(met.select(F.col("content_a").alias("a"), F.col("content_b").alias("b")).distinct())


def rooted(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(content, least_id, root) of each text: texts with the same root are joined by links of near copies."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), content_of(F.col(text)).alias("content"), F.col(text).cast("string").alias("text"))
    classes = checkpointed(rows.groupBy("content").agg(F.min("doc_id").alias("least_id")))

    # Texts that have too many of their keys alone are done; only of the others all items are made.
    signed = rows.select("content", "text").mapInArrow(_signer(shingle, similarity), "content bigint, n bigint, keys array<bigint>")
    each = signed.select("content", "n", F.explode("keys").alias("key")).groupBy("key").agg(F.min("content").alias("content"), F.max("content").alias("other"), F.min("n").alias("n"))
    alone = each.where("content = other").groupBy("content").agg(F.count(F.lit(1)).alias("own"), F.min("n").alias("n"))
    done = alone.where(~_close(F.col("n") - F.col("own"), F.col("n"), similarity))
    sets = _sets(rows, classes, checkpointed(classes.join(done, "content", "left_anti").select("content")), shingle)

    # Items that one candidate has alone, and the texts that they leave a partner.
    lone = sets.select("content", F.explode("items").alias("item")).groupBy("item").agg(F.min("content").alias("content"), F.max("content").alias("other"))
    lone = lone.where("content = other").groupBy("content").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("content", F.size("items").cast("long").alias("n")).join(lone, "content", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    sized = checkpointed(sized.where(_close(F.col("n") - F.col("own"), F.col("n"), similarity)))
    keys = F.when(F.size("items") > 0, F.slice("items", 1, _n_keys(F.size("items"), similarity).cast("int"))).otherwise(F.array(F.lit(0).cast("long")))
    keyed = sets.select("content", keys.alias("keys")).join(sized, "content").select("content", "n", "own", F.explode("keys").alias("key"))
    crowded = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    placed = checkpointed(joined_to_keys(keyed, crowded, "key", "held", HOT_ROWS).select("key", "content", "n", "own"))
    first = F.min(F.struct((F.col("own") / F.greatest("n", F.lit(1))).alias("share"), F.col("content").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a")))
    heads = placed.groupBy("key").agg(first.alias("head"), F.count(F.lit(1)).alias("held")).where("held > 1")
    heads = checkpointed(heads.select("key", "head.a", "head.n_a", "head.own_a", "held"))
    stars = joined_to_keys(placed, heads, "key", "held", HOT_ROWS).where(F.col("a") != F.col("content"))
    stars = stars.where(_possible(F.col("n_a"), F.col("own_a"), F.col("n"), F.col("own"), similarity))
    stars = checkpointed(stars.select("a", F.col("content").alias("b")).distinct())
    found = _checked(sets, stars, similarity)
    roots = components(found)

    # Keys that still hold several components: what is left of their texts meets on rare items.
    told = placed.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    split = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    met = told.join(split, "key", "left_semi").groupBy("content", "root", "n").agg(F.count(F.lit(1)).alias("met"))
    told = met.where(_close(F.col("n") - _n_keys(F.col("n"), similarity) + F.col("met"), F.col("n"), similarity)).select("content", "root")
    rest = _across(checkpointed(sets.join(told, "content")), similarity)
    more = _checked(sets, rest, similarity)
    if more.limit(1).count():
        roots = components(found.unionByName(more))
    named = classes.select("content", "least_id").join(roots, F.col("content") == F.col("node"), "left")
    return named.select("content", "least_id", F.coalesce("root", "content").alias("root"))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, with the columns of `docs`: the one with the least id (null last), then text."""
    return least_rows(docs, rooted(docs, ident, text, shingle, similarity), ident, text)
