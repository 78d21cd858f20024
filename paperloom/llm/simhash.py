"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints link if they differ in `RADIUS` (2) bits at most. Cut into `BLOCKS` pieces, two such
fingerprints agree on all but two pieces, so every choice of `BLOCKS - 2` pieces is a join key; pairs
that share a key are then verified. Copies are folded into one row per fingerprint first, so a group
of equal texts never meets itself.

A key that more than `HOT_KEY` fingerprints share is not joined: each of those fingerprints instead
goes to itself and to its 64 neighbours at one bit. Two fingerprints at distance 1 or 2 have a common
neighbour (or are each other's), and all that meet at one point are within 2 bits of each other, so the
point's members link to its least member. That is exact, and a point has 65 members at most.

Components come from alternating large-star and small-star steps (Kiveris et al., 2014) over those
links; links and labels stay distributed, and every step is checkpointed.

Defined results: null is an empty text; texts without words have fingerprint 0 and link like others;
fewer words than a shingle are one shingle; repeated rows are copies; a null doc_id is larger than
any other, so it is a component's id only if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, joined_to_keys, ship_by_value

SHINGLE = 3
HASH_SEED = 42
RADIUS = 2
BLOCKS = 5
HOT_KEY = 64
#: Rows of one fingerprint from which on they are dealt out in joins.
HOT_ROWS = 1 << 18

ship_by_value(__name__)


def hashes_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a text, in order, big-endian."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    take = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], HASH_SEED) for a, b in zip(starts.tolist(), ends[take - 1 :].tolist())], dtype=">u8"
    )


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    hashes = hashes_of(text, shingle)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint_of(t.as_py()) for t in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as bigint) for each row."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fingerprint bigint")


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks - radius pieces of 64 bits, as signed numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(pieces, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(values: DataFrame, blocks: int = BLOCKS, hot: int = HOT_KEY) -> DataFrame:
    """(a, b) with a < b such that all fingerprints within RADIUS bits are connected, each link true.

    values: distinct `fingerprint`s.
    """
    masks = _masks(blocks, RADIUS)
    keyed = values.select(
        "fingerprint",
        F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"),
    )
    sizes = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = checkpointed(sizes)
    cool = keyed.join(sizes.where(F.col("n") <= hot), ["block", "key"]).select("block", "key", "fingerprint")
    met = cool.groupBy("block", "key").agg(F.sort_array(F.collect_list("fingerprint")).alias("all"))  # hot at most
    near = lambda a: lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)
    pairs = met.select(F.explode("all").alias("a"), "all")
    pairs = pairs.select("a", F.explode(F.filter("all", near(F.col("a")))).alias("b"))

    warm = keyed.join(sizes.where(F.col("n") > hot), ["block", "key"], "left_semi").select("fingerprint").distinct()
    flips = [F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))]
    points = warm.select("fingerprint", F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(x) for x in flips])).alias("point"))
    stars = points.groupBy("point").agg(F.sort_array(F.collect_list("fingerprint")).alias("all"))  # 65 at most
    stars = stars.where(F.size("all") > 1).select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    return pairs.unionByName(stars).distinct()


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, least): of each node the least among itself and its neighbours in `edges` (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of each connected component; nodes without edges are left out."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = checkpointed(large.where("u > v").distinct())
        least = _least_neighbour(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = small.unionByName(least.select("u", F.col("least").alias("v")))
        now = checkpointed(small.where("u > v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) for each row.

    Rows go back to their fingerprint's component with fingerprints of more than `hot` rows dealt out.
    """
    marked = checkpointed(fingerprints(docs, ident, text))
    classes = checkpointed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("held")))
    roots = components(links(classes.select("fingerprint")))
    rooted = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", "held", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = checkpointed(joined_to_keys(rooted, ids, "root", "members", hot).select("fingerprint", "component_id", "held"))
    return joined_to_keys(marked, named, "fingerprint", "held", hot).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of `docs`: the one with the least id (null last), then text."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), content_of(F.col(text)).alias("content"), F.col(text).cast("string").alias("text"))
    marked = rows.mapInArrow(_contents, "doc_id bigint, content bigint, fingerprint bigint")
    named = checkpointed(marked.groupBy("content", "fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(named.select("fingerprint").distinct()))
    rooted = named.join(roots, F.col("fingerprint") == F.col("node"), "left")
    return least_rows(docs, rooted.select("content", "least_id", F.coalesce("root", "fingerprint").alias("root")), ident, text)


def content_of(text: Column) -> Column:
    """A 64-bit hash that stands for a text; copies have the same."""
    return F.xxhash64(text.cast("string"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint_of(t.as_py()) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "content", "fingerprint"])


def least_rows(docs: DataFrame, rooted: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each root with the least id (null last), then the least text; rows that repeat it leave one.

    rooted: (content, least_id, root) of each content, where least_id is the least id of its rows. Rows are
    dealt by id and content, so copies do not meet; only rows that share an id are compared by text.
    """
    key, body, content, rank, place = fresh(docs, "dedup_id", "dedup_text", "dedup_content", "dedup_rank", "dedup_root")
    rooted = checkpointed(rooted)
    best = rooted.groupBy("root").agg(F.min("least_id").alias("best"))
    heads = rooted.join(best, "root").where(F.col("least_id").eqNullSafe(F.col("best")))
    heads = heads.select(F.col("content").alias("head"), "least_id", F.col("root").alias(place))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[ident].cast("long").alias(key), docs[text].alias(body), content_of(docs[text]).alias(content)
    )
    kept = rows.join(heads, (rows[content] == heads["head"]) & rows[key].eqNullSafe(heads["least_id"]))
    if docs.groupBy(ident).count().where("count > 1").limit(1).count():
        turn = Window.partitionBy(place).orderBy(F.col(body).asc_nulls_first())
        kept = kept.withColumn(rank, F.row_number().over(turn)).where(F.col(rank) == 1)
    return kept.select("row.*")
