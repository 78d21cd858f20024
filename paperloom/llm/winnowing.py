"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003), in DataFrame functions only.

Words are hashed, `K` consecutive word hashes make one polynomial (Rabin-Karp) k-gram hash, and each
window of `W` consecutive k-grams gives its least hash, the rightmost one on ties. A selected k-gram is
kept once, with its position. Any passage of `K + W - 1` words that two texts share therefore leaves at
least one common fingerprint.

Defined results: null is an empty text; an empty text has an empty fingerprint; a text of fewer than
`K` words is one k-gram of all its words; a text of fewer than `W` k-grams is one window. Texts of any
length keep all their positions. Equal texts and repeated rows have equal fingerprints, whatever other
columns the table has; an empty table gives an empty one. with_fingerprint() replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, let, words_of

K = 5
W = 8
#: A prime below 2**41 and a base below 2**21: hash * base + word fits a long.
PRIME = 2_199_023_255_531
BASE = 1_299_709
#: Inside a stretch of SPAN k-grams one long is hash * SPAN + (SPAN - 1 - place), so that the least value of
#: a window is its least hash and, among equals, the rightmost. Longer texts go by stretches that overlap.
SPAN = 1 << 21


def _grams(hashes: Column, k: int) -> Column:
    """Polynomial hash of each k consecutive word hashes."""
    count = F.size(hashes) - (k - 1)
    step = lambda a, b: (a * BASE + b) % PRIME
    rolled = F.slice(hashes, 1, count)
    for j in range(2, k + 1):
        rolled = F.zip_with(rolled, F.slice(hashes, j, count), step)
    whole = F.array(F.aggregate(hashes, F.lit(0).cast("long"), step))
    return F.when(F.size(hashes) >= k, rolled).when(F.size(hashes) > 0, whole).otherwise(F.array().cast("array<long>"))


def _minima(values: Column, w: int) -> Column:
    """Least value of each w consecutive ones, by doubling the width covered."""

    def widen(now: Column, have: int) -> Column:
        if have == w:
            return now
        shift = min(have, w - have)
        return let(
            now,
            lambda x: widen(
                F.zip_with(F.slice(x, 1, F.size(x) - shift), F.slice(x, shift + 1, F.size(x) - shift), lambda a, b: F.least(a, b)),
                have + shift,
            ),
        )

    return let(
        values,
        lambda v: F.when(F.size(v) >= w, widen(v, 1)).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v),
    )


def _places(grams: Column, w: int, span: int) -> Column:
    """Positions of the selected k-grams, in order, each once."""

    def chosen(part: Column, start: Column | int) -> Column:
        packed = F.transform(part, lambda g, i: g * span + (span - 1 - i))
        return F.transform(F.array_distinct(_minima(packed, w)), lambda v: start + ((span - 1) - v % span))

    step = span // 2
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(grams) - w) / step).cast("int")),
        lambda c: chosen(F.slice(grams, c * step + 1, step + w - 1), c.cast("long") * step),
    )
    return F.when(F.size(grams) <= span, chosen(grams, F.lit(0).cast("long"))).otherwise(F.array_distinct(F.flatten(stretches)))


def fingerprint(text: Column, k: int = K, w: int = W, span: int = SPAN) -> Column:
    """array<struct<hash, position>>: the selected k-grams of a text in order of position. No result depends on `span` (over 2 * w)."""
    hashes = F.transform(words_of(text), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))
    return let(
        let(hashes, lambda h: _grams(h, k)),
        lambda g: F.transform(_places(g, w, span), lambda p: F.struct(F.get(g, p.cast("int")).alias("hash"), p.alias("position"))),
    )


def hashes_of(selected: Column) -> Column:
    """The distinct k-gram hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(selected, lambda s: s["hash"]))


def as_string(selected: Column) -> Column:
    """`hash@position` of each selected k-gram, comma-joined; hashes in hexadecimal."""
    return F.array_join(F.transform(selected, lambda s: F.concat(F.lower(F.hex(s["hash"])), F.lit("@"), s["position"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes: 1 for two empty ones, 0 if only one is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of `text` as array<struct<hash, position>>; other columns pass through."""
    return docs.withColumn(out, fingerprint(F.col(text)))


def following(ids: DataFrame, key: str, out: str) -> DataFrame:
    """For each distinct key the next one in descending order; after the last, the first. Null counts as least."""
    written, part = in_order(ids, [F.col(key).desc_nulls_last()])
    present = "key_present"
    held = written.withColumn(present, F.lit(True))
    inside = Window.partitionBy(part).orderBy(F.col(key).desc_nulls_last())
    # The first key of each range: as many rows as there are ranges, so one task and a broadcast are enough.
    heads = held.withColumn("place", F.row_number().over(inside)).where("place = 1").select(part, F.col(key).alias("head"))
    across = Window.partitionBy(F.lit(0)).orderBy(part)
    heads = heads.select(
        part,
        F.lead(F.struct(F.col("head"))).over(across).alias("after"),
        F.first(F.struct(F.col("head"))).over(across).alias("top"),
    )
    heads = heads.select(part, F.coalesce("after", "top").alias("after"))
    linked = held.withColumn("mate", F.lead(F.struct(F.col(key).alias("head"))).over(inside))
    linked = linked.join(F.broadcast(heads), part)
    return linked.withColumn(out, F.coalesce("mate", "after")["head"]).drop(part, present, "mate", "after")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's, and compare them.

    The edited text has its last third of code points replaced by as many from the start of the next
    document. Rows that share a doc_id each get a result; as a next document, the least of their texts
    stands for them. A single document follows itself.

    Texts move once, by doc_id. What then goes to the document before is the start that the edit takes
    and the hashes of the fingerprint, never a whole text.
    """
    rows = docs.select("doc_id", "text")
    length = F.coalesce(F.length("text"), F.lit(0))
    ids = rows.groupBy("doc_id").agg(F.max(length).alias("longest"), F.count(F.lit(1)).alias("copies"))
    ids = following(ids, "doc_id", "next_id")
    links = ids.select(
        F.col("next_id").alias("taken_id"),
        F.col("doc_id").alias("owner_id"),
        F.floor(F.col("longest") / 3).cast("int").alias("need"),
    )
    donors = rows.join(links, rows["doc_id"].eqNullSafe(links["taken_id"]))
    if ids.where("copies > 1").limit(1).count():
        least = donors.groupBy("owner_id").agg(F.min(F.struct("text")).alias("least"), F.first("need").alias("need"))
        donors = least.select("owner_id", "need", "least.text")
    starts = donors.select(
        "owner_id",
        F.expr("left(text, need)").alias("start"),
        hashes_of(fingerprint(F.col("text"))).alias("next_hashes"),
    )
    joined = rows.join(starts, rows["doc_id"].eqNullSafe(starts["owner_id"]), "left")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = joined.select(
        "doc_id",
        "text",
        length.cast("long").alias("n_chars"),
        F.coalesce("start", F.lit("")).alias("start"),
        "next_hashes",
    ).withColumn(
        "edited",
        F.concat(
            F.left(F.coalesce("text", F.lit("")), (F.col("n_chars") - third).cast("int")), F.left("start", third)
        ),
    )
    marked = edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("own"),
        fingerprint(F.col("edited")).alias("changed"),
        "next_hashes",
    )
    sets = marked.select("*", hashes_of(F.col("own")).alias("own_set"), hashes_of(F.col("changed")).alias("changed_set"))
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("changed_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.coalesce("next_hashes", F.array().cast("array<long>"))).alias("near_next"),
        F.size("own").cast("long").alias("n_selected"),
    )
