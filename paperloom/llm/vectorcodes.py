"""Compress vectors to a few bytes: product codes with integer codebooks, distances from value dictionaries.

A vector's components become integers and are cut into `PARTS` equal consecutive parts; each part gets the index of
the nearest entry of its codebook. Codebooks start as the parts of the vectors with the smallest ids and are improved
by Lloyd rounds in whole numbers, so sums don't depend on the order in which tasks end.

Inside a task the distinct integers of each dimension make a dictionary; the squared differences of every one of them
to all entries are tabulated once, and a part's distances to all entries are gathers and adds over dictionary codes.
A round is one Spark job: tasks add up their parts by entry, Spark adds up the tasks, and what comes to the driver is
the codebooks themselves (entries times width whole numbers, whatever the input). Integers are written down once.

Defined results: vectors that are null or hold a null or non-finite component go; ids order the start, null last, ties
by components; shorter vectors than the longest are filled up with zeros, and so is a width that isn't a multiple of
the number of parts; integers are held to `limit_of(width)` either way (131072 before scaling at width 64), so that
distances fit 64 bits; fewer vectors than entries make smaller codebooks; repeated rows each count; null labels are one
label; sums of errors that 64 bits don't hold are null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined_to_keys, ship_by_value

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors that share one dictionary; it bounds a task's tables.
STEP = 4096
#: Vectors whose distances are held at once, so that they stay in a core's cache.
BLOCK = 256
#: Rows of one label from which on they are dealt out in the join.
HOT_ROWS = 1 << 18

ship_by_value(__name__)


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], whole numbers."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all integers in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit_of(width: int) -> int:
    """The largest integer for which squared distances of vectors of this width fit 62 bits."""
    return math.isqrt((1 << 60) // max(1, width))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def integers(vectors: DataFrame, ident: str, vector: str, label: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the vectors that are kept, written down, and the width of all `ints`."""
    kept = vectors.where(finite(F.col(vector))).select(F.col(ident).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(parts, -(-longest // parts) * parts)
    most = float(limit_of(width))
    held = F.transform("v", lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale).cast("double"), F.lit(-most)), F.lit(most)).cast("long"))
    full = F.concat(held, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return checkpointed(kept.select("vec_id", "label", full.alias("ints"))), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of every row of one part: tables by dimension, then gathers and adds."""
    tables, codes = [], []
    for d in range(rows.shape[1]):
        values, code = np.unique(rows[:, d], return_inverse=True)
        tables.append((values[:, None] - entries[None, :, d]) ** 2)
        codes.append(code)
    if sum(int(t.max()) for t in tables) < 1 << 31:
        tables = [t.astype(np.int32) for t in tables]
    best, far = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), BLOCK):
        block = slice(at, at + BLOCK)
        total = tables[0].take(codes[0][block], axis=0)
        for table, code in zip(tables[1:], codes[1:]):
            total += table.take(code[block], axis=0)
        best[block] = total.argmin(axis=1)  # the first of equal ones
        far[block] = total.min(axis=1)
    return best, far


def _assigned(matrix: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows of the part, codes, distances) of at most STEP vectors."""
    parts, _, size = entries.shape
    for part in range(parts):
        rows = np.ascontiguousarray(matrix[:, part * size : (part + 1) * size])
        yield part, rows, *nearest(rows, entries[part])


def _steps(matrix: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(matrix), STEP):
        yield matrix[at : at + STEP]


def _summed(entries: np.ndarray):
    """Arrow function: sums of a task's parts by entry; position -1 holds how many there are."""
    parts, count, size = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, count, size + 1), np.int64)
        for batch in batches:
            for matrix in _steps(_matrix(batch.column(0), parts * size)):
                for part, rows, codes, _ in _assigned(matrix, entries):
                    order = np.argsort(codes, kind="stable")
                    used, starts = np.unique(codes[order], return_index=True)
                    totals[part, used, 1:] += np.add.reduceat(rows[order], starts, axis=0)
                    totals[part, used, 0] += np.diff(np.append(starts, len(order)))
        part, entry, position = np.nonzero(np.broadcast_to(totals[:, :, :1] > 0, totals.shape))
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(position - 1, pa.int32()), pa.array(totals[part, entry, position])]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "total"])

    return run


def _encoded(entries: np.ndarray):
    """Arrow function: (vec_id, label, code bytes, error) of every vector."""
    parts, _, size = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in enumerate(_steps(_matrix(batch.column(2), parts * size))):
                codes, error = np.empty((len(matrix), parts), np.uint8), np.zeros(len(matrix), np.int64)
                for part, _, best, far in _assigned(matrix, entries):
                    codes[:, part] = best
                    error += far
                here = batch.slice(at * STEP, len(matrix))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), packed, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def train(ints: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of (vec_id, ints): the smallest ids' parts, then Lloyd rounds over all rows."""
    if entries > 256:
        raise ValueError("a code is one byte a part: at most 256 entries")
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()  # `entries` rows
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums = ints.select("ints").mapInArrow(_summed(books), "part int, entry int, position int, total long")
        sums = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).toPandas()  # at most the codebooks' size
        totals = np.zeros((parts, len(first), width // parts + 1), np.int64)
        totals[sums["part"], sums["entry"], sums["position"] + 1] = sums["total"]
        used = totals[:, :, 0] > 0
        books[used] = totals[:, :, 1:][used] // totals[:, :, :1][used]  # rounds down
    return Codebooks(books)


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part, and the squared distance to what they stand for."""
    kind = dict(ints.dtypes)
    coded = ints.select("vec_id", "label", "ints").mapInArrow(_encoded(books.entries), f"vec_id {kind['vec_id']}, label {kind['label']}, code binary, error long")
    return coded.withColumn("code", F.lower(F.hex("code")))


def decode(coded: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """Add `approximation`, the vector that a code stands for, in the scale of the input."""
    held = F.array(*[F.array(*[F.lit(e.tolist()) for e in part]) for part in books.entries])
    digits = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books.entries))]
    whole = F.concat(*[held[p][d] for p, d in enumerate(digits)])
    return coded.withColumn("approximation", F.transform(whole, lambda x: (x + F.lit(0.5)) / scale))


def compress(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", hot: int = HOT_ROWS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that is kept."""
    ints, width = integers(vectors, ident, vector, label)
    books = train(ints, width)
    key = F.coalesce(F.concat(F.lit("0"), F.col("label").cast("string")), F.lit("1"))  # null labels are one
    coded = checkpointed(encode(ints, books).withColumn("label_key", key).drop("label"))
    sums = coded.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("all"), F.count(F.lit(1)).alias("held"))
    sums = checkpointed(sums.select("label_key", F.expr("try_cast(`all` AS bigint)").alias("label_error"), "held"))
    return joined_to_keys(coded, sums, "label_key", "held", hot).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
