"""Draw documents that resemble a target text collection: hashed n-gram importance resampling (Xie et al., 2023).

Features are runs of one and two consecutive words; a feature's bucket is the CRC-32 of its bytes modulo `BUCKETS`.
A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, a document's weight the mean
gain over its features, and the documents with the highest weight plus Gumbel noise are drawn, which is drawing
without replacement in proportion to the exponential of the weight.

No feature is built as a string. The distinct words of a slab of whole texts, each bounded by delimiters, are the
dictionary of an Aho-Corasick automaton and carry a payload: the CRCs of the word and of the word with a delimiter, and
the length. Scanning a text emits the payloads of its words in order; the CRC of a pair follows from two adjacent
payloads, as CRC(ab) = shift(CRC(a), |b|) xor CRC(b), where the shift is four table look-ups.

Texts are scanned once and the buckets of their features written down, two bytes each, about as much as the compressed
texts; counting and scoring read those (a second scan would double the time, most of which is the scan). Tasks add up their own buckets, Spark adds up the tasks, and what comes to the driver is `BUCKETS` totals. Ranks are
counted in ranges of the score and between them, so no task sorts all documents.

Defined results: null texts have no words; the weight of a text without words is 0; null ids are written as nothing in
the noise and come last among ties; rows that share an id and a score are ranked by weight and number of features;
repeated rows are each scored and ranked; an empty target has all counts zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, in_order, numbered_groups, ship_by_value

BUCKETS = 10_000
SEED = "7"
LEAST_WORDS = 20
#: Percent of the documents with LEAST_WORDS words that are drawn.
DRAWN = 25
#: Bytes of text that share one dictionary; a longer text has one of its own.
SLAB = 4 << 20
#: Fixed value: the reversed CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320

#: Tables of shifts over fewer bytes than this are kept by a worker.
MEMO_LENGTH = 256
SHIFTS: dict[int, np.ndarray] = {}

#: A-Z in lower case; ASCII that is neither letter nor digit becomes a space; all other bytes stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

ship_by_value(__name__)


def _applied(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits (images of the single bits) applied to each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def shift_table(length: int) -> np.ndarray:
    """[4, 256]: what each byte of a CRC becomes over `length` more bytes; the four are combined by xor."""
    if length in SHIFTS:
        return SHIFTS[length]
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):  # over one byte
        matrix = np.where(matrix & np.uint32(1), matrix >> np.uint32(1) ^ np.uint32(POLYNOMIAL), matrix >> np.uint32(1))
    left = length
    while left:
        if left & 1:
            values = _applied(matrix, values)
        matrix, left = _applied(matrix, matrix), left >> 1  # over twice as many
    if length < MEMO_LENGTH:
        SHIFTS[length] = values
    return values


class Payloads:
    """What the distinct words of a slab carry, and the CRCs of words and of adjacent words from it."""

    def __init__(self, words: list[bytes]):
        self.alone = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.before = np.array([zlib.crc32(b" ", zlib.crc32(w)) for w in words], np.uint32)  # with the space after it
        lengths, self.shift = np.unique(np.array([len(w) for w in words], np.int64), return_inverse=True)
        self.tables = np.array([shift_table(n) for n in lengths.tolist()], np.uint32).reshape(-1, 4, 256)

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """CRC-32 of each two adjacent words and the space between them."""
        left, right = self.before[ids[:-1]], ids[1:]
        out, row = self.alone[right], self.shift[right]
        for k in range(4):
            out ^= self.tables[row, k, left >> np.uint32(8 * k) & np.uint32(255)]
        return out


def _slabs(texts: pa.Array) -> Iterator[list[bytes]]:
    """Folded whole texts, together about SLAB bytes."""
    held, size = [], 0
    for text in texts:
        folded = (text.as_py() or b"").translate(FOLDED)
        held.append(folded)
        size += len(folded)
        if size >= SLAB:
            yield held
            held, size = [], 0
    if held:
        yield held


def _buckets_of(slab: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, bucket of every feature) of each text of a slab."""
    distinct: set[bytes] = set()
    for text in slab:
        distinct.update(text.split())
    if not distinct:
        yield from ((0, np.empty(0, np.uint16)) for _ in slab)
        return
    words = list(distinct)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(words):
        automaton.add_word(f" {word.decode('latin-1')} ", i)  # a character stands for a byte
    automaton.make_automaton()
    payloads = Payloads(words)
    for text in slab:
        ids = np.array([i for _, i in automaton.iter(f" {text.decode('latin-1')} ")], np.int64)
        found = np.concatenate((payloads.alone[ids], payloads.pairs(ids))) if len(ids) > 1 else payloads.alone[ids]
        yield len(ids), (found % np.uint32(buckets)).astype(np.uint16)


def _featured(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for slab in _slabs(batch.column(1)):
                found = [(n, b.tobytes()) for n, b in _buckets_of(slab, buckets)]
                n_words, packed = pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(slab)), n_words, packed], names=["doc_id", "n_words", "buckets"])
                at += len(slab)

    return run


def featured(texts: DataFrame, ident: Column, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets) for each row: the bucket of every feature in two bytes, repeats included."""
    if buckets > 1 << 16:
        raise ValueError("a bucket is two bytes")
    rows = texts.select(ident.cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_featured(buckets), "doc_id long, n_words long, buckets binary")


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                totals += np.bincount(np.frombuffer(packed.as_py(), np.uint16), minlength=buckets)
        used = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], names=["bucket", "n"])

    return run


def counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    found = features.select("buckets").mapInArrow(_counter(buckets), "bucket int, n long")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    out[found["bucket"]] = found["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in pairs], np.int64)


def _weigher(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b.as_py(), np.uint16) for b in batch.column(2)]
            sizes = pa.array([len(b) for b in found], pa.int64())
            means = pa.array([int(gains[b].sum()) // len(b) if len(b) else 0 for b in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, means], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row."""
    return features.mapInArrow(_weigher(gains), "doc_id long, n_words long, n_features long, weight long")


def noise(ident: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, share: int = DRAWN, least: int = LEAST_WORDS) -> DataFrame:
    """Add `rank` to the rows that are drawn, null for the others; each row is dealt out once."""
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    written, part = in_order(scored.withColumn("able", F.col("n_words") >= least), order)
    held = written.groupBy(part).agg(F.count_if("able").alias("held")).withColumn("whole", F.lit(0))
    before = numbered_groups(held, ["whole"], [part], "held", "before").select(part, "before", F.sum("held").over(Window.partitionBy("whole")).alias("all_able"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(part).orderBy(*order))
    drawn = F.col("able") & (place <= F.floor(F.lit(share) * F.col("all_able") / 100))
    joined = written.join(F.broadcast(before), part)  # a row for each range
    return joined.withColumn("rank", F.when(drawn, place.cast("long"))).drop(part, "before", "all_able", "able")


def resample(docs: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of `docs`."""
    own = checkpointed(featured(docs, F.col(ident), text))
    gains = gains_of(counts(own), counts(featured(target, F.lit(None), target_text)))
    scored = weights(own, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are drawn, with their columns and `draw_rank`; rows that share an id go together."""
    (key,) = fresh(docs, "draw_key")
    picked = resample(docs, target, ident, text).where(F.col("rank").isNotNull()).groupBy("doc_id").agg(F.min("rank").alias("draw_rank"))
    picked = picked.withColumnRenamed("doc_id", key)
    return docs.join(picked, docs[ident].cast("long").eqNullSafe(picked[key])).drop(key)
