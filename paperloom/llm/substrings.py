"""Substring dedup: repeated windows of words are found by rolling hashes and removed.

Every window of `WINDOW` words gets a Rabin-Karp hash, a polynomial in its words' hashes. Windows are
dealt out by hash; where one hash stands in several documents, every window but those of the document
with the smallest id is a repeat. Repeats go back to their documents, where overlapping windows merge
into maximal intervals, and the words in those intervals are removed.

What moves is packed: a row is a run of windows of one bucket, 6 bytes of hash and a compressed id for
each window, because a row for each window would take several times the input. Before they move, a task's
windows are combined: of each hash only the least id goes to the hash's bucket, and the other documents,
which are repeats whatever else there is, go straight to the buckets of their ids. So a passage that
stands in every document gives its bucket one entry for each PACK_WINDOWS windows of the corpus, not one
for each document. Buckets follow the size of the input, so a task's share does not grow with it.

Hashes are 48 bits beside the bucket, which come from a second polynomial: with B buckets of n windows
about B * n * n / 2**49 windows of all are taken for repeats wrongly, some 7 in 10**13 at n = 300,000.

Defined results: null and empty texts have no words; texts of fewer words than a window lose none;
repeated rows share their doc_id, so they lose nothing to each other and all that any other document
with a smaller id has; a null doc_id is larger than any other (2**63 - 1 counts as null), and null ids are not
smaller than null; extra columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import next_power_of_two, ship_by_value

WINDOW = 50
#: Bytes of text that a bucket of windows stands for.
BUCKET_BYTES = 1 << 20
LEAST_BUCKETS = 512
#: Bytes of text that are hashed at once, and windows that are packed at once.
SLICE_BYTES = 4 << 20
PACK_WINDOWS = 1_500_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1

ship_by_value(__name__)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words in order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    real = pc.not_equal(words, "")
    parents = np.asarray(pc.list_parent_indices(lists))[np.asarray(real)]
    return np.bincount(parents, minlength=len(texts)), words.filter(real)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, computed once for each different one."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return known[np.asarray(coded.indices)]


def rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every `width` consecutive values, by doubling: H(xy) = H(x) * base**|y| + H(y)."""
    out, have, block, size = None, 0, hashes, 1
    modulus = 1 << 64
    while True:
        if width & size:
            if out is None:
                out, have = block, size
            else:
                n = len(hashes) - have - size + 1
                out = block[:n] * np.uint64(pow(base, have, modulus)) + out[size : size + n]
                have += size
            if have == width:
                return out
        n = len(block) - size
        block = block[:n] * np.uint64(pow(base, size, modulus)) + block[size:]
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(texts: pa.Array, width: int, buckets: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words in each text, all words, and of each window: first word (over all), 48-bit hash, bucket."""
    counts, words = split_words(texts)
    ends = np.cumsum(counts)
    if len(words) < width:
        none = np.empty(0, np.int64)
        return counts, words, none, none.astype(np.uint64), none
    hashes = word_hashes(words)
    starts = np.arange(len(words) - width + 1)
    inside = starts <= (np.repeat(ends, counts) - width)[: len(starts)]
    starts = starts[inside]
    main = mixed(rolled(hashes, width, BASES[0]))[starts] & np.uint64((1 << 48) - 1)
    deal = (mixed(rolled(hashes, width, BASES[1]))[starts] & np.uint64(buckets - 1)).astype(np.int64)
    return counts, words, starts, main, deal


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some SLICE_BYTES of text; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def pack(hashes: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """6 bytes of each hash; ids as compressed differences."""
    low = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return low, pa.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpack(low: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(low) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(low, np.uint8).reshape(n, 6)
    gaps = np.frombuffer(pa.decompress(ids, decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")
    return wide.reshape(-1).view("<u8"), np.cumsum(gaps)


def grouped(keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A row for each key: (key, hashes, ids), packed."""
    order = np.argsort(keys, kind="stable")
    keys, hashes, ids = keys[order], hashes[order], ids[order]
    edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)) if len(keys) else np.zeros(1, np.int64)
    rows = [(int(keys[a]), *pack(hashes[a:b], ids[a:b])) for a, b in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
        names=["bucket", "hashes", "ids"],
    )


def id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids % 65_537) * 40_502 + ids % 65_521) % buckets


PACKED = "bucket bigint, hashes binary, ids binary"
DEALT = f"{PACKED}, repeated boolean"


def new_pairs(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of hash and id once."""
    order = np.lexsort((hashes, ids))
    hashes, ids = hashes[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
    return hashes[new], ids[new]


def combined(deal: np.ndarray, hashes: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT: of each window the least id, by hash; and the windows that have a smaller id here, by id."""
    order = np.argsort(hashes | deal.astype(np.uint64) << np.uint64(48), kind="stable")
    deal, hashes, ids = deal[order], hashes[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (deal[1:] != deal[:-1]))))
    least = np.minimum.reduceat(ids, first)
    late = ids > np.repeat(least, np.diff(np.append(first, len(ids))))
    yield with_flag(grouped(deal[first], hashes[first], least), False)
    if late.any():
        again, owners = new_pairs(hashes[late], ids[late])
        yield with_flag(grouped(id_bucket(owners, buckets), again, owners), True)


def with_flag(rows: pa.RecordBatch, repeated: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array([repeated] * rows.num_rows, pa.bool_())], names=[*rows.schema.names, "repeated"])


def _emitter(width: int, buckets: int, most: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for part in slices(batch, 1):
                counts, _, starts, main, deal = windows(part.column(1), width, buckets)
                owner = np.repeat(np.asarray(pc.fill_null(part.column(0), NO_ID)), np.maximum(counts - width + 1, 0))
                held.append((deal, main, owner))
                waiting += len(main)
                if waiting >= most:
                    yield from combined(*(np.concatenate(x) for x in zip(*held)), buckets)
                    held, waiting = [], 0
        if waiting:
            yield from combined(*(np.concatenate(x) for x in zip(*held)), buckets)

    return emit


def _finder(buckets: int):
    def repeats(table: pa.Table) -> pa.Table:
        passing = table.filter(table.column("repeated")).drop_columns("repeated")  # of this bucket of ids already
        table = table.filter(pc.invert(table.column("repeated")))
        if not table.num_rows:
            return passing
        parts = [unpack(h, i) for h, i in zip(table.column("hashes").to_pylist(), table.column("ids").to_pylist())]
        hashes, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
        late = ids > least
        hashes, ids = new_pairs(hashes[late], ids[late])
        found = pa.Table.from_batches([grouped(id_bucket(ids, buckets), hashes, ids)])
        return pa.concat_tables([found, passing.cast(found.schema)])

    return repeats


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of `total` words some window covers: the windows merged into maximal intervals."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps)[:-1] > 0


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"


def _remover(width: int, with_text: bool):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]
    )

    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        known: dict[int, np.ndarray] = {}
        if found.num_rows:
            parts = [unpack(h, i) for h, i in zip(found.column("hashes").to_pylist(), found.column("ids").to_pylist())]
            hashes, ids = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(ids, kind="stable")
            hashes, ids = hashes[order], ids[order]
            edges = np.flatnonzero(np.diff(ids, prepend=-1, append=-1)).tolist()
            if ids[0] == -1:
                edges = [0, *edges]
            if ids[-1] == -1:
                edges = [*edges, len(ids)]
            known = {int(ids[a]): hashes[a:b] for a, b in zip(edges, edges[1:])}
        out: list[list] = [[], [], [], [], []]
        for batch in docs.select(["doc_id", "text"]).combine_chunks().to_batches():
            for part in slices(batch, 1):
                counts, words, starts, main, _ = windows(part.column(1), width, 1)
                at, seen = 0, 0
                words = words.cast(pa.binary()).to_pylist()
                for ident, n in zip(part.column(0).to_pylist(), counts.tolist()):
                    mine = max(0, n - width + 1)
                    own = words[at : at + n]
                    repeated = known.get(NO_ID if ident is None else ident)
                    removed = 0
                    if repeated is not None and mine:
                        hit = starts[seen : seen + mine][np.isin(main[seen : seen + mine], repeated)] - at
                        gone = covered(hit, width, n)
                        removed = int(gone.sum())
                        own = [w for w, g in zip(own, gone.tolist()) if not g]
                    text = b" ".join(own)
                    for column, value in zip(out, (ident, n, removed, text.decode() if with_text else None, hashlib.sha256(text).hexdigest())):
                        column.append(value)
                    at, seen = at + n, seen + mine
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return remove


def without_repeats(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WINDOW, with_text: bool = True, most: int = PACK_WINDOWS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each row; kept is null unless `with_text`. No result depends on `most`."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, next_power_of_two(-(-total // BUCKET_BYTES)))
    dealt = rows.mapInArrow(_emitter(width, buckets, most), DEALT)
    found = dealt.groupBy("bucket").applyInArrow(_finder(buckets), PACKED)
    marks = found.groupBy("bucket")
    known = F.coalesce("doc_id", F.lit(NO_ID))
    # As id_bucket() deals out what was found.
    place = F.pmod(F.pmod(known, F.lit(65_537)) * 40_502 + F.pmod(known, F.lit(65_521)), F.lit(buckets))
    placed = rows.withColumn("bucket", place)
    return placed.groupBy("bucket").cogroup(marks).applyInArrow(_remover(width, with_text), RESULT)
