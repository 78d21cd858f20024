"""SentencePiece encoding and decoding: batched numpy Viterbi over words.

Texts are cut before each run of the space mark and around characters that no piece holds; no piece
spans such a cut, so the parts encode on their own, and each different word of a slice is encoded once.
Parts of equal length advance together: at every end position the hashes of all their substrings probe
the sorted hashes of the pieces, and the largest score of each column of hits keeps a backpointer.

The model file at hand is a byte-pair model, whose result is not the segmentation of the best total
score. What makes the Viterbi exact for it is the state: a piece may follow another only if merging
could not have gone on across their border, which is a property of the two pieces alone. A prefix has
one such path, so the maximum is taken over the admissible pieces only. The admissibility of pairs is
decided for whole arrays at once by undoing merges from the border outwards. Models whose scores are
not merge ranks (unigram ones) are refused.

Ids of a slice stay flat arrays: words are coded by Arrow, remembered words gather their ids, ids gather
their bytes, and Python meets a text once, for its digests. Pieces come from the model's vocabulary
through the sentencepiece library; encoding and decoding do not use it. Characters outside the vocabulary
become byte pieces. Encoding marks spaces and adds one in front, as the model says; a model that
normalises texts is refused.

Defined results: null is an empty text; an empty text has no pieces; repeated rows get equal results; an
empty table gives an empty one; extra columns are left out of encode() and pass through decode(). Texts
and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text encoded at once.
SLICE_BYTES = 8 << 20
#: Substrings of parts of one length that advance together.
WIDTH = 1 << 14
#: Words that a task remembers before it starts afresh; no result depends on it.
MEMO_WORDS = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Parts longer than this are cut where no piece holds both neighbours.
LONG_PART = 200
#: Leading bits of a hash that lead into the sorted keys.
LEAD_BITS = 20

ship_by_value(__name__)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values from each start on, as many as its count, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + len(values) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((starts - (ends - counts)).astype(kind), counts)
    return values[at]


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Hashed:
    """Sorted keys with values. A probe starts where its leading bits do; most probes of other keys end there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        rise = np.argsort(keys)
        keys = keys[rise]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.values = values[rise]
        heads = np.arange(1 << LEAD_BITS, dtype=np.uint64) << np.uint64(64 - LEAD_BITS)
        first = np.append(np.searchsorted(keys, heads), len(keys))
        self.first = first[:-1].astype(np.int32)
        self.seen = np.diff(first) > 0
        self.deepest = int(np.diff(first).max())
        self.keys = np.append(keys, np.repeat(keys[-1:], self.deepest))  # so that every step stays inside

    def maybe(self, probes: np.ndarray) -> np.ndarray:
        return self.seen[probes >> np.uint64(64 - LEAD_BITS)]

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which probes are keys, and the values of those."""
        at = self.first[probes >> np.uint64(64 - LEAD_BITS)]
        found = self.keys[at] == probes
        for _ in range(1, self.deepest):
            at = at + ~found
            found = self.keys[at] == probes
        return found, self.values[at[found]]


def read_model(path: str) -> dict:
    """The vocabulary of a model file in plain values."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    size = library.get_piece_size()
    kinds = ["byte" if library.is_byte(i) else "none" if library.is_control(i) or library.is_unknown(i) else "piece" for i in range(size)]
    scores = [library.get_score(i) for i in range(size)]
    if kinds.count("byte") != 256 or library.encode("a  b") != library.encode("a  b ")[:-1]:
        raise ValueError("the model has no byte pieces, or it changes spaces")
    if any(s != round(s) for s, k in zip(scores, kinds) if k == "piece"):
        raise ValueError("the model's scores are not merge ranks")
    return {"text": [library.id_to_piece(i) for i in range(size)], "kinds": kinds, "scores": scores}


class Pieces:
    """The vocabulary as sorted arrays, with the merge that made each piece."""

    def __init__(self, model: dict) -> None:
        self.text, kinds, score = model["text"], model["kinds"], model["scores"]
        self.size = size = len(self.text)
        self.bytes_id = np.zeros(256, np.int32)
        for i, p in enumerate(self.text):
            if kinds[i] == "byte":
                self.bytes_id[int(p[3:5], 16)] = i
        normal = [i for i in range(size) if kinds[i] == "piece"]
        self.known = sorted({c for i in normal for c in self.text[i]})
        #: Merging takes the pair whose piece has the best score; ranks put the best first.
        self.rank = np.full(size, size, np.int64)
        self.rank[sorted(normal, key=lambda i: (-score[i], i))] = np.arange(len(normal))
        ids = {self.text[i]: i for i in normal}
        pairs = {}
        for i in normal:
            piece = self.text[i]
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        kept = [i for i in normal if self._unmerge(i, pairs, ids)]
        self.longest = max(len(self.text[i]) for i in kept)
        made = np.array(list(pairs.values()), np.int64)
        self.pairs = Hashed(self.pair_key(np.array(list(pairs), np.uint64)), self.rank[made])
        hashes = np.empty(len(kept), np.uint64)
        for length in range(1, self.longest + 1):
            own = [n for n, i in enumerate(kept) if len(self.text[i]) == length]
            if own:
                codes = np.array([[ord(c) for c in self.text[kept[n]]] for n in own], np.uint64)
                hashes[own] = self.hash(codes)
        self.table = Hashed(hashes, np.array(kept, np.int64))
        plain = [
            bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "none" else p.replace(SPACE, " ").encode()
            for p, k in zip(self.text, kinds)
        ]
        #: Neighbouring characters inside pieces: no piece spans another pair.
        self.together = np.unique([ord(a) << 32 | ord(b) for i in normal for a, b in zip(self.text[i], self.text[i][1:])])
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_size = np.array([len(p) for p in plain], np.int64)
        self.plain_start = offsets_of(self.plain_size)[:-1]

    def state(self) -> dict:
        """All of it in plain values, so that tasks need not build it again."""
        return {name: vars(x) if isinstance(x, Hashed) else x for name, x in vars(self).items()}

    @classmethod
    def restored(cls, state: dict) -> Pieces:
        out = cls.__new__(cls)
        for name, x in state.items():
            if isinstance(x, dict):
                x, fields = Hashed.__new__(Hashed), x
                vars(x).update(fields)
            setattr(out, name, x)
        return out

    @staticmethod
    def hash(codes: np.ndarray) -> np.ndarray:
        """Hash of each row of characters."""
        out = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            out = _mix(out * MULTIPLIER + codes[:, j] + np.uint64(1))
        return out

    @staticmethod
    def pair_key(pair: np.ndarray) -> np.ndarray:
        """A one-to-one mix of a pair's number."""
        return pair * MULTIPLIER ^ (pair * MULTIPLIER >> np.uint64(32))

    def _unmerge(self, piece: int, pairs: dict, ids: dict) -> bool:
        """Merge the characters of a piece; note the last merge. False if another result comes out."""
        parts = [ids.get(c) for c in self.text[piece]]
        if None in parts:
            return False
        while len(parts) > 1:
            best = min(
                ((self.rank[pairs[k]], i) for i in range(len(parts) - 1) if (k := parts[i] * self.size + parts[i + 1]) in pairs),
                default=None,
            )
            if best is None:
                return False
            at = best[1]
            made = pairs[parts[at] * self.size + parts[at + 1]]
            if made == piece and len(parts) == 2:
                self.left[piece], self.right[piece] = parts
            parts[at : at + 2] = [made]
        return parts[0] == piece

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbours merge into; the size of the vocabulary if none."""
        keys = self.pair_key((left * self.size + right).astype(np.uint64))
        out = np.full(len(keys), self.size, np.int64)
        at = np.flatnonzero(self.pairs.maybe(keys))
        found, rank = self.pairs.find(keys[at])
        out[at[found]] = rank
        return out

    def admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces stay apart: no merge across their border comes before those inside them.

        Seen from the border, the piece made last is undone first. A merge of the parts at the border
        would have come first if its rank is below that of what was undone, or at the same rank if it
        stands further left.
        """
        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left, right
        limit_left = limit_right = np.full(len(left), self.size)
        while len(live):
            rank = self.merged(a, b)
            # What the left part became next keeps precedence on ties (it stands further left).
            early = (rank < limit_left) & (rank <= limit_right) & (rank < self.size)
            good[live[early]] = False
            single_a, single_b = self.left[a] < 0, self.left[b] < 0
            stay = np.flatnonzero(~(early | (single_a & single_b)))
            live, a, b, limit_left, limit_right = live[stay], a[stay], b[stay], limit_left[stay], limit_right[stay]
            single_a = single_a[stay]
            rank_a, rank_b = np.where(single_a, -1, self.rank[a]), np.where(single_b[stay], -1, self.rank[b])
            undo_a = (rank_a > rank_b) | ((rank_a == rank_b) & ~single_a)
            undo_b = rank_a <= rank_b
            limit_left = np.where(undo_a, rank_a, limit_left)
            limit_right = np.where(undo_b, rank_b, limit_right)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
        return good

    def shorter(self, part: str) -> list[str]:
        """A long part cut wherever no piece holds both neighbours."""
        codes = codes_of(part).astype(np.int64)
        cuts = (np.flatnonzero(~np.isin(codes[:-1] << 32 | codes[1:], self.together)) + 1).tolist()
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]

    def encode_parts(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all parts, end to end, and how many each has. codes: their characters, all known, end to end."""
        starts = offsets_of(lengths)[:-1]
        counts = np.zeros(len(lengths), np.int64)
        order, found = [], []
        by_length = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[by_length], prepend=-1, append=-1)) if len(lengths) else []
        for a, b in zip(edges, edges[1:]):
            length = int(lengths[by_length[a]])
            for c in range(a, b, WIDTH):
                own = by_length[c : min(b, c + WIDTH)]
                ids, n = self._advance(codes[starts[own][:, None] + np.arange(length)].T.astype(np.uint64))
                counts[own] = n
                order.append(own)
                found.append(ids)
        if not order:
            return np.empty(0, np.int32), counts
        own = np.concatenate(order)
        flat = np.concatenate(found).astype(np.int32)
        start = np.empty(len(lengths), np.int64)
        start[own] = offsets_of(counts[own])[:-1]
        return gathered(flat, start, counts), counts

    def _advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, and their numbers, of parts of one length; codes has a column for each part."""
        length, n = codes.shape
        last = np.full((length + 1, n), -1, np.int32)  # the piece that ends at a position
        back = np.zeros((length + 1, n), np.int32)
        reached = np.zeros((length + 1, n), bool)
        reached[0] = True
        each = np.arange(n)
        hashes = np.zeros((0, n), np.uint64)  # row r: of the substring of r + 1 characters to the end in hand
        for end in range(1, length + 1):
            wide = min(end, self.longest)
            before = np.zeros((wide, n), np.uint64)
            before[1:] = hashes[: wide - 1]
            hashes = _mix(before * MULTIPLIER + (codes[end - 1] + np.uint64(1)))
            row, word = np.nonzero(self.table.maybe(hashes) & reached[end - wide : end][::-1])
            found, piece = self.table.find(hashes[row, word])
            row, word = row[found], word[found]
            start = end - 1 - row
            inner = np.flatnonzero(start)
            fits = np.ones(len(row), bool)
            fits[inner] = self.admissible(last[start[inner], word[inner]].astype(np.int64), piece[inner])
            row, word, piece = row[fits], word[fits], piece[fits]
            score = np.full((wide, n), -self.size)
            score[row, word] = -self.rank[piece]
            made = np.full((wide, n), -1, np.int32)
            made[row, word] = piece
            best = score.argmax(axis=0)
            last[end] = made[best, each]
            back[end] = end - 1 - best
            reached[end] = last[end] >= 0
        if not reached[length].all():
            raise ValueError("a part has no segmentation")
        # Walk all parts back together; the last pieces come first.
        rows, at = [], np.full(n, length)
        while at.any():
            rows.append(np.where(at > 0, last[at, each], -1))
            at = np.where(at > 0, back[at, each], 0)
        ids = np.array(rows[::-1], np.int32).T
        real = ids >= 0
        return ids[real], real.sum(axis=1)


class Coder:
    """Encodes and decodes with a memory of the words that it has met."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.known = set(pieces.known)
        inside = "".join(re.escape(c) for c in pieces.known if c != SPACE)
        self.cut = re.compile(f"{SPACE}+[{inside}]*|[{inside}]+|.", re.DOTALL).findall
        #: Characters inside a part, by code point.
        self.inner = np.zeros(0x110000, bool)
        self.inner[[ord(c) for c in pieces.known if c != SPACE]] = True
        self.marked = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words that are not known yet; the mark in front of a word is left out."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = codes_of(SPACE + SPACE.join(words))
        edges = offsets_of(sizes)
        # Known characters only, no mark but the one in front, and not long: such a word is one part.
        marks = offsets_of(~self.inner[codes])[edges]
        plain = (np.diff(marks) == 1) & (sizes <= LONG_PART)
        own = np.flatnonzero(plain)
        ids, counts = self.pieces.encode_parts(gathered(codes, edges[:-1][own], sizes[own]), sizes[own])
        rest = np.flatnonzero(~plain)
        more, more_counts = self._in_parts([words[i] for i in rest.tolist()])
        place = np.empty(len(words), np.int64)
        place[own], place[rest] = np.arange(len(own)), np.arange(len(own), len(words))
        flat, counts = np.concatenate((ids, more)), np.concatenate((counts, more_counts))
        self.starts = np.concatenate((self.starts, (offsets_of(counts)[:-1] + len(self.ids))[place]))
        self.counts = np.concatenate((self.counts, counts[place]))
        self.ids = np.concatenate((self.ids, flat))
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))

    def _in_parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that fall into several parts, end to end, and how many each has."""
        lists = [self.cut(SPACE + w) for w in words]
        for i in [i for i, w in enumerate(words) if len(w) > LONG_PART]:
            lists[i] = [p for part in lists[i] for p in (self.pieces.shorter(part) if len(part) > LONG_PART else [part])]
        place: dict[str, int] = {}
        used = np.array([place.setdefault(p, len(place)) for parts in lists for p in parts], np.int64)
        plain = [p for p in place if len(p) > 1 or p in self.known]
        other = [p for p in place if not (len(p) > 1 or p in self.known)]
        ids, counts = self.pieces.encode_parts(codes_of("".join(plain)), np.array([len(p) for p in plain], np.int64))
        ids = np.concatenate((ids, self.pieces.bytes_id[np.frombuffer("".join(other).encode(), np.uint8)]))
        counts = np.concatenate((counts, np.array([len(p.encode()) for p in other], np.int64)))
        row = np.empty(len(place), np.int64)
        row[[place[p] for p in plain + other]] = np.arange(len(place))
        used = row[used]
        ends = offsets_of(counts[used])[offsets_of(np.array([len(x) for x in lists], np.int64))]
        return gathered(ids, offsets_of(counts)[:-1][used], counts[used]), np.diff(ends)

    def _coded(self, words: pa.Array) -> np.ndarray:
        """The remembered number of each word."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        known = self.memo.get
        numbers = np.fromiter((known(w, -1) for w in names), np.int64, len(names))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = np.arange(len(self.memo), len(self.memo) + len(fresh))
            self._learn([names[i] for i in fresh.tolist()])
        return numbers[np.asarray(coded.indices)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts (no nulls), end to end, and how many each has.

        Between single spaces a text falls into words; a text with runs of spaces, or with the mark itself,
        is cut before each run of marks.
        """
        odd = np.asarray(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}|^$").cast(pa.uint8())).astype(bool)
        lists = pc.split_pattern(texts, " ")
        if odd.any():
            cut = [[p[1:] for p in self.marked(SPACE + t.replace(" ", SPACE))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
            # Texts in two groups, then back in order.
            order = np.argsort(np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd))), kind="stable")
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), pa.array(cut, lists.type)]).take(pa.array(order))
        n_words = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        words = lists.flatten()
        if not len(words):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        codes = self._coded(words)
        counts = self.counts[codes]
        ends = offsets_of(counts)[offsets_of(n_words)]
        return gathered(self.ids, self.starts[codes], counts), np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The text of each run of ids, in UTF-8 where the bytes are; without the space in front that encoding adds."""
        sizes = self.pieces.plain_size[ids]
        flat = gathered(self.pieces.plain, self.pieces.plain_start[ids], sizes).tobytes()
        ends = offsets_of(sizes)[offsets_of(counts)].tolist()
        for a, b in zip(ends, ends[1:]):
            yield flat[a + 1 : b] if flat[a : a + 1] == b" " and a < b else flat[a:b]


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


ENCODED = "doc_id bigint, n_pieces bigint, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


@lru_cache(maxsize=2)
def load(model: str = MODEL) -> Pieces:
    return Pieces(read_model(model))


def _encoder(state):  # noqa: ANN001, ANN202  a broadcast variable, or anything with a state as its value
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in _batches(batches, 1):
            coder = coder or Coder(Pieces.restored(state.value))
            texts = pc.fill_null(part.column(1), "")
            ids, counts = coder.encode(texts)
            offsets = offsets_of(counts)
            packed, own = ids.astype("<i4").tobytes(), offsets.tolist()
            digests = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(own, own[1:])]
            backs, same = [], []
            for back, text in zip(coder.decode(ids, counts), texts.cast(pa.binary()).to_pylist()):
                whole = back == text
                same.append(whole)
                backs.append(hashlib.sha256(back if whole else back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())),
                    pa.array(digests, pa.string()),
                    pa.array(backs, pa.string()),
                    pa.array(same, pa.bool_()),
                ],
                schema=schema,
            )

    return encode


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """ENCODED of each row: its piece ids, digests of them and of their decoded text, and if that is the text.

    The model is read on the driver; its arrays (some 20 MB) go out as a broadcast variable.
    """
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(docs.sparkSession.sparkContext.broadcast(load(model).state())), ENCODED)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of each row's piece ids; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model).state())

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(Pieces.restored(shared.value))
        for values in batches:
            counts = np.array([0 if x is None else len(x) for x in values], np.int64)
            flat = np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in values if x is not None]])
            yield pd.Series([x.decode("utf-8", "replace") for x in coder.decode(flat, counts)])

    return encoded.withColumn(out, decoded(F.col(ids)))
