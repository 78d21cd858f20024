"""Importance resampling against its definition; CRCs of joined strings against zlib."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import importance

from .documents import SCHEMA, rows, sentence, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def by_definition(docs, target):
    """{doc_id: (n_features, weight, score, rank)} for rows with different ids."""
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    found = {}
    for ident, text in docs:
        words, all_of = features(text)
        weight = sum(gain[bucket(f)] for f in all_of) // len(all_of) if all_of else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        found[ident] = (len(all_of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20)
    order = sorted((i for i in found if found[i][3]), key=lambda i: (-found[i][2], i is None, i or 0))
    rank = {i: n + 1 for n, i in enumerate(order[: 25 * len(order) // 100])}
    return {i: (*found[i][:3], rank.get(i)) for i in found}


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("slab", [1, 300, importance.SLAB])
def test_weights_and_ranks_equal_their_definition(spark, slab, monkeypatch):
    monkeypatch.setattr(importance, "SLAB", slab)
    rng = random.Random(3)
    data = [(i, t) for i, t, *_ in rows(n=120)] + [(None, sentence(rng, 30)), (2000, "A-b_C\x00d  É\u2028x 9z\n" * 9), (2001, "q " * 60_000), (2002, "w" * 70_000)]
    texts = [sentence(rng, 40) for _ in range(8)] + [None, "", data[3][1]]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = importance.resample(docs, target(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got} == by_definition(data, texts)
    assert len(got) == len(data)


def test_crc_of_pairs_is_that_of_the_joined_words():
    rng = random.Random(5)
    words = list({bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 3, 17, 255, 256, 257, 5000]))) for _ in range(40)})
    payloads = importance.Payloads(words)
    ids = np.array([rng.randrange(len(words)) for _ in range(300)])
    want = [zlib.crc32(words[a] + b" " + words[b]) for a, b in zip(ids, ids[1:])]
    assert payloads.pairs(ids).tolist() == want


def test_repeated_rows_empty_tables_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text, 5, "x")] * 8 + [(2, None, 0, "y")], "doc_id int, text string, weight int, rank string")
    got = importance.resample(docs, target(spark, [])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 9
    assert importance.drawn(docs, target(spark, [text])).columns == [*docs.columns, "draw_rank"]
    assert importance.drawn(docs, target(spark, [text])).count() == 8  # rows that share an id go together
    assert importance.resample(spark.createDataFrame([], SCHEMA), target(spark, [text])).count() == 0


def test_documents_like_the_target_are_drawn(spark):
    rng = random.Random(6)
    near, other = [sentence(rng, 60) for _ in range(30)], [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) for _ in range(170)]
    docs = spark.createDataFrame(list(enumerate(near + other)), "doc_id long, text string")
    got = importance.resample(docs, target(spark, near))
    assert got.where("rank <= 50 AND doc_id < 30").count() >= 24


def test_ranks_cross_ranges(spark):
    data = [(i, 30, 59, 0, (i * 7919) % 11) for i in range(500)] + [(900, 3, 5, 0, 99)]
    got = importance.ranked(spark.createDataFrame(data, "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)).collect()
    order = sorted((r for r in data if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == {r[0]: n + 1 for n, r in enumerate(order[:125])}
    assert table(spark).count() and len(got) == 501
