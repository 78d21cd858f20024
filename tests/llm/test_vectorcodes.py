"""Product codes against their definition, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from paperloom.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_definition(data, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error, label_error)} and the digest, for rows with different ids."""
    kept = sorted(r for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]))
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in kept}
    size = len(next(iter(whole.values()))) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(whole[i], p) for i, *_ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return {i: [min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for i, v in whole.items()}

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(whole[i], p) for i in whole if now[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    now = assigned()
    error = {i: sum(d for d, _ in now[i]) for i in whole}
    by_label = {}
    for i, _, label in kept:
        by_label[label] = by_label.get(label, 0) + error[i]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in now[i]), error[i], by_label[label]) for i, _, label in kept}, digest


@pytest.mark.parametrize("seed,n,spread", [(1, 40, 0.1), (2, 300, 0.002), (3, 330, 30.0)])
def test_codes_equal_their_definition(spark, seed, n, spread):
    rng = random.Random(seed)
    data = [(i * 3, [float(np.float32(rng.gauss(0, spread))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(n)]
    data += [(5000, None, 1), (5001, [1.0] * 7 + [None], 1), (5002, [float("nan")] * 8, 2), (5003, [float("inf")] + [0.0] * 7, 2)]
    data += [(6000 + i, data[0][1], 1) for i in range(50)]  # copies of one vector
    rng.shuffle(data)
    got = vectorcodes.compress(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    want, digest = by_definition(data)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {digest} and len(got) == len(want)


def test_hot_labels_and_steps_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    data = [(i, [rng.gauss(0, 0.1) for _ in range(8)], 7 if i % 3 else None) for i in range(120)]
    table = spark.createDataFrame(data, SCHEMA).repartition(2)
    plain = sorted(vectorcodes.compress(table).collect())
    assert sorted(vectorcodes.compress(table, hot=5).collect()) == plain
    rows = np.random.default_rng(1).integers(-50, 50, (700, 4))
    entries = rows[:30]
    code, far = vectorcodes.nearest(rows, entries)
    every = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_odd_vectors_have_defined_results(spark):
    data = [(None, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0, 0.0], 1), (2, [1.0, 2.0, 3.0], 1), (4, [], None), (5, [3e38, -3e38], 9)]
    got = vectorcodes.compress(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 5 and {r["error"] for r in got} == {0}  # each its own entry; equal vectors take the first
    codes = {r["vec_id"]: r["code"] for r in got}
    assert codes[2] == codes[None] != codes[4]
    empty = vectorcodes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_other_columns_and_approximations(spark):
    data = [(i, [i / 7, -i / 5, 0.25, 1.0], i % 2, "x", 1) for i in range(20)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label long, code string, error int")
    assert vectorcodes.compress(table).count() == 20
    ints, width = vectorcodes.integers(table, "vec_id", "embedding", "label")
    books = vectorcodes.train(ints, width)
    told = {r["vec_id"]: r["approximation"] for r in vectorcodes.decode(vectorcodes.encode(ints, books), books).collect()}
    assert all(abs(a - b) < 1 / 1024 for i, v, *_ in data for a, b in zip(told[i], v))
