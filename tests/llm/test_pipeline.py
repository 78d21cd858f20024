from __future__ import annotations

import random

import corpus_pipeline
from paperloom.llm import queries

from .documents import SCHEMA, table, words


def test_stages_hold_their_contract(spark, tmp_path):
    docs = table(spark, n=80)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{i}_{name}"))
        now = spark.read.parquet(str(tmp_path / f"{i}_{name}"))
        if i < 4:
            assert now.columns == columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, now.collect()))
    assert now.count() > 0


def test_stages_take_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_queries_cover_the_thirteen_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def shingles(text):
    own = words(text)
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_down_to_four_fifths_go(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 400]))]
        texts.append(base)
        for _ in range(6):  # up to so many edited words that likeness falls below 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randint(1, 35) // 1000)):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(copy)
    one = [f"x{i}" for i in range(100)]
    texts += [one[:at] + [f"y{at}"] + one[at + 1 :] for at in range(100)]  # a large group
    data = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    low = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if (alike := likeness(a, sets[j])) >= 0.8:
                low += alike < 0.85
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert low > 30  # links near the limit
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(data)) if top(i) == i]


def test_nearest_pairs_all_become_candidates(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):  # pairs of their own, 0.8 to 0.81 alike
        base = [f"w{rng.randrange(10**6)}" for _ in range(94)]
        data += [(2 * i, " ".join(base), "en", "s", 0), (2 * i + 1, " ".join([*base[:84], *(f"v{rng.randrange(10**6)}" for _ in range(10))]), "en", "s", 0)]
    assert {round(likeness(shingles(data[2 * i][1]), shingles(data[2 * i + 1][1])), 3) for i in range(400)} == {0.8}
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, SCHEMA), "")
    assert kept.count() == 400


def test_no_pair_is_left_to_chance(spark):
    # Pairs at 0.8 that 25 bands of 5 MinHash minima with the seed of before did not bring together.
    data = []
    for i in (74531, 81560, 98507, 146200, 156632, 163820):
        base = " ".join(f"w{i}x{j}" for j in range(12))
        data += [(2 * i, f"{base} a", "en", "s", 0), (2 * i + 1, f"{base} b", "en", "s", 0)]
    assert likeness(shingles(data[0][1]), shingles(data[1][1])) == 0.8
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, SCHEMA), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in data[::2]]
