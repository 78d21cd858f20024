from __future__ import annotations

import random

from pyspark.sql import functions as F

from paperloom.functions.ordering import numbered
from paperloom.operators import extract, planning


def test_numbers_of_one_large_group_and_a_null_group(spark):
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"g{i % 4}", i * 7919 % 4001, i) for i in range(4000)]
    table = spark.createDataFrame(rows, "g string, v long, i long")
    order = [F.col("v").desc(), F.col("i")]
    got = {r["i"]: r["n"] for r in numbered(table, "g", order, "n").collect()}
    assert got == {r["i"]: r["n"] for r in numbered(table, "g", order, "n", -F.shiftright("v", 8)).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, (_, i) in enumerate(sorted((-v, i) for h, v, i in rows if h == g), 1):
            want[i] = n
    assert got == want


def test_numbers_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert numbered(empty, "g", [F.col("v")], "n").collect() == []


def test_order_of_a_session_spreads_over_ranges(spark):
    rows = [(1, "folder", "a"), (1, "folder", "a/b/c"), (1, "file", "z"), (1, "file", "a/b/x"), (1, "folder", "a/b"), (2, "file", "q")]
    table = spark.createDataFrame(rows, "session int, kind string, path string")
    got = {(r["session"], r["path"]): r["turn"] for r in planning.apply_order(table, "session", "kind", "path").collect()}
    assert got == {(1, "a/b/x"): 1, (1, "z"): 2, (1, "a/b/c"): 3, (1, "a/b"): 4, (1, "a"): 5, (2, "q"): 1}


def test_types_do_not_depend_on_how_the_dictionary_is_joined(spark):
    random.seed(5)
    letters = "абвё😀 \n"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    markers = lambda: ["".join(random.choice(letters[:6]) for _ in range(random.randint(0, 4))) for _ in range(3)]
    kinds = spark.createDataFrame([(f"k{i}", markers() + ["аб", "аб", None], i) for i in range(8)], "canonical string, markers array<string>, priority int")
    docs = docs.withColumn("name", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Аб в"), F.col("doc_id").cast("string"))))
    for name in (None, "name"):
        small = sorted(map(str, extract.match_types(docs, ["doc_id"], kinds, filename=name).collect()))
        large = sorted(map(str, extract.match_types(docs, ["doc_id"], kinds, filename=name, broadcast=0).collect()))
        assert small and small == large


def test_type_in_the_file_name_alone(spark):
    docs = spark.createDataFrame([(1, "прочее", "Акт сверки 5.pdf"), (2, "x\n" * 9 + "акт сверки", "Акт сверки.pdf"), (3, "прочее", "акт.pdf"), (4, None, "счёт-фактура.pdf")], "id long, text string, name string")
    kinds = spark.createDataFrame([("Акт", ["акт сверки", "акт"], 5), ("Счёт", ["счёт-фактура"], 5)], "canonical string, markers array<string>, priority int")
    got = {(r["id"], r["canonical"]): (r["hits"], round(r["confidence"], 4)) for r in extract.match_types(docs, ["id"], kinds, filename="name").collect()}
    assert got == {(1, "Акт"): (0, 0.82), (2, "Акт"): (2, 0.91), (4, "Счёт"): (0, 0.82)}


def test_undo_moves_and_joins_records_once(spark):
    """Paths that the inventory has twice gave rows twice; the joins were made a second time, to count."""
    a, b = "ab" * 32, "cd" * 32
    records = [
        ("s", 1, "d/1.pdf", "d/o1.pdf", a), ("s", 2, "d/2.pdf", "d/o2.pdf", a), ("s", 70_000, "d/3.pdf", "d/1.pdf", a), ("s", 3, "d/4.pdf", "e/o4.pdf", "x"), ("s", 4, "d/5.pdf", "d/o5.doc", None),
        (None, 5, "d/6.pdf", "d/6.PDF", a), (None, None, "d/7.pdf", "d/o7.pdf", "A" * 64), ("s", 6, None, "d/o8.pdf", a), ("s", 7, "d/9.pdf", "d/o9.pdf", "q" * 31), ("s", 8, "d/8.pdf", None, b),
    ]
    now = [("d/1.pdf", b), ("d/1.pdf", a), ("d/1.pdf", a), ("d/2.pdf", b), ("d/3.pdf", a), ("d/4.pdf", "x"), ("d/5.pdf", a), ("d/6.pdf", a), ("d/6.PDF", a), ("d/7.pdf", "a" * 64), ("d/8.pdf", b), ("d/9.pdf", "q" * 31 + " "), (None, a)]
    done = spark.createDataFrame(records, "session string, seq long, new_path string, old_path string, sha256 string").repartition(3)
    plan = planning.undo_plan(done, spark.createDataFrame(now, "path string, sha256 string").repartition(2))
    got = {r["new_path"]: (r["undo"], r["turn"], r["sha256"]) for r in plan.collect()}
    want = {"d/1.pdf": "ok", "d/2.pdf": "changed", "d/3.pdf": "occupied", "d/4.pdf": "other_folder", "d/5.pdf": "other_extension", "d/6.pdf": "ok", "d/7.pdf": "changed", None: "missing", "d/9.pdf": "changed", "d/8.pdf": "ok"}
    assert plan.count() == len(records) and {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == {"d/3.pdf": 1, "d/8.pdf": 2, "d/9.pdf": 3, None: 4, "d/5.pdf": 5, "d/4.pdf": 6, "d/2.pdf": 7, "d/1.pdf": 8, "d/6.pdf": 1, "d/7.pdf": 2}
    assert {k: v[2] for k, v in got.items()} == {r[2]: r[4] for r in records}
    assert set(plan.columns) == {"session", "seq", "new_path", "old_path", "sha256", "undo", "turn"}
    optimized = plan.select("session", "seq", "undo", "turn")._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Join ") == 3
