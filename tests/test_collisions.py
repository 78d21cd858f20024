"""Targets of a folder against the sequential rule, and many namesakes."""

from __future__ import annotations

import random
import time

import pytest

from paperloom.operators import planning


def in_order(rows, held):
    """The rule, row by row: the first form of a name that no other existing name and no earlier target has."""
    out, taken = {}, {}
    for folder, own, name, turn in sorted(rows, key=lambda r: r[3]):
        used = taken.setdefault(folder, set())
        others = {h.lower() for d, h in held if d == folder} - {own.lower()}
        k, target = 1, name
        while target.lower() in others | used:
            k += 1
            stem, dot, ext = name.rpartition(".")
            target = f"{stem}_{k:02d}.{ext}" if dot and stem else f"{name}_{k:02d}"
        used.add(target.lower())
        out[folder, turn] = target
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    stems = ["x", "X", "x_02", "x_02_02", "x_03", "y", "y_10", "z_2", ".a", "b.c", "b.c_02", "x_100"]
    rows, held = [], []
    for d in range(12):
        own = list(dict.fromkeys(rng.choice(["s", "x", "y", "x_02", "b.c", "z"]) + rng.choice(["", "_02", "_03", "_05"]) + rng.choice([".pdf", "", ".PDF"]) for _ in range(14)))
        own = [o for i, o in enumerate(own) if o.lower() not in {p.lower() for p in own[:i]}]
        held += [(f"d{d}", o) for o in own]
        rows += [(f"d{d}", o, rng.choice(stems) + rng.choice([".pdf", ".pdf", ""]), d * 100 + i) for i, o in enumerate(own) if rng.random() < 0.8]
    rng.shuffle(rows)
    plan = spark.createDataFrame(rows, "dir string, name string, proposed string, ord int").repartition(3)
    got = planning.resolve_collisions(plan, spark.createDataFrame(held, "dir string, name string")).collect()
    assert {(r["dir"], r["ord"]): r["target"] for r in got} == in_order(rows, held) and len(got) == len(rows)


def test_many_namesakes_with_one_name_that_is_there(spark):
    n = 200_000
    plan = spark.range(n).selectExpr("'d' AS dir", "concat('s', id, '.pdf') AS name", "'Акт.pdf' AS proposed", "id AS ord")
    plan = plan.selectExpr("dir", "CASE WHEN ord = 7 THEN 'акт_09.pdf' ELSE name END AS name", "proposed", "ord")
    began = time.time()
    found = planning.resolve_collisions(plan, plan.select("dir", "name")).cache()
    assert found.selectExpr("count(DISTINCT lower(target)) AS n").first()["n"] == n
    assert time.time() - began < 60
    rows = {r["ord"]: r["target"] for r in found.where("ord IN (0, 6, 7, 8, 199999)").collect()}
    assert rows == {0: "Акт.pdf", 6: "Акт_07.pdf", 7: "Акт_08.pdf", 8: "Акт_10.pdf", 199999: "Акт_200001.pdf"}
