"""The method's own findings of op9: against a second implementation, and recall on planted keys."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paperloom.llm import secrets

WORDS = (
    "user account report final version table handler list cache server client index query parse build token window river "
    "garden winter letter market budget annual meeting summary export import update record folder picture holiday invoice"
).split()
LENGTHS = (20, 32, 64)
PLANTED = ("HEX", "base32", "base62", "base64")


def named(rng: random.Random) -> str:
    """An identifier, slug or path with a digit, as code and addresses hold them; 20 characters or more."""
    form = rng.choice(("camel", "slug", "path", "snake"))
    parts = []
    while len("-".join(parts)) < 20:
        parts.append(rng.choice(WORDS))
    parts.insert(rng.randrange(1, len(parts) + 1), str(rng.choice((2, 3, 10, 2023, 2024, 404))))
    if form == "camel":
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    return {"slug": "-", "path": "/", "snake": "_"}[form].join(parts)


def key(rng: random.Random, encoding: str, length: int) -> str:
    """Characters drawn evenly from the encoding, with a letter and a digit."""
    alphabet = dict(secrets.ENCODINGS)[encoding]
    while True:
        drawn = "".join(rng.choice(alphabet) for _ in range(length))
        if re.search("[A-Za-z]", drawn) and re.search("[0-9]", drawn):
            return drawn


def planted(seed: int, a_kind: int, names: int) -> list[tuple[int, str, str, int]]:
    """(doc_id, text, what, length): one candidate a text, at a place that varies."""
    rng = random.Random(seed)
    held = [(key(rng, e, n), e, n) for e in PLANTED for n in LENGTHS for _ in range(a_kind)]
    held += [(v := named(rng), "name", len(v)) for _ in range(names)]
    rng.shuffle(held)
    return [
        (i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) + f" {v} " + rng.choice(WORDS), what, n)
        for i, (v, what, n) in enumerate(held)
    ]


def found(spark, rows) -> dict[int, list[tuple[int, int]]]:
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scanned = secrets.scan(docs, ["doc_id"]).select(
        "doc_id", F.filter("all_spans", lambda s: s["kind"] == 3).alias("own"), "base_spans"
    )
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["own"]] for r in scanned.collect()}


def second(value: str) -> tuple[int, int, float] | None:
    """(encoding, length, p) of a candidate, written apart from the operator."""
    body = value.rstrip("=")
    number = next((i for i, (_, a) in enumerate(secrets.ENCODINGS) if set(body) <= set(a)), None)
    if number is None:
        return None
    alphabet = secrets.ENCODINGS[number][1]
    k, n = len(alphabet), len(body)
    x = [alphabet.index(c) for c in body]
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((c - n / k) ** 2 / (n / k) for c in Counter(x).values()) + (k - len(set(x))) * n / k
    d = k - 1
    p_chi = tail(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = [a * 2 >= k for a in x]
    ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mu = 2 * ones * (n - ones) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = min(1, 2 * tail(abs((runs - mu) / math.sqrt(var)))) if var > 0 else 2 * tail(8)
    mean = sum(x) / n
    square = sum((a - mean) ** 2 for a in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    p_serial = min(1, 2 * tail(abs((serial / square * n + 1) / math.sqrt(n)))) if square else 2 * tail(8)
    h = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return number, n, min(1.0, math.exp(-h) * (1 + h + h * h / 2))


def test_findings_equal_a_second_implementation(spark):
    rows = planted(5, 12, 150)
    rows += [(len(rows), None, "none", 0), (len(rows) + 1, "", "none", 0), (len(rows) + 2, "A1" * 40, "name", 80)]
    spots = {}
    for doc, text, *_ in rows:
        for m in re.finditer(secrets.CANDIDATE, text or "", re.A):
            told = second(m[0])
            if told:
                spots[doc, m.start(), m.end()] = told
    strata = defaultdict(list)
    for number, n, p in spots.values():
        strata[number * 100 + min(math.floor(2 * math.log2(n)), 24)].append(min(math.floor(-math.log10(max(p, 1e-300)) * 20), 600))
    limits = {}
    for s, bins in strata.items():
        dropped = [b for b in bins if 10 ** (-b / 20) <= secrets.RATE * sum(c >= b for c in bins) / len(bins)]
        keys = (sum(b < 6 for b in bins) + 1) / (1 - 10**-0.3)
        kept = [b for b in bins if keys * (1 - 10 ** (-(b + 1) / 20)) >= (1 - secrets.RATE) * sum(c <= b for c in bins)]
        limits[s] = min(min(dropped, default=601), max(kept, default=-1) + 1)
    want = defaultdict(list)
    hexes = {d: [m.span() for m in re.finditer(secrets.HEX + "|" + secrets.ACCESS, t or "")] for d, t, *_ in rows}
    for (doc, a, b), (number, n, p) in spots.items():
        s = number * 100 + min(math.floor(2 * math.log2(n)), 24)
        if min(math.floor(-math.log10(max(p, 1e-300)) * 20), 600) < limits[s] and all(
            e <= a or b <= f for f, e in hexes[doc]
        ):
            want[doc].append((a, b))
    got = found(spark, rows)
    assert {d: sorted(v) for d, v in got.items()} == {r[0]: sorted(want[r[0]]) for r in rows}
    assert limits and any(want.values())


def test_planted_keys_are_found_and_names_are_not(spark):
    rows = planted(11, 40, 480)
    got = found(spark, rows)
    hits = Counter((what == "name") for doc, _, what, _ in rows if got[doc])
    assert hits[False] >= 0.9 * 480
    assert hits[True] <= 0.05 * 480
    assert all(text[a:b] in text.split() for doc, text, *_ in rows for a, b in got[doc])
