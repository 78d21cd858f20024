"""Small tables with the awkward rows: nulls, empty and long texts, copies, repeated ids, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    out: list[tuple] = []
    for i in range(n):
        text = sentence(rng, rng.choice([1, 3, 8, 60, 120]))
        if i % 7 == 0:
            text = f"{text}\n{passage} {sentence(rng, 5)}"
        if i % 5 == 0 and out:
            text = out[-1][1]  # an exact copy
        if i % 11 == 0 and out and out[-1][1]:
            text = out[-1][1] + " x"
        out.append((i, text, "en", f"s{i % 4}" if i % 9 else None, 0))
    out += [
        (1000, None, None, None, None),
        (1001, "", "en", "s1", 0),
        (1002, " \t\n ", "en", "s1", 0),
        (1003, " ".join(sentence(rng, 6) for _ in range(700)), "en", "s0", 0),
        (1004, "wörd " * 300, "de", "s2", 0),
        (1005, "\U0001f600中文 a\x0bb\x0cc", "zh", "s3", 0),
        (1006, passage, "en", "s0", 0),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in out]


def table(spark, seed: int = 1, n: int = 60):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
