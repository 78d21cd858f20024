"""License scans by template-markup matching.

A template is a notice in which optional regions stand between `<<beginOptional>>` and
`<<endOptional>>` and replaceable ones are `<<var;match=...;most=n>>`: up to n words that each match.
It compiles to an automaton over words. A text is accepted where some run of its words spells all
mandatory wording exactly, with optional regions present or not and replaceable ones filled.

The templates (templates.py) are one-line notices and whole licences with their conditions and disclaimers, so a
licence that lost a condition is not accepted, but scores by the words that are there.

Words are lower-cased (A-Z) runs of 0-9, a-z and all characters beyond ASCII. Besides the templates
there are fixed phrases with labels of their own; `score` is 1 if a template is accepted, otherwise half
of the largest share of a template's mandatory words that was met in order from some word on, or 0.5
if a phrase stands there and no share is larger.

Defined results: null is an empty text; without a place, first_word and last_word are null and labels are empty;
repeated rows get equal results; extra columns are left out; an empty table gives an empty one. Texts of any length
are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value
from .templates import TEMPLATES

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:;[a-z]+=[^;>]+)*)>>|([^<]+)")

ship_by_value(__name__)


@dataclass
class Automaton:
    """States from 0; `steps` has word moves, `tests` moves on words that match, `free` moves without a word."""

    label: str
    steps: list[dict[str, set[int]]] = field(default_factory=list)
    tests: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    met: list[int] = field(default_factory=list)  # mandatory words before each state
    end: int = 0
    firsts: set[str] = field(default_factory=set)  # the first mandatory words: without one of them nothing is met

    def state(self, met: int) -> int:
        self.steps.append({})
        self.tests.append([])
        self.free.append(set())
        self.met.append(met)
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)


def compiled(label: str, template: str) -> Automaton:
    auto = Automaton(label)
    at, met, opened = auto.state(0), 0, []
    for mark, options, words in MARKUP.findall(template):
        if mark == "beginOptional":
            opened.append(at)
        elif mark == "endOptional":
            auto.free[opened.pop()].add(at)
        elif mark == "var":
            given = dict(o.split("=", 1) for o in options.split(";") if o)
            test, goal = re.compile(given["match"]), auto.state(met)
            for i in range(int(given.get("most", "1"))):
                after = auto.state(met)
                auto.tests[at].append((test, after))
                auto.free[after].add(goal)
                at = after
            at = goal
        else:
            for word in WORD.findall(words.lower()):
                met += not opened
                after = auto.state(met)
                auto.steps[at].setdefault(word, set()).add(after)
                at = after
    auto.end = at
    auto.firsts = {w for s, moves in enumerate(auto.steps) if not auto.met[s] for w, after in moves.items() if any(auto.met[t] for t in after)}
    return auto


@lru_cache(maxsize=1)
def automata() -> tuple[list[Automaton], list[frozenset[int]], list[set[str]]]:
    """The automata, their first states and the words that can open them (empty: any word)."""
    made = [compiled(label, template) for label, template in TEMPLATES.items()]
    starts = [a.closure({0}) for a in made]
    openers = [set() if any(a.tests[s] for s in start) else {w for s in start for w in a.steps[s]} for a, start in zip(made, starts)]
    return made, starts, openers


def accepted(words: list[str], templates: tuple) -> tuple[set[str], float]:
    """Labels of the `templates` (see automata) that some run of the words fulfils, and the largest share met."""
    labels, share = set(), 0.0
    made, starts, openers = templates
    known = set(words)
    for auto, first, opening in zip(made, starts, openers):
        if not auto.firsts & known:
            continue
        total = auto.met[auto.end]
        for at in _places(words, opening & known) if opening else range(len(words)):
            states, i = first, at
            while states and i < len(words):
                moved = set()
                for s in states:
                    moved |= auto.steps[s].get(words[i], set())
                    moved.update(goal for test, goal in auto.tests[s] if test.fullmatch(words[i]))
                states = auto.closure(moved)
                i += 1
                if states:
                    share = max(share, max(auto.met[s] for s in states) / total)
                if auto.end in states:
                    labels.add(auto.label)
                    break
            if auto.label in labels:
                break
    return labels, share


def _places(words: list[str], wanted: set[str]) -> Iterator[int]:
    """Where any of the wanted words stands, word by word."""
    for word in sorted(wanted):
        at = -1
        for _ in range(words.count(word)):
            at = words.index(word, at + 1)
            yield at


def places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return out


def _likely() -> str:
    """A pattern that every text with a phrase or a first mandatory word of a template matches."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    firsts = {w for auto in automata()[0] for w in auto.firsts}
    heads = {tuple(p.split()[:2]) for p in PHRASES} | {(w,) for w in firsts}
    return "|".join(gap.join(h) for h in sorted(heads))


RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def _scanner():
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    likely, templates = _likely(), automata()
    inside = "[0-9a-z\u0080-\U0010ffff]+"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            n_words = pc.cast(pc.count_substring_regex(texts, inside), pa.int64())
            n = len(texts)
            base, score = np.zeros(n, np.int64), np.zeros(n)
            first, last = [None] * n, [None] * n
            base_labels, labels = [""] * n, [""] * n
            for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, likely))).tolist():
                words = WORD.findall(texts[i].as_py())
                found = places(words)
                more, share = accepted(words, templates)
                own = {label for _, label in found}
                base[i] = len(found)
                if found:
                    first[i], last[i] = min(found)[0], max(found)[0]
                base_labels[i], labels[i] = ",".join(sorted(own)), ",".join(sorted(own | more))
                score[i] = 1.0 if more else max(share / 2, 0.5 if found else 0.0)
            columns = [batch.column(0), n_words, base, first, last, base_labels, labels, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, kinds)], names=names)

    return scan


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT of each row; rows stay where they are."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scanner(), RESULT)
