from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import htmlcrf, licenses, pieces, simhash, substrings

from .documents import SCHEMA, rows, sentence, table, words


def fingerprint(text):
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(values):
    """Smallest id reachable over fingerprints within 2 bits, by a plain search; None is the largest id."""
    by = defaultdict(list)
    for ident, fp in values:
        by[fp].append(ident)
    left, out = set(by), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            now = todo.pop()
            seen.append(now)
            near = {x for x in left if bin(x ^ now).count("1") <= 2}
            left -= near
            todo += near
        ids = [i for fp in seen for i in by[fp]]
        for fp in seen:
            out[fp] = min((i for i in ids if i is not None), default=None)
    return out


def test_simhash_equals_its_definition(spark):
    data = rows(n=120)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, n=120)).collect()}
    want = {r[0]: fingerprint(r[1]) for r in data}
    ids = component_ids(want.items())
    for ident, fp in want.items():
        assert got[ident]["fingerprint"] == f"{fp:016x}"
        assert got[ident]["component_id"] == ids[fp]


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_links_connect_all_close_pairs_whatever_is_hot(spark, hot):
    rng = random.Random(hot)
    centres = [rng.getrandbits(64) for _ in range(8)] + [0]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            v = c
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fingerprint long")
    links = simhash.links(df, hot=hot)
    for r in links.collect():
        assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(links).collect()}
    by_root = defaultdict(set)
    for v in values:
        by_root[roots.get(v, ("alone", v))].add(v)
    want = defaultdict(set)
    least = component_ids((v, v) for v in values)
    for v in values:
        want[least[v]].add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_keep_one_leaves_one_row_of_each_component(spark):
    docs = table(spark, n=120).withColumn("fingerprint", F.lit("x"))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = component_ids((r[0], fingerprint(r[1])) for r in rows(n=120))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(ids.values()))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    usual = sorted(map(str, simhash.near_duplicates(docs).collect()))
    assert sorted(map(str, simhash.near_duplicates(docs, hot=2).collect())) == usual  # hot fingerprints dealt out
    odd = spark.createDataFrame([(None, "a b c d", "e", "s", 1), (None, None, "e", "s", 1), (4, "a b c d", "e", "s", 1)], SCHEMA)
    found = {(r["doc_id"], r["fingerprint"] == "0" * 16): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert found == {(None, False): 4, (4, False): 4, (None, True): None}


def test_keep_one_goes_by_component_and_not_by_id(spark):
    texts = ["a b c d e", "completely other words stand here", "nothing in common with those"]
    unnamed = spark.createDataFrame([(None, t, "e", "s", 1) for t in [*texts, texts[0]]], SCHEMA)
    assert sorted(r["text"] for r in simhash.keep_one(unnamed).collect()) == sorted(texts)
    shared = spark.createDataFrame([(5, texts[0], "e", "s", 1), (5, texts[1], "e", "s", 1), (7, texts[1], "e", "s", 1)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(shared).collect()) == sorted((5, t) for t in texts[:2])


def without_repeats(data, width):
    starts = defaultdict(set)
    for ident, text in data:
        own = words(text)
        for i in range(len(own) - width + 1):
            starts[tuple(own[i : i + width])].add(float("inf") if ident is None else ident)
    out = []
    for ident, text in data:
        own, gone = words(text), set()
        for i in range(len(own) - width + 1):
            if min(starts[tuple(own[i : i + width])]) < (float("inf") if ident is None else ident):
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((ident, len(own), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 3, 50])
def test_substrings_equal_their_definition(spark, width):
    data = [(r[0], r[1]) for r in rows(n=80)] + [(None, rows()[0][1]), (3, "x y z " * 40), (3, rows()[7][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("bucket", F.lit(1)).repartition(5)
    got = substrings.without_repeats(docs, width=width)
    assert sorted((tuple(r) for r in got.collect()), key=str) == without_repeats(data, width)


def test_a_window_in_every_document_is_combined_before_it_moves(spark):
    rng = random.Random(6)
    common = sentence(rng, 60)
    data = [(i, f"{sentence(rng, 20)} {common} {sentence(rng, 20)}") for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = without_repeats(data, 50)
    for most in (1, 700, substrings.PACK_WINDOWS):
        got = substrings.without_repeats(docs, most=most).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    dealt = docs.repartition(1).mapInArrow(substrings._emitter(50, 512, substrings.PACK_WINDOWS), substrings.DEALT).toPandas()
    hashes = dealt.loc[~dealt["repeated"], "hashes"].map(len).sum() // 6
    split = [words(t) for _, t in data]
    assert hashes == len({tuple(w[i : i + 50]) for w in split for i in range(len(w) - 49)})  # each different window once


def test_substrings_take_an_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crf_extracts_held_out_pages():
    chain = htmlcrf.trained()
    wrong = total = 0
    for page, main in htmlcrf.labelled_pages(60, seed=991):
        features, labels = htmlcrf.labelled(page, main)
        assert sum(labels) == len(main)
        wrong += sum(a != b for a, b in zip(chain.decode(chain.scores(features)), labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_crf_marginals_are_the_gradient_of_the_partition():
    rng = __import__("numpy").random.default_rng(1)
    scores, steps = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    one, _ = htmlcrf._expected(scores, steps)
    weight = {}
    for code in range(16):
        path = [code >> i & 1 for i in range(4)]
        weight[tuple(path)] = sum(scores[i, p] for i, p in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))
    total = sum(2.718281828459045**w for w in weight.values())
    for i in range(4):
        want = sum(2.718281828459045**w for p, w in weight.items() if p[i]) / total
        assert one[i, 1] == pytest.approx(want)
    chain = htmlcrf.Chain({}, None, steps)
    assert chain.decode(scores) == list(max(weight, key=weight.get))


def test_pages_of_odd_kinds(spark):
    pages = [
        (1, "u", None),
        (2, "u", ""),
        (3, "u", "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>A&amp;B\n title.</h1><p><b>One<br><p>Two &eacute;.</article><div class='ad'>Buy it now.</div><footer>&copy; x</footer>"),
        (4, "u", "<p>unclosed <script>var a = '<p>no</p>'"),
        (5, "u", "<article>" + "<p>word one two.</p>" * 3000 + "</article>"),
        (None, None, "<!-- only a comment"),
        (6, "u", "<article><p>One sentence stands here. <video src='v'>no video</p><p>Two <math><mi>x</mi></math> <svg><text>no</text></svg>ends here.</p><div><select><option>no</div><p>Three stays too.</p></article>"),
    ]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in htmlcrf.extract(docs).collect()}
    assert got[1]["text"] == got[2]["text"] == got[None]["text"] == ""
    assert got[3]["text"] == "A&B title. One Two é."
    assert got[3]["n_chars"] == len(got[3]["text"])
    assert got[6]["text"] == "One sentence stands here. Two x ends here. Three stays too."
    assert got[5]["text"] == " ".join(["word one two."] * 3000)
    assert htmlcrf.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licences_equal_their_definition(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.",
        2: "x MIT-License y mit license, GNU general PUBLIC licenSe cc by",
        3: None,
        4: "nothing here, mit dem Rad",
        5: "This work is licensed under the GNU General Public License, version 3.",
        6: "Licensed under CC BY-NC-SA 4.0. Apacheé License",
        7: "permission is hereby granted, free of charge, to any person obtaining a duplicate",
        8: "under the apache license " * 500,
    }
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").withColumn("score", F.lit(3))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for ident, text in texts.items():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, v) for p, v in licenses.PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        r = got[ident]
        assert (r["n_words"], r["n_base"]) == (len(own), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[1]["labels"] == "apache,apache-notice" and got[5]["labels"] == "gpl,gpl-notice"
    assert got[6]["labels"] == "cc-by,cc-by-notice" and got[7]["labels"] == "" and 0 < got[7]["score"] < 0.5
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licence_scores_need_no_anchor(spark):
    texts = [
        "Redistribution and use in source with or without modification",  # five words in order
        "permission is granted",  # two words
        "copyright holders keep all",
        "you may copy this under the moon",
        "released 7 acme 9",  # optional and replaceable words only
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in licenses.scan(docs).collect()}
    templates = licenses.automata()
    assert got == {i: licenses.accepted(licenses.WORD.findall(t.lower()), templates)[1] / 2 for i, t in enumerate(texts)}
    assert [got[i] > 0 for i in range(5)] == [True, True, True, True, False]


def parsed(template):
    """A template as nested lists: words, ("opt", [...]) and ("var", pattern, most)."""
    stack = [[]]
    for mark in re.findall(r"<<[^>]*>>|[^<]+", template):
        if mark == "<<beginOptional>>":
            stack.append([])
        elif mark == "<<endOptional>>":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif mark.startswith("<<var"):
            given = dict(x.split("=", 1) for x in mark[2:-2].split(";")[1:])
            stack[-1].append(("var", re.compile(given["match"]), int(given["most"])))
        else:
            stack[-1] += licenses.WORD.findall(mark.lower())
    return stack[0]


def reach(items, words, at, met, best):
    """Every (place, mandatory words met) after `items` from a place, by backtracking; `best` notes the most met anywhere."""
    best[0] = max(best[0], met if met >= 0 else 0)
    if not items:
        yield at, met
        return
    head, rest = items[0], items[1:]
    if isinstance(head, str):
        if at < len(words) and words[at] == head:
            yield from reach(rest, words, at + 1, met + 1, best)
    elif head[0] == "opt":
        yield from reach(rest, words, at, met, best)
        for after, _ in reach(head[1], words, at, -10**6, best):
            yield from reach(rest, words, after, met, best)
    else:
        for n in range(1, head[2] + 1):
            if at + n > len(words) or not head[1].fullmatch(words[at + n - 1]):
                break
            yield from reach(rest, words, at + n, met, best)


def mandatory(items):
    return sum(isinstance(x, str) for x in items)


def filled(rng, items):
    out = []
    for x in items:
        if isinstance(x, str):
            out.append(x)
        elif x[0] == "opt":
            out += filled(rng, x[1]) if rng.random() < 0.5 else []
        else:
            out += [rng.choice(["7", "9"]) if "0-9" in x[1].pattern else rng.choice(["acme", "authors"]) for _ in range(rng.randint(1, x[2]))]
    return out


def test_licences_equal_a_backtracking_matcher(spark):
    rng = random.Random(12)
    templates = {label: parsed(t) for label, t in licenses.TEMPLATES.items()}
    texts = []
    for items in templates.values():
        for i in range(6):
            own = filled(rng, items)
            if i % 2:  # one word lost, changed or put in between
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [] if i == 3 and len(own) > 1 else ["zebra"]
            texts.append(" ".join(["so", "under"] * rng.randint(0, 2) + own + ["end"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = 0
    for r in licenses.scan(docs).collect():
        words_ = licenses.WORD.findall(texts[r["doc_id"]])
        labels, share = set(), 0.0
        for label, items in templates.items():
            best = [0]
            for at in range(len(words_)):
                if any(True for _ in reach(items, words_, at, 0, best)):
                    labels.add(label)
            share = max(share, best[0] / mandatory(items))
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == labels | base, texts[r["doc_id"]]
        assert r["score"] == (1.0 if labels else pytest.approx(max(share / 2, 0.5 if base else 0.0)))
        whole += any(x.endswith(("-text", "-header")) for x in labels)
    assert whole >= 15
    lost = texts[6 * list(templates).index("mit-text")].replace("as is", "")
    assert "mit-text" not in licenses.scan(spark.createDataFrame([(1, lost)], "doc_id long, text string")).first()["labels"]


def test_template_regions():
    auto = licenses.compiled("t", "a <<beginOptional>>b c<<endOptional>> d <<var;match=[0-9]+;most=2>> e")

    def fits(text):
        states = auto.closure({0})
        for w in text.split():
            moved = set()
            for s in states:
                moved |= auto.steps[s].get(w, set())
                moved.update(g for test, g in auto.tests[s] if test.fullmatch(w))
            states = auto.closure(moved)
        return auto.end in states

    assert fits("a d 1 e") and fits("a b c d 1 2 e")
    assert not fits("a b d 1 e") and not fits("a d e") and not fits("a d 1 2 3 e") and not fits("a d x e")


def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    pool = "abcdefgh the ing  \n\té漢Ж😀.,'\"-_0123▁\x00"
    texts = [r[1] for r in rows()] + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["", " ", " " * 50, "a" * 900, sentence(rng, 4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0)).repartition(3)
    encoded = pieces.encode(docs)
    for r in pieces.decode(encoded, out="back").collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text)
        assert r["back"] == library.decode(r["ids"])
        assert r["n_pieces"] == len(r["ids"])
        assert r["round_trip"] == (r["back"] == text)
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deeply_nested_pages_take_no_longer_a_byte():
    import time

    deep = 100_000
    page = "".join(f'<div class="w{i % 10} v{i}">t{i} ' for i in range(deep))
    began = time.time()
    blocks = htmlcrf.blocks_of(page, frozenset({"w", "v"}))
    assert len(blocks) == deep and blocks[-1][1].words == {"w", "v"} and blocks[-1][1].tags == {"div"} and blocks[-1][1].own == "div"
    assert len(htmlcrf.blocks_of("<div>" * 50_000 + "</span> x <p>y" * 20_000)) == 20_001
    assert len(htmlcrf.features_of(blocks)) == deep and time.time() - began < 30


def test_open_elements_end_where_they_should():
    told = lambda page: [(text, sorted(place.tags), place.own, linked) for text, place, linked in htmlcrf.blocks_of(page)]
    assert told("a<p>b<div>c</div>d") == [("a", [], None, 0), ("b", ["p"], "p", 0), ("c", ["div"], "div", 0), ("d", [], None, 0)]
    assert told("<ul><li>a<li>b</ul>c") == [("a", ["li", "ul"], "li", 0), ("b", ["li", "ul"], "li", 0), ("c", [], None, 0)]
    assert told("<dl><dt>a<dd>b<dt>c") == [(x, sorted(["d" + e, "dl"]), "d" + e, 0) for x, e in (("a", "t"), ("b", "d"), ("c", "t"))]
    assert told("<head>x<title>t</title></head><body><a href=u>link</a> y<svg>z</svg></i>") == [("link y", ["body"], "body", 4)]
