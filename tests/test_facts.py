from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperloom.operators import facts, folders, reports
from paperloom.sources import decoding, profiles

TEXT = "Исковое заявление о взыскании задолженности по договору займа подано истцом в районный суд города Твери"


def test_bytes_of_every_code_page(spark):
    rows = [(i, TEXT.encode(page)) for i, page in enumerate(("utf-8", "utf-8-sig", "cp1251", "koi8-r", "cp866", "iso8859-5"))] + [(9, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id int, content binary")
    got = {r["id"]: (r["encoding"], r["text"]) for r in decoding.decode_bytes(df, "content").collect()}
    assert got == {0: ("utf-8", TEXT), 1: ("utf-8", TEXT), 2: ("cp1251", TEXT), 3: ("koi8-r", TEXT), 4: ("cp866", TEXT), 5: ("iso8859-5", TEXT), 9: (None, None)}


def test_mojibake_is_fixed_only_where_it_is_certain(spark):
    wrong = TEXT.encode("utf-8").decode("cp1251", "ignore")
    latin = TEXT.encode("utf-8").decode("latin-1")
    df = spark.createDataFrame([(1, TEXT), (2, latin), (3, None), (4, "plain words")], "id int, text string")
    got = {r["id"]: (r["text"], r["fixed"]) for r in decoding.fix_mojibake(df, "text").collect()}
    assert got == {1: (TEXT, False), 2: (TEXT, True), 3: (None, False), 4: ("plain words", False)}
    assert wrong != TEXT


def test_composed_form(spark):
    df = spark.createDataFrame([("й",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(decoding.nfc(F.col("t"))).collect()] == ["й", "abc", None]


def test_runs_that_are_documents(spark):
    pages = [("a", i, i, "текст" if i < 3 else "", "Иск" if i == 1 else None, False) for i in range(1, 5)]
    pages += [("b", i, 5600 + i, "", None, True) for i in range(1, 5)]
    pages += [("c", i, i, "", None, False) for i in range(1, 4)] + [("d", i, i, "", None, False) for i in range(1, 3)]
    df = spark.createDataFrame(pages, "run string, page int, number int, text string, kind string, camera boolean")
    got = {r["run"]: r["is_document"] for r in facts.runs_of_documents(df, "run", "text", "kind", "page", "number", "camera").collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_files_of_folders_fall_back_to_descendants(spark):
    df = spark.createDataFrame([("r/a/1",), ("r/a/b/2",), ("r/c/d/3",)], "path string")
    got = {(r["folder"], r["path"]) for r in folders.files_of_folders(df, "path").collect()}
    assert {p for f, p in got if f == "r/a"} == {"r/a/1"}
    assert {p for f, p in got if f == "r/c"} == {"r/c/d/3"}
    assert {p for f, p in got if f == "r"} == {"r/a/1", "r/a/b/2", "r/c/d/3"}


def test_grounding_and_gaps(spark):
    texts = spark.createDataFrame([(1, "Договор № 17 от ООО «Лютик»"), (2, "нет")], "doc_id int, text string")
    said = spark.createDataFrame(
        [(1, 'x {"org": {"value": "лютик", "evidence": ""}, "num": {"value": "18", "evidence": "Договор № 18"}} y'), (2, "no json {")], "doc_id int, raw string"
    )
    found = facts.ground(said, texts, "doc_id", ["org", "num"])
    assert {(r["doc_id"], r["kind"], r["supported"]) for r in found.collect()} == {(1, "org", True), (1, "num", False)}
    empty = spark.createDataFrame([(1, None), (2, None)], f"doc_id int, org {facts.FACT}")
    filled = {r["doc_id"]: r["org"] and r["org"]["value"] for r in facts.fill_gaps(empty, found, "doc_id", "org").collect()}
    assert filled == {1: "лютик", 2: None}


def test_addresses_tags_and_archives(spark):
    df = spark.createDataFrame([('"Анна П." <anna@x.ru>',), ("ivan.petrov@x.ru",)], "a string")
    assert [r[0] for r in df.select(profiles.display_name(F.col("a"))).collect()] == ["Анна П.", "ivan petrov"]
    entries = spark.createDataFrame([(1, ".jpg", 10_000_000, 10), (2, ".txt", 10, 10)], "archive_id int, ext string, size long, csize long")
    got = {r["archive_id"]: (r["suspicious"], r["holds_scans"]) for r in reports.archive_profile(entries, "archive_id", "ext", "size", "csize").collect()}
    assert got == {1: (True, True), 2: (False, False)}


def test_marks_and_declared_pages(spark):
    rows = [
        (0, b"\xff\xfe" + TEXT.encode("utf-16-le"), None), (1, b"\xfe\xff" + TEXT.encode("utf-16-be"), "cp1251"), (2, b"\xff\xfe\x00\x00" + TEXT.encode("utf-32-le"), None),
        (3, TEXT.encode("cp1251"), "Windows-1251"), (4, TEXT.encode("koi8-r"), "no such page"), (5, TEXT.encode("utf-8"), "koi8_r"), (6, b"\xff\xfe" + b"abc", None), (7, b"", "cp1251"), (8, None, "cp866"),
    ]
    df = spark.createDataFrame(rows, "id long, content binary, declared string")
    got = {r["id"]: (r["encoding"], r["text"]) for r in decoding.decode_bytes(df, "content", declared="declared").collect()}
    assert {i: got[i] for i in range(6)} == {0: ("utf-16", TEXT), 1: ("utf-16", TEXT), 2: ("utf-32", TEXT), 3: ("windows-1251", TEXT), 4: ("koi8-r", TEXT), 5: ("utf-8", TEXT)}
    assert got[6][0] in decoding.CODE_PAGES and got[6][1].endswith("abc")
    assert got[7][1] == "" and got[8] == (None, None)


def test_labels_and_dates_of_answers(spark):
    text = "ПОСТАНОВЛЕНИЕ\nо возбуждении исполнительного производства\n27 июля 2026 г.\nСудебный пристав-исполнитель. Должник: Иванов Иван Иванович"
    said = [
        ("kind", "Постановление судебного пристава", "ПОСТАНОВЛЕНИЕ", True), ("kind", "Приговор суда присяжных", "ПОСТАНОВЛЕНИЕ", False), ("kind", "Bailiff order", "order", False),
        ("kind", "Постановление", "", False), ("day", "2026-07-27", "27 июля 2026", True), ("day", "2020-01-01", "01.01.2020", False), ("day", "27.07.2026", "", False),
        ("who", "иванов, иван  ИВАНОВИЧ", "", True), ("who", "Сидоров Сидор", "Сидоров Сидор", False), ("who", "Иванов", "должник иванов", True),
    ]
    answers = spark.createDataFrame([(i, json.dumps({k: {"value": v, "evidence": e}}, ensure_ascii=False)) for i, (k, v, e, _) in enumerate(said)], "id int, raw string")
    texts = answers.select("id", F.lit(text).alias("text"))
    got = {r["id"]: r["supported"] for r in facts.ground(answers, texts, "id", ["kind", "day", "who"], labels=("kind",), dates=("day",)).collect()}
    assert got == {i: ok for i, (*_, ok) in enumerate(said)}


def test_content_that_is_computed_is_made_once_a_reading(spark):
    rows = [(0, TEXT.encode()), (1, b"\xff\xfe" + TEXT.encode("utf-16-le")), (2, TEXT.encode("cp1251")), (2, TEXT.encode("cp1251")), (3, b"\xff\xfe" + b"abc"), (4, None)]
    made = spark.createDataFrame([(i, bytearray(b[::-1]) if b is not None else None) for i, b in rows], "id int, turned binary")
    found = decoding.decode_bytes(made.select("id", F.unhex(F.regexp_replace(F.reverse(F.hex("turned")), "(.)(.)", "$2$1")).alias("content")), "content")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") <= 2  # once for what is read at once, once for what is tried
    got = sorted((r["id"], r["encoding"]) for r in found.collect())
    assert [g[0] for g in got] == [0, 1, 2, 2, 3, 4] and [g[1] for g in got[:4]] == ["utf-8", "utf-16", "cp1251", "cp1251"] and got[5][1] is None


def test_only_texts_that_lack_a_value_lose_their_punctuation(spark):
    """Punctuation was taken out of every text before it was joined."""
    texts = [(1, "Договор № 7-А, Ёлкин И. И."), (2, "Договор № 7-А"), (3, None), (4, "ИНН 77-01"), (5, "суд"), (6, "...")]
    said = {1: ("ЕЛКИН и. и.", ""), 2: ("7А", ""), 3: ("7", ""), 4: ("77 02", "инн 7701"), 5: ("-", ""), 6: (".", "")}
    answers = [(i, json.dumps({"n": {"value": v, "evidence": e}, "k": {"value": "суд" if i == 5 else "договор", "evidence": "договор"}}, ensure_ascii=False)) for i, (v, e) in said.items()]
    a, t = spark.createDataFrame(answers, "id int, raw string").repartition(2), spark.createDataFrame(texts, "id int, text string").repartition(2)
    told = facts.ground(a, t, "id", ["n", "k"])
    got = {(r["id"], r["kind"]): r["supported"] for r in told.collect()}
    assert got == {(i, "n"): i in (1, 2) for i in said} | {(i, "k"): i in (1, 2, 5) for i in said}
    assert {(r["id"], r["kind"]): r["supported"] for r in facts.ground(a, t, "id", ["n", "k"], labels=("k",)).collect()} == got | {(5, "k"): False}
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert r"[^\p{L}\p{N}]" in plan and r"[^\p{L}\p{N}]" not in plan[plan.index("Join ") :]


def test_grounding_broadcasts_no_texts(spark):
    rows = spark.range(100_000)  # expected to be small, whatever the texts are made of
    texts = rows.select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("Договор от 05.03.2021 № "), F.col("id").cast("string")), 3).alias("text"))
    said = rows.select(F.col("id").alias("doc_id"), F.lit('{"num": {"value": "17", "evidence": ""}, "day": {"value": "2021-03-05", "evidence": ""}}').alias("raw"))
    for found in (facts.ground(said, texts, "doc_id", ["num"]), facts.ground(said, texts, "doc_id", ["num", "day"], dates=("day",))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
