from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import matching, quality
from paperloom.operators import extract, naming, planning, series
from paperloom.plans import streams
from paperloom.sources import files


def values(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("text", "date"),
    [
        ("от 18 августа 2026 года", "2026-08-18"), ("«18» августа 2026 г.", "2026-08-18"), ("18.08.2026", "2026-08-18"), ("18/08/2026", "2026-08-18"),
        ("2026-08-18", "2026-08-18"), ("3 сент. 2025", "2025-09-03"), ("31.02.2026", None), ("18.08.1850", None), ("18.08.26", None),
    ],
)
def test_date_forms(spark, text, date):
    found = extract.pick_date(extract.extract_dates(values(spark, [(1, text)]), ["id"]), ["id"]).collect()
    assert [r["value"] for r in found] == ([date] if date else [])


def test_date_roles_and_two_digit_years(spark):
    text = "Справка. Дата рождения 01.02.1970. " + "слово " * 12 + "составлен 05.06.2024, действителен до 11.12.24"
    found = {r["value"]: r["role"] for r in extract.extract_dates(values(spark, [(1, text)]), ["id"]).collect()}
    assert found == {"1970-02-01": "personal_date", "2024-06-05": "document_date", "11.12.24": "ambiguous_year"}
    read = extract.extract_dates(values(spark, [(1, "11.12.24 и 11.12.71")]), ["id"], two_digit_years=True)
    assert {r["value"] for r in read.collect()} == {"2024-12-11", "1971-12-11"}


def test_matches_find_positions_in_any_script(spark):
    texts = ["", "x", "дело № 5 и № 6", "\U0001f600 № 7", "№1№2" * 200]
    df = values(spark, list(enumerate(texts))).select("id", "text", matching.matches(F.col("text"), r"№\s*\d").alias("m"))
    import re

    for r in df.collect():
        assert [(m["start"], m["value"]) for m in r["m"]] == [(m.start(), m[0]) for m in re.finditer(r"№\s*\d", r["text"])]


@pytest.mark.parametrize(("value", "valid"), [("7707083893", True), ("7707083894", False), ("500100732259", True), ("500100732258", False), ("12345", False)])
def test_tax_id_checksums(spark, value, valid):
    assert values(spark, [(1, value)]).select(extract.valid_inn(F.col("text"))).first()[0] is valid


def test_registration_checksums(spark):
    df = values(spark, [(1, "1027700132195"), (2, "1027700132196"), (3, "304500116000157"), (4, "30450011600015x")])
    assert [r[0] for r in df.orderBy("id").select(extract.valid_ogrn(F.col("text"))).collect()] == [True, False, True, False]


def test_identifier_kinds(spark):
    text = "Исполнительное производство 652102/26/77028-ИП, дело А40-123456/2026, договор займа № 17, № 25.11.2024, КПП 770701001"
    found = {(r["kind"], r["value"]) for r in extract.extract_identifiers(values(spark, [(1, text)]), ["id"]).collect()}
    assert found == {("enforcement_number", "652102/26/77028-ИП"), ("case_number", "А40-123456/2026"), ("contract_number", "17"), ("kpp", "770701001")}


def test_amounts_largest_first(spark):
    text = "154 300,50 руб. и 1 000 000 рублей, 25 коп., 300 USD"
    found = extract.extract_amounts(values(spark, [(1, text)]), ["id"]).orderBy("rank").collect()
    assert [(float(r["amount"]), r["currency"]) for r in found] == [(1000000.0, "RUB"), (154300.5, "RUB"), (300.0, "USD")]


def test_person_forms_are_one_person(spark):
    text = "Должник: Иванов Иван Иванович. Судья Петрова А. С. отказала Иванову И. И. в иске."
    people = extract.extract_persons(values(spark, [(1, text)]), ["id"]).collect()
    assert {(r["value"], r["role"]) for r in people} == {("Иванов Иван Иванович", "debtor"), ("Петрова А. С.", "judge")}
    chosen = extract.pick_persons(extract.extract_persons(values(spark, [(1, text)]), ["id"]), ["id"]).collect()
    assert [r["value"] for r in chosen] == ["Иванов Иван Иванович"]


def test_organizations_and_their_choice(spark):
    text = "Арбитражный суд г. Москвы, ООО «Ромашка», общество с ограниченной ответственностью «Лютик», отдел судебных приставов"
    found = extract.extract_organizations(values(spark, [(1, text)]), ["id"])
    names = {r["value"] for r in found.collect()}
    assert {'ООО "Ромашка"', 'ООО "Лютик"'} <= names
    assert sum(r["role"] in ("court", "authority") for r in extract.pick_organizations(found, ["id"], 3).collect()) <= 1


def test_quality_of_right_and_wrong_decoding(spark):
    good = "Исковое заявление о взыскании задолженности по договору займа подано истцом в районный суд города"
    bad = good.encode("cp1251").decode("koi8-r")
    rows = {r["id"]: r for r in quality.with_quality(values(spark, [(1, good), (2, bad), (3, None), (4, "�" * 40)])).collect()}
    assert rows[1]["score"] > 0.95 and rows[1]["statuses"] == []
    assert rows[2]["score"] < 0.7 and "MOJIBAKE_SUSPECTED" in rows[2]["statuses"]
    assert rows[3]["score"] == 0 and "ENCODING_UNCERTAIN" in rows[4]["statuses"]


def test_quality_sees_the_whole_text_unless_sampled(spark):
    df = values(spark, [(1, "a" * 20_000 + "\ufffd" * 20_000 + "я" * 90_000)])
    whole, part = quality.with_quality(df).first(), quality.with_quality(df, sample=quality.SAMPLE).first()
    assert "ENCODING_UNCERTAIN" in whole["statuses"] and whole["score"] < 0.1
    assert part["statuses"] == [] and part["score"] == 1
    assert df.select(quality.language_hint(F.col("text")), quality.language_hint(F.col("text"), quality.SAMPLE)).first()[:] == ("ru", "en")


def test_series_and_pages(spark):
    names = ["Дело том 1", "Дело том 2", "Дело_3", "отчёт (1)", "1", "2", "IMG_5608", "IMG_5609", "IMG_5612", "IMG_5620", "01 скан", "02 скан"]
    df = spark.createDataFrame([(i, "d", n, ".jpg") for i, n in enumerate(names)], "ord long, dir string, stem string, ext string")
    found = {r["stem"]: (r["part"], r["total"], r["series_label"]) for r in series.detect_series(df).collect()}
    assert found["Дело том 1"] == (1, 3, "том") and found["Дело_3"] == (3, 3, "том") and "отчёт (1)" not in found
    pages = {r["stem"]: (r["page"], r["total"], r["position"]) for r in series.page_runs(df, ["dir", "ext"]).collect()}
    assert pages["IMG_5612"] == (3, 3, "tail") and "IMG_5620" not in pages
    assert pages["01 скан"] == (1, 2, "head") and pages["2"] == (2, 2, "head")


def test_collisions_in_every_kind_of_folder(spark):
    plan = [
        ("a", "s1.pdf", "Акт.pdf", 1), ("a", "s2.pdf", "АКТ.pdf", 2), ("a", "s3.pdf", "акт.pdf", 3),
        ("b", "s1.pdf", "x.pdf", 1), ("b", "s2.pdf", "x_02.pdf", 2), ("b", "s3.pdf", "x.pdf", 3),
        ("c", "y.pdf", "y.pdf", 1), ("c", "s2.pdf", "Y.pdf", 2),
        ("d", "s1.pdf", "z.pdf", 1), ("d", "s2.pdf", "z.pdf", 2),
    ]
    df = spark.createDataFrame(plan, "dir string, name string, proposed string, ord int").repartition(3)
    held = df.select("dir", "name").unionByName(spark.createDataFrame([("d", "z.pdf"), ("d", "Z_02.PDF")], "dir string, name string"))
    got = {(r["dir"], r["ord"]): r["target"] for r in planning.resolve_collisions(df, held).collect()}
    assert [got["a", i] for i in (1, 2, 3)] == ["Акт.pdf", "АКТ_02.pdf", "акт_03.pdf"]
    assert [got["b", i] for i in (1, 2, 3)] == ["x.pdf", "x_02.pdf", "x_03.pdf"]
    assert [got["c", i] for i in (1, 2)] == ["y.pdf", "Y_02.pdf"]
    assert [got["d", i] for i in (1, 2)] == ["z_03.pdf", "z_04.pdf"]
    for folder in "abcd":
        own = [t.lower() for (d, _), t in got.items() if d == folder]
        assert len(own) == len(set(own))


def test_segments_are_reviewed_and_names_fit(spark):
    segments = [("Договор", "type", 1), ("27.07.2026", "type", 2), ("7", "type", 2), ("договор", "subject", 3), ("слово " * 60, "subject", 4), ("01.02.2024", "date", 5)]
    df = spark.createDataFrame([(segments,)], "s array<struct<text:string,kind:string,priority:int>>")
    row = df.select(naming.review_segments(F.col("s")).alias("r"), naming.assemble(F.col("s"), F.lit(".pdf"), 60).alias("name")).first()
    assert [x["issue"] for x in row["r"]] == ["", "date_outside_date", "bare_number", "duplicate", "", ""]
    assert len(row["name"]) <= 60 and row["name"].endswith(".pdf") and row["name"].startswith("Договор")


def test_types_by_bytes(spark):
    rows = [(b"%PDF-1.7", ".txt", "pdf", True), (b"plain text", ".md", "md", False), (b"\x00\x01", ".xyz", "xyz", False), (b"", ".pdf", "", False), (b"<!DOCTYPE html><p>", ".htm", "html", False), (b"\xff\xd8\xff\xe0", ".jpeg", "jpg", False)]
    df = spark.createDataFrame([(i, c, e) for i, (c, e, *_) in enumerate(rows)], "id int, content binary, ext string")
    t = files.detect_type(F.col("content"), F.col("ext"))
    told = df.withColumn("t", t).select("id", "t.kind", files.extension_mismatch(F.col("t.kind"), F.col("t.method"), F.col("ext")).alias("m"))
    assert {r["id"]: (r["kind"], r["m"]) for r in told.collect()} == {i: (k, m) for i, (_, _, k, m) in enumerate(rows)}


def test_daily_report_counts_days_of_any_order_of_files(spark, tmp_path):
    days = [28, 2, 15, 30, 9, 21, 1, 12, 3, 26, 5, 18, 7, 23, 11, 29, 4, 16, 8, 20]  # 20 files, 8 in a batch
    for i, day in enumerate(days):
        rows = [(f"2024-01-{d:02d} 10:00:00", "open", 1.0) for d in (day, days[-1 - i])]
        df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    found = {r["day"]: (r["n"], r["total"]) for r in streams.stream_daily_report(spark, str(tmp_path)).collect()}
    assert found == {f"2024-01-{d:02d}": (2, 2.0) for d in days}


def test_only_texts_that_may_change_are_composed_in_python(spark):
    import re
    import unicodedata

    from paperloom.sources import decoding

    inert = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.match(f"[{decoding.INERT}]", chr(c))]
    second = {parts[-1] for c in range(0x110000) if (parts := unicodedata.decomposition(chr(c)).split()) and len(parts) == 2 and not parts[0].startswith("<")}
    assert len(inert) > 1000 and not second & {f"{ord(c):04X}" for c in inert}
    assert all(unicodedata.combining(c) == 0 and unicodedata.normalize("NFC", c) == c for c in inert)
    rows = ["Договор № 5 – «й»", "é", "й", "Å", "가", "café", None, "", "😀"]
    read = values(spark, list(enumerate(rows))).select("id", "text", decoding.nfc(F.col("text")).alias("new"))
    assert [r["new"] for r in read.orderBy("id").collect()] == [t and unicodedata.normalize("NFC", t) for t in rows]
    assert re.search(r"_composed\(CASE WHEN", read._jdf.queryExecution().optimizedPlan().toString().replace("\n", " "))


def test_quality_counts_odd_characters_in_what_ordinary_ones_leave(spark):
    """Seven patterns went over the whole of every text, whatever it was written in."""
    text = "Plain words,\tand\r\n" + "\x00\x7f\x85" + "�" * 2 + "ÐÑ" + "é中Σ" + "договор ДОМ дОм ё" + "1٣_"
    df = spark.createDataFrame([(1, text), (2, "only plain ASCII"), (3, ""), (4, None)], "id int, text string")
    told = quality.with_quality(df)
    rows = {r["id"]: r for r in told.collect()}
    n, latin, cyrillic, letters = len(text), 13, 14, 13 + 5 + 14
    got = rows[1]
    assert [got[c] for c in ("control_ratio", "replacement_ratio", "mojibake_ratio", "latin_ratio", "cyrillic_ratio")] == [3 / n, 2 / n, 2 / n, latin / n, cyrillic / n]
    assert got["other_script_ratio"] == 5 / letters and got["mixed_case_ratio"] == 1 / 3 and got["russian_word_ratio"] == 1.0
    assert rows[2]["score"] == 1.0 and rows[2]["latin_ratio"] == 14 / 16 and rows[3]["score"] == rows[4]["score"] == 0
    assert "regexp_count(_part" not in told._jdf.queryExecution().analyzed().toString()
