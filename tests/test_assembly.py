"""Operators of assembly, readers, plans and names on small tables with odd rows."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from paperloom.operators import assembly, extract, naming, planning, series
from paperloom.sources import decoding, files, manifest, readers


def test_copies_of_missing_texts_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a"), (5, "b")], "id int, digest string")
    got = {r["id"]: (r["original_id"], r["n_copies"], r["is_copy"]) for r in files.exact_copies(rows, "digest", "id").collect()}
    assert got == {1: (1, 2, False), 4: (1, 2, True), 2: (2, 2, False), 3: (2, 2, True), 5: (5, 1, False)}


def batches(runs, size, factor=4):
    """File by file: a batch ends where a run ends once it is full, or anywhere at the ceiling."""
    out, batch, held, last = {}, 0, 0, None
    for run, n in runs:
        for _ in range(n):
            if held and ((held >= size and run != last) or held >= size * factor):
                batch, held = batch + 1, 0
            out[run, batch] = out.get((run, batch), 0) + 1
            held, last = held + 1, run
    return out


def test_batches_split_runs_at_the_ceiling_only(spark):
    rng = random.Random(5)
    for size, factor in ((10, 4), (3, 2), (1, 1)):
        roots = {root: [(i, rng.choice([1, 2, 5, 9, 45, 100])) for i in range(30)] for root in ("a", "b")}
        rows = [(root, run, i) for root, runs in roots.items() for run, n in runs for i in range(n)]
        table = spark.createDataFrame(rows, "root string, run int, i int")
        got = series.batch_segments(table, "root", "run", size, factor).collect()
        for root, runs in roots.items():
            assert {(r["run"], r["batch"]): r["n_files"] for r in got if r["root"] == root} == batches(runs, size, factor)
    one = spark.createDataFrame([("a", 1, i) for i in range(100)], "root string, run int, i int")
    assert sorted(r["n_files"] for r in series.batch_segments(one, "root", "run", 10).collect()) == [20, 40, 40]


def test_overrides_meet_their_own_file(spark):
    plan = spark.createDataFrame([("a", "n.pdf", "x.pdf"), ("b", "n.pdf", "y.pdf"), ("b", "m.pdf", "z.pdf"), ("b", "k.pdf", "w.pdf")], "dir string, name string, target string")
    chosen = spark.createDataFrame([("b", "n.pdf", "new.pdf"), ("b", "m.pdf", "NEW.pdf"), ("b", "k.pdf", "k.doc")], "dir string, name string, chosen string")
    got = {(r["dir"], r["name"]): (r["target"], r["override"]) for r in planning.override(plan, chosen).collect()}
    assert got == {("a", "n.pdf"): ("x.pdf", "unchanged"), ("b", "n.pdf"): ("y.pdf", "taken"), ("b", "m.pdf"): ("NEW.pdf", "manual"), ("b", "k.pdf"): ("w.pdf", "extension")}


def test_many_namesakes_take_free_numbers(spark):
    plan = spark.range(20_000).select(F.lit("d").alias("dir"), F.concat(F.lit("s"), "id").alias("name"), F.lit("a.pdf").alias("proposed"), F.col("id").alias("ord"))
    held = spark.createDataFrame([("d", n) for n in ("A.pdf", "a_03.pdf", "a_3.pdf", "a_100.pdf", "b_04.pdf")], "dir string, name string")
    got = [r["target"] for r in planning.resolve_collisions(plan, held).orderBy("ord").collect()]
    free = [k for k in range(1, 20_100) if k not in (1, 3, 100)][:20_000]
    assert got == [f"a_{k:02d}.pdf" for k in free]


def test_legal_forms_are_whole_words_and_longest_first(spark):
    names = {
        "Закрытое акционерное общество «Луч»": 'ЗАО "Луч"', "непубличное  акционерное общество «Луч»": 'НПАО "Луч"', "Акционерное общество «А»": 'АО "А"',
        "ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ “Б”": 'ООО "Б"', "простоакционерное общество": "простоакционерное общество",
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", extract.normalize_organization(F.col("n")).alias("v"))
    assert {r["n"]: r["v"] for r in rows.collect()} == names


def test_persons_in_capitals_with_one_initial_and_in_the_nominative(spark):
    texts = {
        1: "Гражданин СМИРНОВ ПАВЕЛ ЛЬВОВИЧ прибыл.",
        2: "По иску Белова Олега Игоревича. Истец Белов Олег Игоревич согласен.",
        3: "Принял Орлов К. в срок, а Статья В. не имя.",
    }
    got = {}
    for r in extract.extract_persons(spark.createDataFrame(list(texts.items()), "id int, text string"), ["id"]).collect():
        got.setdefault(r["id"], set()).add(r["value"])
    assert got == {1: {"Смирнов Павел Львович"}, 2: {"Белов Олег Игоревич"}, 3: {"Орлов К."}}


def test_parts_of_a_series(spark):
    stems = {"Дело том 3": ("Дело", 3, "том"), "Иск_часть-12": ("Иск", 12, "часть"), "book vol.2": ("book", 2, "часть"), "скан (7)": ("скан", 7, ""), "акт_05": ("акт", 5, ""), "акт05": None, "2024 1": None, "акт 999": None}
    rows = spark.createDataFrame([(s,) for s in stems], "s string").select("s", series.split_part(F.col("s")).alias("p"))
    assert {r["s"]: r["p"] and tuple(r["p"]) for r in rows.collect()} == stems


def test_finalized_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, " \n"), (3, "й слово"), (4, "x" * 50), (5, "пaрк")], "id int, text string")
    got = {r["id"]: r for r in decoding.finalized(rows, "text", most=20).collect()}
    assert got[1]["statuses"] == got[2]["statuses"] == ["EMPTY_DOCUMENT"]
    assert got[3]["text"] == "й слово" and got[3]["hint"] == "ru"
    assert got[4]["truncated"] and len(got[4]["text"]) == 20 and "LIMIT_EXCEEDED" in got[4]["statuses"]
    assert "MIXED_ALPHABET_SUSPECTED" in got[5]["statuses"]


def test_readers_models_and_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "html", "document", "<p>a <b>b</b><script>x</script>"), (2, "zzz", "document", "plain"), (3, "zzz", "video", "v"), (4, "json", "data", '{"a": {"b": 1}}')], "id int, kind string, category string, content string")
    got = {r["id"]: (r["text"], r["reader"]) for r in readers.read_all(rows, "content").collect()}
    assert got == {1: ("a b", "html"), 2: ("plain", "txt"), 3: (None, ""), 4: ("b: 1", "json")}
    answers = readers.ask(spark.createDataFrame([("12",), ("x",), (None,)], "prompt string"), lambda p: str(int(p) + 1)).collect()
    assert {r["prompt"]: r["answer"] for r in answers} == {"12": "13", "x": None, None: None}
    (tmp_path / "types.json").write_text(json.dumps([{"canonical": "Акт", "aliases": ["акт сверки"]}, {"canonical": " "}, {"canonical": "Иск", "markers": ["исковое"], "priority": 9}]), "utf-8")
    types = {r["canonical"]: (r["markers"], r["priority"]) for r in readers.type_dictionary(spark, str(tmp_path / "types.json")).collect()}
    assert types == {"Акт": (["Акт", "акт сверки"], 50), "Иск": (["исковое"], 9)}


def test_plans_and_facts_are_written_and_read(spark, tmp_path):
    plan = spark.createDataFrame([("a", "n", "t", True)], "dir string, name string, target string, selected boolean")
    manifest.save_plan(plan, str(tmp_path / "plan"), 1)
    manifest.save_plan(plan.withColumn("target", F.lit("u")), str(tmp_path / "plan"), 2)
    assert {(r["version"], r["target"]) for r in spark.read.parquet(str(tmp_path / "plan")).collect()} == {(1, "t"), (2, "u")}
    manifest.forensic(plan, plan.select("name"), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "plan")).count() == spark.read.parquet(str(tmp_path / "report" / "facts")).count() == 1
    record = spark.createDataFrame([("s1", "record", 1, "a")], "session string, type string, seq int, old_path string")
    manifest.append(record, str(tmp_path / "journal"))
    manifest.append(record, str(tmp_path / "journal"))
    assert spark.read.parquet(str(tmp_path / "journal")).count() == 1
    manifest.append(spark.createDataFrame([("s1", 2, "b"), ("s1", 1, "a"), ("s2", 1, "c")], "session string, seq int, old_path string").withColumn("type", F.lit("record")).select("session", "type", "seq", "old_path"), str(tmp_path / "journal"))
    manifest.compact(spark, str(tmp_path / "journal"), str(tmp_path / "compact"))
    for place in ("journal", "compact"):
        assert {(r["session"], r["seq"], r["old_path"]) for r in manifest.journal(spark, str(tmp_path / place)).collect()} == {("s1", 1, "a"), ("s1", 2, "b"), ("s2", 1, "c")}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.TXT").write_text("x")
    assert [(r["name"], r["stem"], r["ext"], r["size"]) for r in files.scan(spark, str(tmp_path / "files")).collect()] == [("a.TXT", "a", ".txt", 1)]
    assert spark.range(1).select(naming.well_formed_name(F.lit("Договор займа Иванова")).alias("w")).first()["w"]


def test_fresh_rows_of_a_plan_want_one_name(spark):
    rows = lambda *r: spark.createDataFrame([("d", *x, True, "OK") for x in r], "dir string, name string, target string, selected boolean, status string")
    plan = rows(("a", "1.txt"), ("b", "2.txt"), ("c", "3.txt"))
    got = {r["name"]: (r["target"], r["selected"]) for r in planning.upsert(plan, rows(("a", "X.txt"), ("b", "x.TXT"), ("q", "Q.txt"))).collect()}
    assert got == {"a": ("X.txt", True), "b": ("x.TXT", False), "c": ("3.txt", True)}
    got = {r["name"]: r["selected"] for r in planning.upsert(plan, rows(("a", "2.TXT"), ("b", "1.txt"), ("c", "9.txt"))).collect()}
    assert got == {"a": False, "b": True, "c": True}  # b's old name is still there when a is replaced, a's is not when b is
    assert [r["name"] for r in planning.selected_rows(plan.withColumn("target", F.when(F.col("name") == "a", F.lit("a")).otherwise(F.col("target")))).orderBy("name").collect()] == ["b", "c"]


def test_the_donor_of_a_run_has_people_before_a_date(spark):
    fact = lambda v: (v, "regex", v, 0.9)
    pages = [(1, 1, fact("Акт"), fact("2024-01-01"), []), (1, 2, fact("Акт"), None, ["Иванов"]), (2, 1, None, fact("2024-01-01"), []), (2, 2, fact("Иск"), None, [])]
    df = spark.createDataFrame(pages, f"run int, page int, kind {assembly.FACT}, day {assembly.FACT}, people array<string>")
    got = {(r["run"], r["page"]): (r["kind"] and r["kind"]["value"], r["day"], r["people"]) for r in assembly.share_in_run(df, "run", "page", ["kind", "day"], "people").collect()}
    assert got[1, 1] == got[1, 2] == ("Акт", None, ["Иванов"])
    assert got[2, 1] == got[2, 2] == ("Иск", None, [])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "dir string, name string, target string, selected boolean, status string")
    assert planning.upsert(none, none).count() == 0
    pages = spark.createDataFrame([], f"run int, page int, kind {assembly.FACT}, people array<string>")
    assert assembly.share_in_run(pages, "run", "page", ["kind"], "people").count() == 0


def test_names_that_people_gave_well_and_less_well(spark):
    fact = lambda value, source="regex": (value, source, value, 0.9)
    rows = [
        ("Постановление по делу Иванова", fact("2026-08-18"), [], "Постановление по делу Иванова_18.08.2026.txt"),
        ("Договор займа №17 от 18 августа 2026 года", fact("2026-08-18"), [], "Договор займа №17 от 18 августа 2026 года.txt"),
        ("Акт 18-08-2026", fact("2026-08-18"), [], "Акт 18-08-2026.txt"),
        ("Акт_8.9.2026", fact("2026-09-08"), [], "Акт_8.9.2026.txt"),
        ("Заметки", fact("2026-08-18", "filesystem"), [], "Заметки.txt"),
        ("Заметки", fact("2026-08-18", "metadata"), ["DATE_SOURCE_FILE_PROPERTY"], "Заметки.txt"),
        ("Заметки: «план»?", None, [], "Заметки: «план»?.txt"),
        ("Заметки: «план»", fact("2026-08-18"), [], "Заметки_ «план»_18.08.2026.txt"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, stem string, day {assembly.FACT}, statuses array<string>, want string")
    got = df.select("want", naming.preserved_name(F.col("stem"), F.lit(".txt"), F.col("day"), F.col("statuses")).alias("name")).collect()
    assert [r["name"] for r in got] == [r["want"] for r in got]
    first = df.where("id = 0").select(naming.preserved_name(F.col("stem"), F.lit(".txt"), F.col("day"), F.col("statuses"), date_first=True)).first()[0]
    assert first == "18.08.2026_Постановление по делу Иванова.txt"
    words = [
        ("седой дом газ", ["Справка", "2026-03-15"], "седой дом газ"), ("скан Иванов паспорт копия 2", ["Иванов Иван Иванович"], "паспорт"), ("IMG_0032", [], None),
        ("справка_15.03.2026_мосгаз", ["Справка", 'АО "Мосгаз"'], None), ("газ, дом  справка", ["справка", None], "газ, дом"),
    ]
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(words)], "id int, stem string, known array<string>, want string")
    assert [r[0] == r[1] for r in df.select(naming.own_words(F.col("stem"), F.col("known")), "want").collect()] == [True] * len(words)


def test_openings_are_folded_once_and_only_as_far_as_types_go(spark):
    """The whole text was folded for every type, and the search written out twice for each field."""
    rows = [
        (1, "  ДОГОВОР займа № 1", 0.3, "Договор займа"), (2, "Договоры", 0.3, "договор"), (3, "акт", 0.3, "акт"), (4, "ак", 0.3, None), (5, "в договоре", 0.3, None), (6, "отчЁт о", 0.3, "Отчет"),
        (7, None, 0.3, None), (8, "договор", 0.6, "Письмо"), (9, "İstanbul " * 9, 0.3, "İSTANBUL"), (10, "\nдоговор", 0.3, None), (11, "договор", None, "договор"), (12, "", 0.3, None),
    ]
    df = spark.createDataFrame(rows, "i int, text string, sure double, want string").repartition(2)
    types = F.array(*[F.lit(t) for t in ("договор", "Договор займа", None, "акт", "Отчет", "İSTANBUL")])
    told = df.select("i", "want", assembly.opening_type(F.lit("Письмо"), F.col("sure"), F.col("text"), types).alias("t"))
    for row in told.collect():
        assert (row["t"]["value"] if row["t"] else None) == row["want"], row
        assert row["t"] is None or row["t"]["confidence"] == (0.6 if row["i"] == 8 else assembly.OPENING_CONFIDENCE)
    none = df.select(assembly.opening_type(F.lit("Письмо"), F.lit(0.3), F.col("text"), F.array().cast("array<string>")).alias("t")).where("t IS NOT NULL")
    assert none.count() == 0
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count("ltrim(") == 1 and "lower(ltrim(" not in plan
