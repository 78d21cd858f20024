"""Which numbers of a text get a row: only those that may say something, and none of what they say is lost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paperloom.operators import numbers
from paperloom.operators.places import places


def test_numbers_that_say_nothing_get_no_row(spark):
    text = "Акт № 15 от 5 мая 2024 на 75462.67 руб., 12 листов, 1.2.2024, ИНН 7707083893, тел. 495-12, 1.2.3.4 и 1234567890123456"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = lambda **which: [r["matched"] for r in places(df, ["id"], [numbers.family(**which)]).orderBy("start").collect()]
    assert found(identifiers=False) == ["5", "1.2.2024", "1.2.3.4"]
    assert found(dates=False) == ["№", "1.2.2024", "7707083893"]
    assert found() == ["№", "5", "1.2.2024", "7707083893", "1.2.3.4"]


def test_nothing_that_numbers_say_is_lost(spark):
    rng = random.Random(11)
    pieces = ["05.12.2024", "2024-05-12", "А40-123/2024", "дело 2-31/2024 ", "№ 77", "ИНН 7707083893 ", "5 мая 2024", "1", "12", "05", "2024", "1999", "123456", "7707083893", "1027700132195", ".", "/", "-", "_", " ", "№", "№ ", " мая 2024", "» марта  2023", " янв. 2020", "ИНН ", "дело ", "А", "-ИП", "x", ", ", "ВС ", "\n"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(1, 40)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, text string")
    for which in ({}, {"dates": False}, {"identifiers": False}):
        said = lambda family: numbers.candidates(places(df, ["id"], [family]), ["id"], {"number": numbers.says(**which)})  # noqa: B023, E731
        kept, every = said(numbers.family(**which)), said(numbers.NUMBERS)
        assert every.count() > 100
        assert kept.exceptAll(every).count() == 0 and every.exceptAll(kept).count() == 0


def test_inn_by_its_digits(spark):
    df = spark.createDataFrame([("7707083893",), ("7707083894",), ("500100732259",), ("500100732258",), ("77070838",), ("770708389x",), (None,)], "v string")
    assert [r[0] for r in df.select(F.coalesce(numbers.valid_inn(F.col("v")), F.lit(False))).collect()] == [True, False, True, False, False, False, False]


def test_what_is_no_date_is_not_cast(spark):
    rows = spark.createDataFrame([("№", "", " 17"), ("7919000001", "ИНН ", "")], "matched string, left string, right string")
    said, _ = numbers.says(identifiers=False)(rows)
    plan = said._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_cast(CASE WHEN isnotnull(_kind") == 3
    assert [tuple(r) for r in said.select("_y", "_m", "_d").collect()] == [(None, None, None)] * 2
