"""What numbers in a text say: dates and identifiers, from one pass over runs of digits and their surroundings.

The pass stops at number signs and at runs of digits that single marks join. What a run is follows from its parts (how
many, how long, joined by which marks) and from the words beside it, so a date, a tax id or a case number is a line in a
table here and no pattern of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import CONTEXT_WIDTH, any_of, head_bonus, squeeze
from .places import Family, Rule

#: A number sign, or digits joined by single marks.
NUMBERS = Family("number", (Rule("№|[0-9]+(?:[./_-][0-9]+)*", 0.0),))
DIGITS = "0123456789"

#: Months by number, in the genitive, nominative and short forms.
MONTHS = {
    1: "января январь янв", 2: "февраля февраль февр фев", 3: "марта март мар", 4: "апреля апрель апр", 5: "мая май",
    6: "июня июнь июн", 7: "июля июль июл", 8: "августа август авг", 9: "сентября сентябрь сент сен",
    10: "октября октябрь окт", 11: "ноября ноябрь нояб ноя", 12: "декабря декабрь дек",
}
#: Words to the left that make a date the document's, or a person's.
DOCUMENT_MARKS = ("от", "дата", "составлен", "составлено", "подписан", "выдан", "вынесено", "принято", "утверждено", "г. москва", "город")
PERSONAL_MARKS = ("рождения", "родился", "родилась", "дата рожд", "г.р.", "года рождения", "срок действия", "действителен до", "годен до")
MARK_WIDTH = 40
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: How sure the written forms of a date are.
DATE_CONFIDENCE = {"verbal": 0.93, "numeric": 0.88, "iso": 0.9, "short_year": 0.25}


#: A month in words and a year, as they follow a day.
FOLLOWING = r"^[»\"']?\s+(\p{L}+)\.?\s+([0-9]{4})"


@dataclass(frozen=True)
class Shape:
    """A number by its parts' lengths (least, most) and the marks between them, and the words that stand right before it."""

    kind: str
    lengths: tuple[tuple[int, int], ...]
    marks: tuple[str, ...]
    before: tuple[str, ...]
    apart: int
    confidence: float
    role: str = ""


#: The forms of "case" before its number, of contracts and policies, and the labels of registered numbers.
CASE_WORDS = ("дело", "дела", "делу", "деле")
CONTRACT_WORDS = ("полис", "контракт", "договор", "соглашение", "соглашения")
SHAPES = (
    Shape("enforcement_number", ((4, 8), (2, 2), (3, 7)), ("/", "/"), (), 0, 0.8, "case_number"),
    Shape("case_number", ((1, 2), (1, 7), (4, 4)), ("-", "/"), ("А", "A"), 0, 0.95),
    Shape("case_number", ((1, 3), (1, 7), (2, 4)), ("-", "/_-"), CASE_WORDS, 12, 0.9),
    Shape("inn", ((10, 10),), (), ("ИНН",), 0, 0.5),
    Shape("inn", ((12, 12),), (), ("ИНН",), 0, 0.5),
    Shape("ogrn", ((13, 13),), (), ("ОГРН", "ОГРНИП"), 0, 0.5),
    Shape("ogrn", ((15, 15),), (), ("ОГРН", "ОГРНИП"), 0, 0.5),
    Shape("kpp", ((9, 9),), (), ("КПП",), 0, 0.9),
    Shape("writ_number", ((6, 12),), (), ("АС", "ВС", "ФС"), 0, 0.93),
)


def family(dates: bool = True, identifiers: bool = True) -> Family:
    """The places of NUMBERS that may say a date or an identifier; what the others say is nothing, so they need no row.

    Runs are read as a whole, as NUMBERS reads them: three parts or more (dates; identifiers have three), a day before a
    month in words and a year, a run as long as a registered number; number signs.
    """
    start, alone = r"(?=[0-9])(?<![0-9])(?<![0-9][./_-])", "(?![0-9])(?![./_-][0-9])"
    forms = [r"[0-9]++(?:[./_-][0-9]++){2,}+" if dates else rf"[0-9]++(?:[./_-][0-9]++){{2}}+{alone}"]
    if dates:
        forms.append(f"[0-9]{{1,2}}+{alone}(?={FOLLOWING[1:]})")
    if identifiers:
        single = [s.lengths[0] for s in SHAPES if len(s.lengths) == 1]
        forms.append(f"[0-9]{{{min(least for least, _ in single)},{max(most for _, most in single)}}}+{alone}")
    return Family("number", (Rule(("№|" if identifiers else "") + f"{start}(?:{'|'.join(forms)})", 0.0),))


#: Confidence of what follows a number sign: behind the word for a case, behind a contract's, and anywhere.
SIGNED_CASE, SIGNED_CONTRACT, SIGNED_OTHER = 0.9, 0.92, 0.85
MOST_SIGNED, CONTRACT_GAP = 40, 40


def _is_word(char: Column) -> Column:
    return char.rlike(r"[\p{L}\p{N}_]")


def _edge(text: Column, last: bool) -> Column:
    """Whether a place may begin (or end) here: no letter, digit or underscore beside it."""
    return ~_is_word(F.right(text, F.lit(1)) if last else F.left(text, F.lit(1)))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date as text, null if there is none of these numbers."""
    # By arithmetic, as a parser that fails costs an exception a row.
    year, month, day = (n.try_cast("int") for n in (year, month, day))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    padded = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, 12) & day.between(1, last), F.concat_ws("-", year.cast("string"), padded(month), padded(day)))


def _candidate(family: str, kind: Column, value: Column, ord_: Column, at: Column, long: Column, confidence: Column, role: Column) -> Column:
    named = zip((F.lit(family), kind, value, ord_, at, long, confidence, role), ("family", "kind", "value", "ord", "at", "long", "confidence", "role"))
    return F.struct(*[c.alias(n) for c, n in named])


def date_kind(lengths: list[Column], marks: list[Column]) -> Column:
    """How three parts of these lengths, joined by these marks, are written as a date; null if they are none."""
    a, b, c = lengths
    plain = (marks[0] != "_") & (marks[1] != "_")
    return F.when(plain & (a <= 2) & (b <= 2) & (c == 4), "numeric").when((a == 4) & (b == 2) & (c == 2) & (marks[0] == "-") & (marks[1] == "-"), "iso").when(
        plain & (a <= 2) & (b <= 2) & (c == 2), "short_year"
    )


def written_date(value: Column) -> Column:
    """How a text that is a date and nothing else is written; null for any other."""
    parts, marks = F.split(value, "[./-]"), F.translate(value, DIGITS, "")
    three = [F.coalesce(F.length(F.get(parts, F.lit(i))), F.lit(0)) for i in range(3)]
    kind = date_kind(three, [F.substring(marks, i, 1) for i in (1, 2)])
    digits = F.exists(parts, lambda p: (p == "") | (F.translate(p, DIGITS, "") != ""))
    return F.when((F.size(parts) == 3) & ~digits, kind)


def _dates(rows: DataFrame, short_years: bool) -> tuple[DataFrame, Column]:
    """A row for every three parts next to each other, with the date that they, or a day with its month in words, are."""
    token, left, right = F.col("matched"), F.col("left"), F.col("right")
    parts, marks, i = F.col("_parts"), F.col("_marks"), F.col("_i")
    n = F.size(parts)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))))
    three, between = [F.get(parts, i + k) for k in range(3)], [F.substring(marks, i + k, F.lit(1)) for k in (1, 2)]
    opened = F.when(i > 0, F.substring(marks, i, F.lit(1)) != "_").otherwise(_edge(left, True))
    shut = F.when(i + 3 < n, F.substring(marks, i + 3, F.lit(1)) != "_").otherwise(_edge(right, False))
    in_words = (n == 1) & (token != "№") & (F.length(token) <= 2) & _edge(left, True)
    rows = rows.withColumns(
        {
            "_kind": F.when(n >= 3, date_kind([F.length(p) for p in three], between)),
            "_after": F.when(in_words, F.regexp_extract(right, FOLLOWING, 0)).otherwise(""),
            "_offset": F.when(i > 0, F.length(F.array_join(F.slice(parts, 1, i), "-")) + 1).otherwise(0),
        }
    )
    kind, after, offset = F.col("_kind"), F.col("_after"), F.col("_offset")
    kept = ((kind != "short_year") | ((n % 3 == 0) & (i % 3 == 0))) & opened & shut
    rows = rows.withColumn("_kind", F.when(after != "", "verbal").when(kind.isNotNull() & kept, kind))
    months = F.create_map(*[F.lit(x) for number, forms in MONTHS.items() for form in forms.split() for x in (form, number)])
    verbal, iso, short = kind == "verbal", kind == "iso", kind == "short_year"
    full = three[2]
    if short_years:
        full = F.when(short, (three[2].try_cast("int") + F.when(three[2].try_cast("int") < 70, 2000).otherwise(1900)).cast("string")).otherwise(three[2])
    year = F.when(verbal, F.regexp_extract(after, FOLLOWING, 2)).when(iso, three[0]).otherwise(full)
    month = F.when(verbal, F.try_element_at(months, F.lower(F.regexp_extract(after, FOLLOWING, 1))).cast("string")).otherwise(three[1])
    text = F.concat(three[0], between[0], three[1], between[1], three[2])
    numbers = {"_y": year, "_m": month, "_d": F.when(verbal, token).when(iso, three[2]).otherwise(three[0])}
    # What is no date is not cast: a cast that fails costs an exception a row too.
    rows = rows.withColumns({**{name: F.when(kind.isNotNull(), n).try_cast("int") for name, n in numbers.items()}, "_near": F.lower(F.right(F.concat(left, F.left(token, offset)), F.lit(MARK_WIDTH)))})
    day, near = _day(F.col("_y"), F.col("_m"), F.col("_d")), F.col("_near")
    rows = rows.withColumn("_day", F.when(kind.isNull(), None).otherwise(day if short_years else F.when(short, text).otherwise(day)))

    role = F.when(any_of(near, PERSONAL_MARKS), "personal_date").when(any_of(near, DOCUMENT_MARKS), "document_date").otherwise("date")
    role = role if short_years else F.when(short, "ambiguous_year").otherwise(role)
    sure = F.lit(None).cast("double")
    for k, c in DATE_CONFIDENCE.items():
        sure = F.when(kind == k, 0.6 if short_years and k == "short_year" else c).otherwise(sure)
    order = F.array_position(F.array(*map(F.lit, DATE_CONFIDENCE)), kind).cast("int")
    long = F.when(verbal, F.length(token) + F.length(after)).otherwise(F.length(text))
    return rows, F.when(F.col("_day").isNotNull(), _candidate("date", kind, F.col("_day"), order, offset, long, sure, role))


def _behind(left: Column, words: tuple[str, ...], apart: int, whole: bool) -> Column:
    """Whether one of the words stands before a place, at most so many characters without digits away.

    With `whole` the word is matched by case, up to spaces, colons and number signs, and no letter stands before it.
    """
    if whole:
        near = F.regexp_replace(left, r"[\s:№]+$", "")
        return F.greatest(*[near.endswith(w) & _edge(F.left(near, F.length(near) - len(w)), True) for w in (*words, words[0])])
    low = F.col("_low")
    gap = lambda w: F.substring_index(low, w, -1)
    return F.greatest(*[F.contains(low, F.lit(w)) & (F.length(gap(w)) <= apart) & ~gap(w).rlike("[0-9]") for w in (*words, words[0])])


def _shaped() -> Column:
    """The identifier that a run of digits is by its shape; null if it is none."""
    token, left, right = F.col("matched"), F.col("left"), F.col("right")
    parts, marks = F.col("_parts"), F.col("_marks")
    found = []
    for i, shape in enumerate(SHAPES):
        test = F.size(parts) == len(shape.lengths)
        for k, (least, most) in enumerate(shape.lengths):
            test = test & F.length(F.get(parts, F.lit(k))).between(least, most)
        for k, allowed in enumerate(shape.marks):
            test = test & F.contains(F.lit(allowed), F.substring(marks, k + 1, 1))
        value, at = token, F.lit(0)
        if shape.kind == "enforcement_number":
            tail = F.regexp_extract(right, r"^-[А-ЯЁ]{2,4}(?![\p{L}\p{N}_])", 0)
            value, test = F.concat(token, tail), test & _edge(left, True) & ((tail != "") | _edge(right, False))
        elif shape.apart:
            test = test & _behind(left, shape.before, shape.apart, False) & ~F.right(left, F.lit(1)).rlike("[А-ЯЁA-Za-z]")
        elif len(shape.lengths) == 3:  # a letter that belongs to the number
            letter = F.right(left, F.lit(1))
            test = test & letter.isin(*shape.before) & _edge(F.left(left, F.length(left) - 1), True) & _edge(right, False)
            value, at = F.concat(letter, token), F.lit(-1)
        else:
            test = test & _behind(left, shape.before, 0, True) & _edge(right, False)
            if shape.kind == "writ_number":
                series = F.right(F.regexp_replace(left, r"[\s№]+$", ""), F.lit(2))
                value = F.concat_ws(" ", series, token)
        sure = F.lit(0.96) if shape.kind == "enforcement_number" else F.lit(shape.confidence)
        if shape.kind == "enforcement_number":
            sure = F.when(value.endswith("-ИП"), 0.96).otherwise(shape.confidence)
        elif shape.kind in ("inn", "ogrn"):
            sure = F.when((valid_inn if shape.kind == "inn" else valid_ogrn)(token), 0.97).otherwise(shape.confidence)
        told = _candidate("identifier", F.lit(shape.kind), value, F.lit(i), at, F.length(value), sure, F.lit(shape.role or shape.kind))
        found.append(F.when(test, told))
    return F.coalesce(*found)  # what the shapes ask for excludes each other


def _signed(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """What follows a number sign: the number of a case, a contract, or just a document."""
    sign, right, low, word = F.col("matched") == "№", F.col("right"), F.col("_low"), F.col("_word")
    bare = lambda v: F.rtrim(v, F.lit(".,;"))
    rows = rows.withColumn("_word", F.when(sign, F.regexp_extract(right, r"^\s*([^\s,;]+)", 1)))
    rows = rows.withColumns(
        {
            "_lead": F.when(sign, F.length(F.regexp_extract(right, r"^\s*", 0))),
            "_case": bare(F.left(word, F.lit(MOST_SIGNED))),
            "_contract": F.substring_index(word, ".", 1),
            "_other": bare(F.regexp_extract(word, r"^[0-9][\p{L}\p{N}._/-]*", 0)),
        }
    )
    lead, case, contract, other = (F.col(c) for c in ("_lead", "_case", "_contract", "_other"))
    gap = lambda w: F.substring_index(low, w, -1)
    near = [F.contains(low, F.lit(w)) & (F.length(gap(w)) <= CONTRACT_GAP) & ~F.contains(gap(w), F.lit("№")) & ~F.contains(gap(w), F.lit("\n")) for w in CONTRACT_WORDS]
    of_case = F.greatest(*[F.rtrim(low).endswith(w) for w in CASE_WORDS])
    numbered = F.left(contract, F.lit(1)).rlike("[0-9]")
    told = lambda kind, value, order, sure: _candidate("identifier", F.lit(kind), value, F.lit(order), lead + 1, F.length(value), F.lit(sure), F.lit(kind))
    return rows, [
        F.when(of_case & (F.length(case) >= 3), told("case_number", case, len(SHAPES), SIGNED_CASE)),
        F.when(F.greatest(*near) & numbered & plausible_number(contract), told("contract_number", contract, len(SHAPES) + 1, SIGNED_CONTRACT)),
        F.when((other != "") & plausible_number(other), told("document_number", other, len(SHAPES) + 2, SIGNED_OTHER)),
    ]


Say = Callable[[DataFrame], tuple[DataFrame, list[Column]]]


def says(dates: bool = True, identifiers: bool = True, short_years: bool = False) -> Say:
    """What a place of NUMBERS says: a function that adds columns to the rows and names the candidates (null: none) that they give."""

    def told(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
        sign, found = F.col("matched") == "№", []
        rows = rows.withColumns({"_parts": F.split("matched", "[./_-]"), "_marks": F.translate("matched", DIGITS, "")})
        if dates:
            rows, date = _dates(rows, short_years)
            found.append(date)
        if identifiers:
            once = F.col("_i") == 0 if dates else F.lit(True)
            rows = rows.withColumn("_low", F.when(sign | (F.size("_parts") == 3), F.lower("left")))
            rows, signed = _signed(rows)
            found += [F.when(once & ~sign, _shaped()), *[F.when(once & sign, c) for c in signed]]
        return rows, found

    return told


def says_one(family: str, value: Column, role: Column) -> Column:
    """The one candidate that a whole place gives."""
    return _candidate(family, F.lit(family), value, F.col("rule_ord"), F.lit(0), F.length("matched"), F.col("confidence"), role)


def candidates(places: DataFrame, keys: list[str], told: dict[str, Column | Say]) -> DataFrame:
    """(keys, family, kind, value, ord, position, confidence, role, context): what places say, repeats included.

    told: for each family of places its candidate (null: none), or what `says` gives. The candidates are made in
    projections, one upon the other, as a generator's argument and what stands in a lambda are never compiled.
    Outer, as Spark would otherwise test the array before the projections and compute all of it twice.
    """
    rows, found = places, []
    for family, say in told.items():
        rows, said = say(rows) if callable(say) else (rows, [say])
        found += [F.when(F.col("family") == family, c) for c in said]
    rows = rows.select(*keys, "matched", "start", "left", "right", "size", F.array(*found).alias("_told"))
    rows = rows.select(*keys, "matched", "start", "left", "right", "size", F.inline_outer("_told")).where(F.col("kind").isNotNull())
    # The evidence: what stands CONTEXT_WIDTH characters before and behind the candidate.
    around = F.concat("left", "matched", "right")
    first = F.greatest(F.length("left") + F.col("at") - CONTEXT_WIDTH, F.lit(0))
    last = F.length("left") + F.col("at") + F.col("long") + CONTEXT_WIDTH
    position = F.col("start") + F.col("at")
    sure = F.when((F.col("role") == "ambiguous_year") | (F.col("family") == "type"), F.col("confidence")).otherwise(F.least(F.lit(0.99), F.col("confidence") + head_bonus(position, F.col("size"))))
    return rows.select(*keys, "family", "kind", "value", "ord", position.alias("position"), sure.alias("confidence"), "role", squeeze(F.substring(around, first + 1, last - first)).alias("context"))


def _weighted(value: Column, weights: list[int]) -> Column:
    """The check digit of a text of digits."""
    return sum((w * (F.ascii(F.substring(value, i + 1, 1)) - 48) for i, w in enumerate(weights)), F.lit(0)) % 11 % 10


def valid_inn(value: Column) -> Column:
    """Checksum of a 10- or 12-digit tax id."""
    ten_weights, eleven, twelve = [2, 4, 10, 3, 5, 9, 4, 6, 8], [7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
    holds = lambda weights: _weighted(value, weights) == F.ascii(F.substring(value, len(weights) + 1, 1)) - 48
    only = F.translate(value, DIGITS, "") == ""
    return F.when(only & (F.length(value) == 10), holds(ten_weights)).when(only & (F.length(value) == 12), holds(eleven) & holds(twelve)).otherwise(F.lit(False))


def valid_ogrn(value: Column) -> Column:
    """Checksum of a 13- or 15-digit registration number."""
    body = F.substring(value, 1, F.length(value) - 1).try_cast("decimal(20,0)")
    last = F.right(value, F.lit(1)).try_cast("int")
    only = F.translate(value, DIGITS, "") == ""
    return (
        F.when(only & (F.length(value) == 13), (body % 11 % 10).cast("int") == last)
        .when(only & (F.length(value) == 15), (body % 13 % 10).cast("int") == last)
        .otherwise(F.lit(False))
    )


def plausible_number(value: Column) -> Column:
    """At most 20 characters, no decimal, no date, at most two separators and none at the end, with a digit."""
    v = F.trim(value)
    separators = F.length(v) - F.length(F.translate(v, "-/._", ""))
    bare = F.translate(v, DIGITS, "")
    decimal = bare.isin(".", ",") & ~v.startswith(bare) & ~v.endswith(bare)
    return F.length(v).between(1, 20) & (separators <= 2) & ~F.right(v, F.lit(1)).isin("-", "/", ".", "_") & (bare != v) & ~decimal & written_date(v).isNull()
