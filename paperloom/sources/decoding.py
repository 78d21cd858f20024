"""Bytes to text: UTF-8 natively, legacy code pages and composed form by Arrow functions.

Spark's decode() knows neither windows-1251 nor koi8-r, and there is no built-in normal form, so these
two run in Arrow batches, and only on rows that need them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality

#: Legacy code pages in the order in which they are tried.
CODE_PAGES = ("cp1251", "koi8-r", "cp866", "iso8859-5")
#: Fixed value: quality from which a trusted page is taken at once.
GOOD = 0.85


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


#: Characters beside which nothing composes and that are composed themselves: Latin, Cyrillic without its marks, common signs.
INERT = r"\u0000-\u02FF\u0400-\u0482\u048A-\u052F\u2010-\u2027\u2030-\u205E\u20AC\u2116"


def nfc(text: Column) -> Column:
    """Composed form; only texts with other characters than INERT leave the JVM.

    Arrow functions get every row whatever condition stands around them, so the others are null to them.
    """
    return F.coalesce(_composed(F.when(text.rlike(f"[^{INERT}]"), text)), text)


@F.pandas_udf(T.StringType())
def _strictly(content: pd.Series, pages: pd.Series) -> pd.Series:
    """Texts of bytes by the code page beside them; null where the page is unknown or does not fit."""

    def one(body: bytes | None, page: str | None) -> str | None:
        try:
            return None if body is None or page is None else bytes(body).decode(page)
        except (UnicodeError, LookupError):
            return None

    return pd.Series([one(b, p) for b, p in zip(content, pages)], dtype=object)


def marked_encoding(content: Column) -> Column:
    """The encoding that a byte-order mark of UTF-32 or UTF-16 tells; null without one."""
    head = lambda mark: F.substring(content, 1, len(mark) // 2) == F.unhex(F.lit(mark))
    return (
        F.when(head("FFFE0000") | head("0000FEFF"), F.lit("utf-32"))
        .when(head("FFFE") | head("FEFF"), F.lit("utf-16"))
    )


def decode_bytes(df: DataFrame, content: str, out: str = "text", declared: str | None = None) -> DataFrame:
    """Add `out` and `encoding`; null stays null.

    A byte-order mark decides where it fits. Otherwise strict UTF-8 counts, if the file's own declaration (a column)
    does not name something else. What is left takes the best of the declared page, UTF-8 and the legacy code pages
    by 0.7 of the text's quality and 0.3 of the trust in the page; a trusted page with quality from GOOD ends the search.
    Marked bytes that do not fit their mark are tried like the rest.
    """
    body = F.col(content)
    # A row's number keeps the filters below from being moved in front of what makes the content, which would make it anew for each use.
    told = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_mark", marked_encoding(body))
    named = F.replace(F.lower(F.trim(F.col(declared))), F.lit("_"), F.lit("-")) if declared else F.lit(None).cast("string")
    told = told.withColumn("_named", F.when(~named.isin("", "utf-8", "utf8"), named))
    easy = F.is_valid_utf8(body.cast("string")) & F.col("_mark").isNull() & F.col("_named").isNull()
    # Only marked rows go to Python here; what fits its mark needs no other page and no score.
    told = told.withColumn("_marked", _strictly(F.when(F.col("_mark").isNotNull(), body), F.col("_mark")))
    read = lambda text, page: F.struct(text.alias("t"), page.alias("page"))
    nothing = read(F.lit(None).cast("string"), F.lit(None).cast("string"))
    sure = F.when(body.isNull(), nothing).when(easy, read(body.cast("string"), F.lit("utf-8"))).when(F.col("_marked").isNotNull(), read(F.col("_marked"), F.col("_mark")))
    told = told.withColumn("_best", sure)
    right, tries = told.where(F.col("_best").isNotNull() & (F.col("_row") >= 0)), told.where(F.col("_best").isNull() & (F.col("_row") >= 0))
    # In order: the page and how far it is trusted. One row a try, so that quality stands in the plan once.
    pages = [(F.col("_named"), 0.95), (F.lit("utf-8"), 0.9), *[(F.lit(p), 0.55) for p in CODE_PAGES]]
    listed = F.array(*[F.struct(page.alias("page"), F.lit(trust).alias("trust")) for page, trust in pages])
    each = tries.select(*df.columns, "_row", F.posexplode(listed).alias("_i", "_p"))
    each = each.withColumn("_try", _strictly(body, F.col("_p.page")))
    each = quality.with_quality(each, "_try").select(*each.columns, F.col("score").alias("_score"))
    fits = F.col("_try").isNotNull()
    rank = F.when(fits, 0.7 * F.col("_score") + 0.3 * F.col("_p.trust")).otherwise(-1.0)
    tried = F.struct(rank.alias("s"), (-F.col("_i")).alias("i"), F.col("_p.page").alias("page"), F.col("_try").alias("t"))
    row = each.groupBy("_row").agg(
        *[F.any_value(c).alias(c) for c in df.columns], F.collect_list(tried).alias("_tries"),
        *[F.max((F.col("_i") == i) & fits & (F.col("_score") >= GOOD)).alias(f"_good_{i}") for i in range(2)],
    )
    # The best of some pages, the first on ties; pages that do not fit come last.
    best = lambda n: F.array_max(F.filter("_tries", lambda x: x["i"] > -n))
    found = row.withColumn("_best", F.when(F.col("_good_0"), best(1)).when(F.col("_good_1"), best(2)).otherwise(best(len(pages))))
    plain = lambda rows: rows.select(*df.columns, F.regexp_replace("_best.t", "^\\uFEFF", "").alias(out), F.col("_best.page").alias("encoding"))
    return plain(right).unionByName(plain(found))


@F.pandas_udf(T.StringType())
def _reread(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        for page in ("cp1251", "latin-1", "cp1252"):
            try:
                fixed = text.encode(page).decode("utf-8")
                if fixed.encode("utf-8").decode(page) == text:
                    return fixed
            except (UnicodeError, AttributeError):
                continue
        return None

    return texts.map(one)


def fix_mojibake(df: DataFrame, text: str, gain: float = 0.2) -> DataFrame:
    """Replace texts of UTF-8 read as a single-byte page, where the way back loses nothing and gains more than `gain` in quality."""
    scored = quality.with_quality(df, text).select(*df.columns, F.col("score").alias("_score"), F.array_contains("statuses", "MOJIBAKE_SUSPECTED").alias("_bad"))
    good = scored.where((F.col("_score") >= 0.75) & ~F.col("_bad")).select(*df.columns, F.lit(False).alias("fixed"))
    bad = scored.where(~((F.col("_score") >= 0.75) & ~F.col("_bad"))).withColumn("_new", _reread(F.col(text)))
    again = quality.with_quality(bad, "_new").select(*bad.columns, F.col("score").alias("_after"))
    better = F.col("_new").isNotNull() & (F.col("_after") > F.col("_score") + gain)
    changed = again.withColumn(text, F.when(better, F.col("_new")).otherwise(F.col(text))).select(*df.columns, better.alias("fixed"))
    return good.unionByName(changed)


def finalized(df: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Bring a text into composed form, cut it to `most` characters if asked to, and add truncated, score, hint and statuses.

    The reference cuts at 400,000 characters; here whole texts are the default. Null is an empty text.
    """
    whole = nfc(F.coalesce(F.col(text), F.lit("")))
    told = df.withColumn(text, whole).withColumn("truncated", F.lit(False) if most is None else F.length(text) > most)
    if most is not None:
        told = told.withColumn(text, F.left(text, F.lit(most)))
    scored = quality.with_quality(told, text).select(*told.columns, "score", F.col("statuses").alias("_found"))
    more = F.array(
        F.when(F.col("truncated"), F.lit("LIMIT_EXCEEDED")),
        F.when(F.size(quality.mixed_words(F.col(text), 5)) > 0, F.lit("MIXED_ALPHABET_SUSPECTED")),
        F.when(~F.col(text).rlike(r"(?U)\S"), F.lit("EMPTY_DOCUMENT")),
    )
    return scored.withColumns({"hint": quality.language_hint(F.col(text)), "statuses": F.array_union("_found", F.array_compact(more))}).drop("_found")
