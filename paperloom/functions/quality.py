"""Text quality between 0 and 1, with the ratios it comes from, warnings and status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import let

#: Characters that the reference looks at; the operators take whole texts unless a sample is asked for.
SAMPLE = 20_000
#: Letter frequencies of Russian (yo counted as ye).
LETTERS = {
    "о": 0.1097, "е": 0.0967, "а": 0.0801, "и": 0.0735, "н": 0.0670, "т": 0.0626, "с": 0.0547, "р": 0.0473,
    "в": 0.0454, "л": 0.0440, "к": 0.0349, "м": 0.0321, "д": 0.0298, "п": 0.0281, "у": 0.0262, "я": 0.0201,
    "ы": 0.0190, "ь": 0.0174, "г": 0.0170, "з": 0.0165, "б": 0.0159, "ч": 0.0144, "й": 0.0121, "х": 0.0097,
    "ж": 0.0094, "ш": 0.0073, "ю": 0.0064, "ц": 0.0048, "щ": 0.0036, "э": 0.0032, "ф": 0.0026, "ъ": 0.0004,
}
#: Characters that wrongly decoded text is full of.
MOJIBAKE = "ÐÑÂÃ°µ¾¸â€ŒŽšœžŸ¤¦§¨©ª«¬­®¯"
CYRILLIC = r"[Ѐ-ӿ]"
WORD = r"[\p{L}\p{M}&&[^_\d]]{2,}"
CYRILLIC_WORD = r"[А-Яа-яЁё]{3,}"
VOWELS = "[аеёиоуыэюяАЕЁИОУЫЭЮЯ]"
#: What most texts consist of: printable ASCII, tabs and line ends.
ORDINARY = r"[ -~\r\n\t]++"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def frequency_score(text: Column) -> Column:
    """struct<cosine, letters>: likeness of the letters to LETTERS; 1 for fewer than 20 letters."""

    def cosine(counts: Column) -> Column:
        counted = [(f, counts[i]) for i, f in enumerate(LETTERS.values())]
        dot = sum((n * f for f, n in counted), F.lit(0.0))
        norm = F.sqrt(sum((n * n for _, n in counted), F.lit(0.0)))
        return dot / (norm * sum(f * f for f in LETTERS.values()) ** 0.5)

    def told(letters: Column) -> Column:
        size = F.length(letters)
        counts = F.array(*[(size - F.length(F.translate(letters, "её" if c == "е" else c, ""))).cast("double") for c in LETTERS])
        return F.struct(F.when(size < 20, F.lit(1.0)).otherwise(let(counts, cosine)).alias("cosine"), size.alias("letters"))

    # Only Russian letters are left to count in; of most texts in other scripts that is nothing.
    return let(F.regexp_replace(F.lower(text), "[^а-яё]+", ""), told)


def mixed_words(text: Column, limit: int = 20) -> Column:
    """The first words that mix Latin and Cyrillic letters."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.slice(F.filter(found, lambda w: w.rlike(CYRILLIC) & w.rlike("[A-Za-z]")), 1, limit)


def comparison_key(text: Column) -> Column:
    """Folded for comparison: lower case, yo as ye. Text must be in composed form already."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def language_hint(text: Column, sample: int | None = None) -> Column:
    """ru, en, mixed or empty, by the letters of the text, or of its first `sample` characters."""
    part = text if sample is None else F.left(text, F.lit(sample))
    cyrillic, latin = _count(part, CYRILLIC), _count(part, "[A-Za-z]")
    return (
        F.when(cyrillic + latin == 0, "")
        .when(cyrillic > 1.5 * latin, "ru")
        .when(latin > 1.5 * cyrillic, "en")
        .otherwise("mixed")
    )


def with_quality(df: DataFrame, text: str = "text", sample: int | None = None) -> DataFrame:
    """Add the ratios, `score` and `statuses` of the whole text, or of its first `sample` characters. Null is an empty text, whose score is 0."""
    part = F.coalesce(F.col(text), F.lit(""))
    part = part if sample is None else F.left(part, F.lit(sample))
    # Latin letters go first, then what else is ordinary: the other characters are counted in what is left, of most texts little.
    told = df.withColumn("_part", part).withColumn("_unlettered", F.regexp_replace("_part", "[A-Za-z]++", ""))
    told = told.withColumn("_odd", F.regexp_replace("_unlettered", ORDINARY, "")).withColumn("_cyrillic", _count(F.col("_odd"), CYRILLIC))
    p, odd = F.col("_part"), F.col("_odd")
    found = lambda pattern: F.when(F.col("_cyrillic") > 0, F.regexp_extract_all(p, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    russian = F.filter(found(WORD), lambda w: w.rlike(CYRILLIC))
    words = found(CYRILLIC_WORD)
    ragged = F.filter(
        words,
        lambda w: (w != F.lower(w)) & (w != F.upper(w)) & (w != F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))),
    )
    told = told.withColumns(
        {
            "_n": F.length(p),
            "_replaced": _count(odd, "\\uFFFD"),
            "_control": _count(odd, r"[\p{Cc}&&[^\r\n\t]]"),
            "_latin": F.length(p) - F.length("_unlettered"),
            "_mojibake": _count(odd, f"[{MOJIBAKE}]"),
            "_letters": F.length(p) - F.length("_unlettered") + _count(odd, r"\p{L}"),
            "_frequency": frequency_score(odd),
            "_russian": russian,
            "_words": F.size(words),
            "_ragged": F.size(ragged),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    told = told.withColumns(
        {
            "_other": F.greatest(F.lit(0), F.col("_letters") - F.col("_cyrillic") - F.col("_latin")),
            "replacement_ratio": ratio("_replaced", "_n"),
            "control_ratio": ratio("_control", "_n"),
            "cyrillic_ratio": ratio("_cyrillic", "_n"),
            "latin_ratio": ratio("_latin", "_n"),
            "mojibake_ratio": ratio("_mojibake", "_n"),
            "mixed_case_ratio": ratio("_ragged", "_words"),
            "frequency_score": F.col("_frequency.cosine"),
        }
    )
    told = told.withColumns(
        {
            "other_script_ratio": F.when(F.col("_letters") > 0, F.col("_other") / F.col("_letters")).otherwise(F.lit(0.0)),
            "russian_word_ratio": F.when(
                F.size("_russian") > 0, F.size(F.filter("_russian", lambda w: w.rlike(VOWELS))) / F.size("_russian")
            ).otherwise(F.lit(0.0)),
        }
    )
    c = F.col
    has_russian, letters, n_words = F.size("_russian") > 0, c("_frequency.letters"), c("_words")
    loss = lambda test, amount: F.when(test, amount).otherwise(F.lit(0.0))
    foreign = (c("_other") > 3) & (c("other_script_ratio") > 0.15)
    score = (
        F.lit(1.0)
        - F.least(F.lit(1.0), c("replacement_ratio") * 12.0)
        - F.least(F.lit(1.0), c("control_ratio") * 20.0)
        - F.least(F.lit(0.8), c("mojibake_ratio") * 8.0)
        - loss(has_russian & (c("russian_word_ratio") < 0.5), F.lit(0.35))
        - loss(foreign, F.least(F.lit(0.9), c("other_script_ratio") * 1.2))
        - loss((letters >= 20) & (c("frequency_score") < 0.85), F.least(F.lit(0.85), (0.85 - c("frequency_score")) * 2.5))
        - loss((n_words >= 4) & (c("mixed_case_ratio") > 0.25), F.least(F.lit(0.8), c("mixed_case_ratio")))
        - loss((c("_n") >= 40) & ((c("_cyrillic") + c("_latin")) / F.greatest(c("_n"), F.lit(1)) < 0.25), F.lit(0.25))
    )
    uncertain = (c("replacement_ratio") > 0.005) | ((c("_other") > 3) & (c("other_script_ratio") > 0.4)) | (c("control_ratio") > 0.02)
    garbled = (
        (c("mojibake_ratio") > 0.02)
        | (has_russian & (c("russian_word_ratio") < 0.35) & (c("_cyrillic") > 0))
        | ((letters >= 20) & (c("frequency_score") < 0.75))
        | ((n_words >= 4) & (c("mixed_case_ratio") > 0.4))
    )
    told = told.withColumns(
        {
            "score": F.when(c("_n") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))),
            "statuses": F.array_compact(
                F.array(F.when(uncertain, F.lit("ENCODING_UNCERTAIN")), F.when(garbled, F.lit("MOJIBAKE_SUSPECTED")))
            ),
        }
    )
    return told.drop(*[x for x in told.columns if x.startswith("_") and x not in df.columns])
