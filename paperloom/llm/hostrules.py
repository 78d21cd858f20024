"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is held against rules on its own words. The base rules bind always: too few words, or
half of them in repeated windows. The soft rules (many symbols, many repeated lines) are evidence only.
Failures of any rule are added up by host (here: the source), each host's failure rate is shrunk towards
the rate of all hosts by an empirical beta prior, and the verdict goes back to the host's documents:

* `trusted`: only the base rules bind;
* `strict`: so many documents fail that a soft failure, taken as `EVIDENCE` times likelier for a bad
  document than for a good one, makes the document more likely bad than good: soft rules bind too;
* `rejected`: the host credibly (`CREDIBLE` standard deviations of its posterior) fails with more than
  four fifths of its documents: all of them go.

The prior is fitted by moments to the hosts' rates weighted by their documents, less the spread that
chance alone gives hosts of their sizes; so many small hosts don't pass for spread.

Defined results: null and empty texts have no words and fail the base rules; a null source is a host
of its own; repeated rows count as often as they stand there; an empty table gives an empty one. A kept
column with the name of a result is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, let, words_of

MIN_WORDS = 50
#: Symbols and repeated lines that are evidence against a text, as shares of its words.
MOST_SYMBOLS = 0.1
MOST_DUP_LINES = 0.1
#: How much likelier a soft failure is for a bad document than for a good one.
EVIDENCE = 20.0
#: A host is rejected where its rate is above this by CREDIBLE standard deviations.
REJECT_ABOVE = 0.8
CREDIBLE = 1.645
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1000.0)
#: Hosts up to this number go to each task as a broadcast (some 40 bytes each), more by a shuffle.
BROADCAST_HOSTS = 200_000

SYMBOLS = r"[#*$%&|<>]"


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words inside 3-word windows whose words stand twice or more in the text.

    Window hashes are packed with their positions and sorted, so that equal ones are neighbours. A
    position takes as many low bits as the text needs, the hash has the rest of 62, so equal hashes only
    name candidates: those are sorted again by their words, and only equal words count. The positions are
    sorted in turn, and each window adds the words that the one before left.
    """
    step, packed, found = fresh(df, f"{out}_step", f"{out}_packed", f"{out}_found")
    none = F.array().cast("array<long>")
    number = F.lit(0).cast("long")
    told = df.withColumn(step, F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words) + F.lit(1.0)))).cast("long"))
    # A window's hash comes from its three words in one call; low bits make room for the position.
    told = told.withColumn(
        packed,
        F.when(
            F.size(words) > 3,
            F.sort_array(
                let(
                    F.col(words),
                    lambda w: F.transform(
                        F.sequence(F.lit(0), F.size(w) - 3),
                        lambda i: F.coalesce(
                            F.shiftrightunsigned(
                                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 2
                            ).bitwiseAND(-F.col(step)).bitwiseOR(i),
                            number,
                        ),
                    ),
                )
            ),
        ).otherwise(none),
    )
    twins = F.filter(
        F.zip_with(
            packed,
            F.slice(packed, 2, F.greatest(F.size(packed), F.lit(1))),
            lambda a, b: F.when(a.bitwiseXOR(b) < F.col(step), F.struct(a.alias("a"), b.alias("b"))),
        ),
        lambda p: p.isNotNull(),
    )
    told = told.withColumn(found, F.when(F.size(packed) > 1, twins))
    low = F.col(step) - 1
    told = told.withColumn(
        found,
        F.when(
            F.size(found) > 0,
            F.sort_array(
                F.array_distinct(
                    F.concat(
                        F.transform(found, lambda p: p["a"].bitwiseAND(low)),
                        F.transform(found, lambda p: p["b"].bitwiseAND(low)),
                    )
                )
            ),
        ).otherwise(none),
    )
    told = told.withColumn(
        found,
        F.when(
            F.size(found) > 0,
            let(
                F.sort_array(F.transform(found, lambda i: F.struct(*[F.get(words, (i + k).cast("int")).alias(f"w{k}") for k in range(3)], i.alias("at")))),
                lambda placed: F.sort_array(
                    F.array_distinct(
                        F.flatten(
                            F.filter(
                                F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), _same_words),
                                lambda x: x.isNotNull(),
                            )
                        )
                    )
                ),
            ),
        ).otherwise(none),
    )
    covered = F.aggregate(
        found,
        F.struct(number.alias("n"), number.alias("to")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["to"], i)).alias("n"), (i + 3).alias("to")),
        lambda acc: acc["n"],
    )
    return told.withColumn(out, covered).drop(step, packed, found)


def _same_words(a: Column, b: Column) -> Column:
    return F.when((a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.array(a["at"], b["at"]))


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and soft_failed."""
    (words,) = fresh(docs, "words_of_text")
    told = docs.withColumn(words, words_of(F.col(text)))
    told = told.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": duplicate_lines(F.col(text)),
        }
    )
    told = with_repeated_words(told, words, "n_repeat_words").drop(words)
    return told.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "soft_failed": (F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_words")),
        }
    )


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host: n, failures, rate, the rate shrunk by the beta prior fitted to all hosts, and the verdict.

    With mean m (of all documents) and variance v of the hosts' true rates the prior is Beta(m*s, (1-m)*s),
    s = m(1-m)/v - 1, held within PRIOR_WEIGHT; hosts without more spread than chance gives get the strongest.
    """
    hosts = checkpointed(
        judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(failed)).alias("failures"))
    ).withColumn("rate", F.col("failures") / F.col("n"))
    row = hosts.agg(
        F.sum("n").alias("all"),
        F.sum("failures").alias("bad"),
        F.sum(F.pow("failures", F.lit(2.0)) / F.col("n")).alias("squares"),
        F.sum(F.pow("n", F.lit(2.0))).alias("sizes"),
        F.count(F.lit(1)).alias("hosts"),
    ).first()  # five numbers
    m, s = 0.0, PRIOR_WEIGHT[1]
    if row["all"]:
        m = row["bad"] / row["all"]
        spare = row["all"] - row["sizes"] / row["all"]
        spread = row["squares"] - row["all"] * m * m - (row["hosts"] - 1) * m * (1 - m)
        if spread > 0 and spare > 0:
            s = min(max(m * (1 - m) / (spread / spare) - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    told = hosts.withColumn("shrunk", (F.col("failures") + F.lit(m * s)) / (F.col("n") + F.lit(s)))
    rate = F.col("shrunk")
    error = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(s + 1)))
    verdict = F.when(rate - CREDIBLE * error > REJECT_ABOVE, "rejected").when(rate * EVIDENCE > 1 - rate, "strict").otherwise("trusted")
    return told.withColumn("verdict", verdict)


def _with_hosts(told: DataFrame, judged: DataFrame, host: str) -> DataFrame:
    """Add host_rate, host_verdict and kept to `told`, from the failures in `judged`, which has the same hosts."""
    key, failed = fresh(told, "host_key", "any_failed")
    judged = judged.select(F.col(host).alias(key), (F.col("base_failed") | F.col("soft_failed")).alias(failed))
    rates = host_rates(judged, key, failed).select(key, F.col("shrunk").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    if rates.count() <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    told = told.drop("host_rate", "host_verdict", "kept")
    joined = told.join(rates, told[host].eqNullSafe(rates[key])).drop(key)
    # A filter on `kept` must stay here: moved down to the texts, the optimizer would write each step's
    # expression into the next. A term that depends on the task, though always true, holds it.
    here = F.spark_partition_id() >= 0
    bound = (F.col("host_verdict") != "rejected") & ((F.col("host_verdict") == "trusted") | ~F.col("soft_failed"))
    return joined.withColumn("kept", ~F.col("base_failed") & bound & here)


#: Columns that the rules and the verdict add.
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed")


def verdicts(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """The columns `keep` of each row with its rule columns, host_rate (shrunk), host_verdict and kept.

    Texts are read once: their counts are written down, and hosts are judged from those.
    """
    body, place = fresh(docs, "text_to_judge", "host_to_judge")
    kept = [c for c in dict.fromkeys(keep) if c not in (*RULES, "host_rate", "host_verdict", "kept")]
    rows = docs.select(*kept, docs[text].alias(body), docs[host].alias(place))
    told = checkpointed(with_rules(rows, body).drop(body))
    return _with_hosts(told, told, place).drop(place)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that the rules and their host's verdict keep, with the columns of `docs`.

    Texts are read twice, once for the hosts' failures and once for the rows, and never shuffled.
    """
    body, place = fresh(docs, "text_to_judge", "host_to_judge")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    told = with_rules(docs.select(row, docs[text].alias(body), docs[host].alias(place)), body)
    return _with_hosts(told, told, place).where("kept").select("row.*")
