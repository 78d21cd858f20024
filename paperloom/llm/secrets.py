"""Secret scans: three known kinds of secret and a battery of randomness tests, in DataFrame functions only.

Known kinds are found by their patterns (KINDS). The method adds spans of kind `random`: runs of
`LEAST` or more characters of an encoding's alphabet which hold letters and digits. Each candidate's
encoding is inferred (the smallest alphabet that holds it), its characters become numbers, and three
tests are made of the hypothesis that they are drawn evenly and independently: chi-squared over the
alphabet, runs above and below the middle, and serial correlation of neighbours. Their p-values are
joined by Fisher's method.

Words and names fail those tests, keys pass them. How many must fail by chance depends on how many are
tested and how long they are, so both rates of false findings are controlled inside each stratum of
encoding and length: short runs, whose tests are weak, do not borrow from long ones.

* Of those that are found "not random", at most `RATE` may be keys (Benjamini and Hochberg).
* Of those that are kept as secrets, at most `RATE` may be words and names. Keys' p-values lie evenly, so
  those above one half, and one more for chance, tell how many keys there are above any other p (Storey).
  With few candidates the one more gives a candidate the benefit of the doubt.

A candidate is a secret if neither excludes it. p-values are counted in bins of 1/20 of a power of ten, so
a stratum's cut comes from a table of bounded size.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no secrets; a
candidate that a known kind's span overlaps is dropped, known spans stay as they are, also where they
overlap each other; repeated rows get equal results; an empty table gives an empty one. A kept column with the
name of a result (base_spans, all_spans) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, let

#: The known kinds in order, their patterns, and the characters that must be there.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
NAMES = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
#: Alphabets in the order in which they are tried.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
RATE = 0.05
BINS_A_POWER = 20
LAST_BIN = 30 * BINS_A_POWER
#: Bins below this one hold p-values above one half.
EVEN_BINS = 6
BLOCK = 64


def _prefix_sums(lengths: Column) -> Column:
    """Sum of the lengths before each one, in blocks: each block adds up those before it once, and its own."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
        return let(
            parts,
            lambda p: let(
                F.transform(p, total),
                lambda sums: F.flatten(
                    F.transform(
                        p,
                        lambda part, b: let(
                            total(F.slice(sums, 1, b)), lambda before: F.transform(part, lambda _, j: before + total(F.slice(part, 1, j)))
                        ),
                    )
                ),
            ),
        )

    return let(lengths, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(F.array().cast("array<long>")))


def spans_of(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end>>; with a group, those where it has LEAST_VALUE characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)  # the text between matches, so lengths give the offsets
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else m
        return let(
            F.transform(gaps, F.length),
            lambda g: let(
                F.transform(m, F.length),
                lambda n: let(
                    values,
                    lambda v: let(
                        _prefix_sums(F.zip_with(F.slice(g, 1, F.size(n)), n, lambda a, b: (a + b).cast("long"))),
                        lambda before: F.filter(
                            F.transform(
                                before,
                                lambda at, i: F.struct(
                                    (at + g[i]).alias("start"),
                                    F.lit(kind).alias("kind"),
                                    (at + g[i] + n[i]).alias("end"),
                                    m[i].alias("value"),
                                    F.length(v[i]).alias("width"),
                                ),
                            ),
                            lambda s: s["width"] >= (LEAST_VALUE if value_group else 0),
                        ),
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string,width:int>>")
    return F.coalesce(let(found, lambda m: F.when(F.size(m) > 0, placed(m))), none)


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def encoding_of(value: Column) -> Column:
    """Number of the first alphabet that holds the value (without padding); null if none does."""
    out = F.lit(None).cast("int")
    for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(F.length(F.translate(value, alphabet, "")) == 0, F.lit(i)).otherwise(out)
    return out


def tests_of(value: Column) -> Column:
    """struct<encoding, n, p_chi, p_runs, p_serial, p> of a candidate; p is Fisher's, of the three."""
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    tail = lambda xs: F.slice(xs, 2, F.size(xs))

    def told(body: Column, encoding: Column) -> Column:
        alphabet = alphabets[encoding]
        codes = F.transform(F.split(body, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(codes, lambda x: let(F.length(alphabet).cast("double"), lambda k: measured(x, k, encoding)))

    def measured(x: Column, k: Column, encoding: Column) -> Column:
        n = F.size(x).cast("double")
        squares = total(
            F.transform(F.array_distinct(x), lambda a: F.pow(F.size(F.filter(x, lambda b: a == b)).cast("double"), F.lit(2.0)))
        )
        free = k - 1.0
        ratio = F.greatest(squares * k / n - n, F.lit(0.0)) / free
        z_chi = (F.pow(ratio, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(2.0 / (9.0 * free))
        high = F.transform(x, lambda a: F.when(a >= k / 2.0, 1.0).otherwise(0.0))
        changes = total(F.transform(F.arrays_zip(high.alias("a"), tail(high).alias("b")), lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0)))
        parts = F.struct(total(high).alias("ones"), (changes + 1.0).alias("runs"), (total(x) / n).alias("mean"), z_chi.alias("z"))
        return let(parts, lambda s: joined_tests(x, n, s, encoding))

    def joined_tests(x: Column, n: Column, s: Column, encoding: Column) -> Column:
        expected = 2.0 * s["ones"] * (n - s["ones"]) / n + 1.0
        spread = (expected - 1.0) * (expected - 2.0) / (n - 1.0)
        z_runs = F.when(spread > 0, (s["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-12)))).otherwise(8.0)
        off = F.transform(x, lambda a: a - s["mean"])
        square = total(F.transform(off, lambda a: a * a))
        product = total(F.transform(F.arrays_zip(off.alias("a"), tail(off).alias("b")), lambda p: p["a"] * F.coalesce(p["b"], F.lit(0.0))))
        z_serial = F.when(square > 0, (product / F.greatest(square, F.lit(1e-12)) * n + 1.0) / F.sqrt(n)).otherwise(8.0)
        ps = F.array(
            _upper_tail(s["z"]),
            F.least(F.lit(1.0), 2.0 * _upper_tail(F.abs(z_runs))),
            F.least(F.lit(1.0), 2.0 * _upper_tail(F.abs(z_serial))),
        )

        def fisher(p: Column) -> Column:
            half = -total(F.transform(p, lambda a: F.ln(F.greatest(a, F.lit(1e-300)))))
            return let(
                half,
                lambda h: F.struct(
                    encoding.alias("encoding"),
                    n.alias("n"),
                    p[0].alias("p_chi"),
                    p[1].alias("p_runs"),
                    p[2].alias("p_serial"),
                    F.least(F.lit(1.0), F.exp(-h) * (1.0 + h + h * h / 2.0)).alias("p"),
                ),
            )

        return let(ps, fisher)

    body = F.regexp_replace(value, "=+$", "")
    return let(body, lambda b: let(encoding_of(b), lambda e: F.when(e.isNotNull(), told(b, e))))


def stratum_of(encoding: Column, n: Column) -> Column:
    """Encoding and length band (powers of the square root of two, the last one open)."""
    return (encoding * 100 + F.least(F.floor(2.0 * F.log2(n)), F.lit(24))).cast("int")


def bin_of(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_A_POWER), F.lit(LAST_BIN)).cast("int")


def candidates_of(text: Column) -> Column:
    """array<struct<start, kind, end, stratum, bin>> of the runs that have an encoding."""

    def judged(found: Column) -> Column:
        return F.transform(
            found,
            lambda s: let(
                tests_of(s["value"]),
                lambda t: F.struct(
                    s["start"].alias("start"),
                    F.lit(3).alias("kind"),
                    s["end"].alias("end"),
                    stratum_of(t["encoding"], t["n"]).alias("stratum"),
                    bin_of(t["p"]).alias("bin"),
                ),
            ),
        )

    return F.filter(judged(spans_of(text, CANDIDATE, 3)), lambda s: s["stratum"].isNotNull())


def cuts(tested: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each stratum the first bin that is no secret.

    tested: (stratum, bin), a row for each candidate. Not random are the bins from the lowest one whose upper
    p-value is within rate * rank / tests, ranks counted from the smallest p-values. Secrets are the bins up to
    the highest one up to which 1 - rate of the candidates are accounted for by evenly spread p-values.
    """
    binned = tested.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("held"))
    all_bins = Window.partitionBy("stratum")
    smaller = all_bins.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    larger = all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = lambda b: F.pow(F.lit(10.0), -b / float(BINS_A_POWER))
    even = F.sum(F.when(F.col("bin") < EVEN_BINS, F.col("held")).otherwise(0)).over(all_bins)
    ranked = binned.select(
        "stratum",
        "bin",
        (edge(F.col("bin")) <= rate * F.sum("held").over(smaller) / F.sum("held").over(all_bins)).alias("not_random"),
        ((even + 1) / (1.0 - edge(F.lit(EVEN_BINS))) * (1.0 - edge(F.col("bin") + 1)) >= (1.0 - rate) * F.sum("held").over(larger)).alias(
            "accounted"
        ),
    )
    limits = ranked.groupBy("stratum").agg(
        F.least(
            F.coalesce(F.min(F.when(F.col("not_random"), F.col("bin"))), F.lit(LAST_BIN + 1)),
            F.coalesce(F.max(F.when(F.col("accounted"), F.col("bin"))), F.lit(-1)) + 1,
        ).alias("cut")
    )
    return {r["stratum"]: r["cut"] for r in limits.collect()}  # a row for each stratum: 200 at most


def with_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and candidates to each row; no verdict on the candidates yet."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.concat(bare(spans_of(body, ASSIGN, 0, 2)), bare(spans_of(body, ACCESS, 1)), bare(spans_of(body, HEX, 2)))
    return docs.withColumn("base_spans", F.array_sort(base)).withColumn("candidates", candidates_of(body))


def with_verdicts(found: DataFrame) -> DataFrame:
    """Replace candidates by all_spans: base spans and the candidates that pass, in order."""
    limits = cuts(found.select(F.explode("candidates").alias("c")).select("c.stratum", "c.bin"))
    cut = F.lit(None).cast("int")
    if limits:
        cut = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    passes = (lambda s: F.coalesce(s["bin"] < F.try_element_at(cut, s["stratum"]), F.lit(True))) if limits else (lambda s: F.lit(True))
    apart = lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.transform(
        F.filter("candidates", lambda s: passes(s) & apart(s)),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", added))).drop("candidates")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of each row with base_spans and all_spans. Texts are read once: findings are written down."""
    body, row = fresh(docs, "secret_body", "secret_row")
    kept = [c for c in dict.fromkeys(keep) if c not in ("base_spans", "all_spans")]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias(row), docs[text].alias(body))
    found = with_verdicts(checkpointed(with_findings(rows, body).drop(body)))
    return found.select(*[F.col(row)[c].alias(c) for c in kept], "base_spans", "all_spans")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of a secret in `text` replaced by `mark`; overlapping spans are one. All rows stay."""
    body, row = fresh(docs, "secret_body", "secret_source")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), docs[text].alias(body))
    found = with_verdicts(with_findings(rows, body))
    merged = F.aggregate(
        "all_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.array_append(
                    F.array_append(acc["parts"], F.substring(F.col(body), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))),
                    F.lit(mark),
                ).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(body), (acc["at"] + 1).cast("int"), F.length(body))),
    )
    cleaned = F.when(F.size("all_spans") > 0, merged).otherwise(F.col(body))
    return found.withColumn(body, cleaned).select(
        *[F.col(body).alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns]
    )
