"""Judge URLs by rules and, where none fits, by gradient-boosted trees on lexical features; DataFrame functions only.

A rule names a host and a path; it fits URLs of that host or a subdomain whose path starts with the rule's, and the
longest rule that fits decides. URLs that a rule decides are the labelled ones that the trees learn from, so the trees
carry the rules' taste over to URLs that none covers.

Features: lengths, labels and hyphens of the host, depth, digit ratio, entropy of the characters, number of parameters,
and suffix statistics (the share of blocked labelled URLs by last label and by last two labels of the host, drawn to one
half; a labelled URL takes them from the half of the sample that it isn't in). Values are cut into bins half way
between quantiles of the sample. Both labels have the same total weight.

Trees are oblivious (one cut a level), so a tree is a few comparisons and a look-up in an array, and the whole model is
one expression inside the scan of the URLs. Each level is one Spark job: gradients and curvatures, as whole numbers so
that sums don't depend on order, are added up by leaf, feature and bin; what comes to the driver is that histogram, whose
size is fixed. The trees are fitted on a sample of about `SAMPLE` labelled URLs, chosen by a digest of URL and id; rules
and verdicts cover every row.

Defined results: null URLs and URLs without `://` have empty host and path, no rule and the model's verdict; an empty
path fits no rule, as rules' paths start with a slash; a host holds user and port if there are any, and is no subdomain
of a rule's then unless it ends with it; repeated rows are judged alike; without labelled URLs, or with one label only,
the trees are empty and the smoothed share decides, `allow` on a tie; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, let

#: Fixed values: (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labelled URLs that the trees are fitted on, about.
SAMPLE = 20_000
TREES = 12
DEPTH = 3
BINS = 16
RATE = 0.3
#: Gradients, curvatures and scores are whole numbers of this fraction.
UNIT = 1 << 20
#: Curvature added to each leaf.
RIDGE = 1.0
#: Labelled URLs that one half counts for in a suffix statistic.
PRIOR = 10.0
#: Partitions of the sample.
SAMPLE_PARTS = 8

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "host_labels", "host_hyphens", "depth", "digit_ratio", "entropy", "parameters", "last_label", "last_labels")


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(size, rule, verdict) of the longest rule that fits, else null; rules are looked up by the host's last labels."""
    by_site: dict[str, list] = {}
    for verdict, rule in rules:
        site, slash, rest = rule.partition("/")
        held = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest).alias("path"))
        by_site.setdefault(site, []).append(held)
    known = F.create_map(*[c for site, held in by_site.items() for c in (F.lit(site), F.array(*held))])
    none = F.filter(F.array(known[next(iter(by_site))][0]), lambda r: F.lit(False))
    near = [F.coalesce(F.try_element_at(known, suffix_of(host, n)), none) for n in sorted({site.count(".") + 1 for site in by_site})]
    return F.array_max(F.filter(F.concat(*near), lambda r: path.startswith(r["path"])))


def entropy_of(text: Column) -> Column:
    """Bits a character, from the runs of the sorted characters; 0 for an empty text."""
    size = F.length(text).cast("double")
    chars = F.array_sort(F.split(text, ""))
    bits = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).cast("double").alias("total"))

    def step(now: Column, char: Column) -> Column:
        same = now["last"].eqNullSafe(char)
        return F.struct(
            char.alias("last"),
            F.when(same, now["run"] + 1).otherwise(1).alias("run"),
            F.when(same, now["total"]).otherwise(now["total"] + bits(now["run"])).alias("total"),
        )

    total = F.aggregate(chars, start, step, lambda now: now["total"] + bits(now["run"]))
    return F.when(size > 0, F.round(F.log2(size) - total / size, 9)).otherwise(0.0)


def suffix_of(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that a URL has by itself."""
    whole = F.coalesce(url, F.lit(""))
    size = F.length(whole)
    query = F.regexp_extract(_rest(whole), r"^[^?#]*\?([^#]*)", 1)
    counted = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
    return {
        "length": size.cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": counted(host, ".") + F.when(host == "", 0.0).otherwise(1.0),
        "host_hyphens": counted(host, "-"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": F.when(size > 0, F.regexp_count(whole, F.lit("[0-9]")) / size).otherwise(0.0),
        "entropy": entropy_of(whole),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
    }


@dataclass(frozen=True)
class Model:
    """Suffix statistics, the bins' upper edges by feature, the score to start from, and trees of cuts and leaves."""

    suffixes: DataFrame
    share: float  # of blocked labelled URLs, by weight
    edges: dict[str, list[float]]
    start: int = 0
    trees: list[tuple[list[tuple[int, int]], list[int]]] = field(default_factory=list)


def _shares(rows: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Smoothed share of blocked weight by suffix and `keys`; a row for each suffix in the sample."""
    each = rows.select(*keys, "y", "w", F.explode(F.array(*[F.struct(F.lit(n).alias("labels"), suffix_of(F.col("host"), n).alias("suffix")) for n in (1, 2)])).alias("s"))
    sums = each.groupBy(*keys, "s.labels", "s.suffix").agg(F.sum(F.col("y") * F.col("w")).alias("bad"), F.sum("w").alias("all"))
    rate = (F.col("bad") / UNIT + PRIOR * share) / (F.col("all") / UNIT + PRIOR)
    return sums.withColumn("rate", F.round(rate, 9)).drop("bad", "all")


def _with_shares(rows: DataFrame, shares: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Add last_label and last_labels; suffixes that the sample doesn't have take the share of all (one half)."""
    for labels, name in ((1, "last_label"), (2, "last_labels")):
        own, rate = fresh(rows, f"suffix_{labels}", f"rate_{labels}")
        part = shares.where(F.col("labels") == labels).select(*keys, F.col("suffix").alias(own), F.col("rate").alias(rate))
        joined = rows.withColumn(own, suffix_of(F.col("host"), labels)).join(F.broadcast(part), [*keys, own], "left")  # at most the sample's rows
        rows = joined.withColumn(name, F.coalesce(rate, F.lit(share))).drop(own, rate)
    return rows


def _binned(rows: DataFrame, edges: dict[str, list[float]]) -> Column:
    """The bin of each feature: how many edges lie below the value."""
    return F.array(*[sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)) for f in FEATURES])


def _leaf(bins: Column, cuts: list[tuple[int, int]]) -> Column:
    return sum((F.when(bins[f] > cut, 1 << i).otherwise(0) for i, (f, cut) in enumerate(cuts)), F.lit(0))


def _score(bins: Column, start: int, trees: list) -> Column:
    """The log odds of `block` in units, a whole number."""
    leaves = (F.array(*[F.lit(v) for v in values])[_leaf(bins, cuts)] for cuts, values in trees)
    return sum(leaves, F.lit(start)).cast("long")


def chance(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score.cast("double") / UNIT))


def _sampled(urls: DataFrame, size: int) -> DataFrame:
    """About `size` labelled URLs by a digest of URL and id, all if there are fewer: (host, path, url, y, half)."""
    found = urls.where(F.col("found").isNotNull())
    held = found.count()
    digest = F.xxhash64("url", "ident")
    if held > size:
        found = found.where(F.pmod(digest, F.lit(1 << 32)) < int(size / held * (1 << 32)))
    rows = found.select("url", "ident", "host", "path", F.when(F.col("found.verdict") == "block", 1).otherwise(0).alias("y")).distinct()
    rows = rows.withColumn("half", F.pmod(F.xxhash64(digest), F.lit(2)).cast("int"))
    return checkpointed(rows.repartition(SAMPLE_PARTS, "url", "ident"))


def _best_cut(cells: dict, leaves: int, edges: dict[str, list[float]]) -> tuple[int, int] | None:
    """The cut with the largest gain over all leaves; the first of equal ones."""
    best, most = None, 1e-9
    part = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    for f, name in enumerate(FEATURES):
        for cut in range(len(edges[name])):
            gain = 0.0
            for leaf in range(leaves):
                bins = [cells.get((leaf, f, b), (0, 0)) for b in range(len(edges[name]) + 1)]
                (gl, hl), (gr, hr) = (tuple(map(sum, zip((0, 0), *side))) for side in (bins[: cut + 1], bins[cut + 1 :]))
                gain += part(gl, hl) + part(gr, hr) - part(gl + gr, hl + hr)
            if gain > most + 1e-9:
                best, most = (f, cut), gain
    return best


def _tree(sample: DataFrame, trees: list, edges: dict[str, list[float]], depth: int) -> tuple[list, list] | None:
    """One more tree on the gradients that `trees` leave; a job for each level."""
    p = chance(_score(F.col("bins"), 0, trees))
    graded = sample.select("bins", F.round((F.col("y") - p) * F.col("w")).cast("long").alias("g"), F.round(p * (1 - p) * F.col("w")).cast("long").alias("h"))
    cuts: list[tuple[int, int]] = []
    told: dict = {}
    while len(cuts) < depth:
        each = graded.select(_leaf(F.col("bins"), cuts).alias("leaf"), "g", "h", F.posexplode("bins").alias("f", "bin"))
        sums = each.groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        cells = {(r["leaf"], r["f"], r["bin"]): (r["g"], r["h"]) for r in sums.collect()}  # leaves x features x bins
        cut = _best_cut(cells, 1 << len(cuts), edges)
        if cut is None:
            break
        cuts.append(cut)
        told = cells
    if not cuts:
        return None
    last, edge = cuts[-1]
    sides = [[0, 0] for _ in range(1 << len(cuts))]  # the last histogram tells both sides of the last cut
    for (leaf, f, b), (g, h) in told.items():
        if f == last:
            side = sides[leaf | int(b > edge) << (len(cuts) - 1)]
            side[0] += g
            side[1] += h
    return cuts, [round(RATE * (g / UNIT) / (h / UNIT + RIDGE) * UNIT) for g, h in sides]


def train(urls: DataFrame, size: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Trees from (url, ident, host, path, found), where `found` is the rule's (rule, verdict) or null."""
    sample = _sampled(urls, size)
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < bad < n:
        share = (bad + 0.5) / (n + 1)
        suffixes = checkpointed(_shares(sample.withColumn("w", F.lit(UNIT)), share, []))
        return Model(suffixes, share, {f: [] for f in FEATURES}, round(math.log(share / (1 - share)) * UNIT))
    # Both labels weigh as much: how many URLs the rules block says nothing of those that none covers.
    share, weight = 0.5, F.when(F.col("y") == 1, round(UNIT * n / (2 * bad))).otherwise(round(UNIT * n / (2 * (n - bad))))
    sample = sample.withColumn("w", weight.cast("long"))
    suffixes = checkpointed(_shares(sample, share, []))
    others = _shares(sample, share, ["half"]).withColumn("half", 1 - F.col("half"))
    rows = _with_shares(sample, others, share, ["half"]).withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    rows = checkpointed(rows.select("y", "w", *FEATURES))
    places = [i / BINS for i in range(BINS + 1)]
    found = rows.agg(*[F.percentile(f, F.array(*map(F.lit, places))).alias(f) for f in FEATURES]).first()
    edges = {f: [(a + b) / 2 for a, b in pairwise(sorted(set(found[f])))] for f in FEATURES}
    binned = checkpointed(rows.select("y", "w", _binned(rows, edges).alias("bins")))
    grown: list = []
    for _ in range(trees):
        tree = _tree(binned, grown, edges, depth)
        if tree is None:
            break
        grown.append(tree)
    return Model(suffixes, share, edges, trees=grown)


def scored(urls: DataFrame, model: Model) -> DataFrame:
    """Add `score`, the chance of `block`, to (url, host, path, ...)."""
    rows = _with_shares(urls, model.suffixes, model.share, []).withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    score = let(_binned(rows, model.edges), lambda bins: _score(bins, model.start, model.trees))
    return rows.withColumn("score", score).drop(*FEATURES)


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES, size: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_chance) for each row."""
    rows = pages.select(F.col(ident).alias("ident"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    told = scored(rows, train(rows, size))
    return told.select(
        F.col("ident").alias("page_id"),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        F.round(chance(F.col("score")), 6).alias("block_chance"),
    )
