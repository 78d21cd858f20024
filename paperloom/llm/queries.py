"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table as _table
from . import hostrules, htmlcrf, importance, licenses, mixing, pieces, secrets, sharding, simhash, substrings, urlfilter, vectorcodes, winnowing


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(_table(spark, sf_dir, "documents"))


def op2_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.verdicts(_table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "soft_failed",
        F.round("host_rate", 9).alias("host_rate"),
        "host_verdict",
    )


#: Words, rules and the beta prior again; a list of words for each text, windows by position.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
pos AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM pos) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
base AS (
  SELECT w.doc_id, source, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.1::DOUBLE * n_words AS soft_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM f GROUP BY source),
moments AS (
  SELECT sum(bad) / sum(n) AS m, sum(n) AS docs, sum(n) - sum(n * n) / sum(n) AS spare, count(*) AS k,
         sum(bad * bad / n) - sum(n) * (sum(bad) / sum(n)) ** 2 AS squares FROM hosts),
prior AS (
  SELECT m, CASE WHEN squares - (k - 1) * m * (1 - m) > 0 AND spare > 0
    THEN least(greatest(m * (1 - m) / ((squares - (k - 1) * m * (1 - m)) / spare) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s
  FROM moments),
shrunk AS (SELECT source, n + s AS weight, (bad + m * s) / (n + s) AS rate FROM hosts CROSS JOIN prior),
judged AS (
  SELECT source, rate, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.8 THEN 'rejected'
    WHEN rate * 20 > 1 - rate THEN 'strict' ELSE 'trusted' END AS verdict FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND verdict <> 'rejected' AND (verdict = 'trusted' OR NOT soft_failed) AS kept,
       soft_failed, round(rate, 9) AS host_rate, verdict AS host_verdict
FROM f JOIN judged ON f.source IS NOT DISTINCT FROM judged.source
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("n_copies") * F.col("size")).alias("taken"),
        "n_copies",
    )


#: The level of the shares from the sources in order of cap over weight; places by bucket, size and id.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ((doc_id % 65537) * 40502 + doc_id % 65521)
           % greatest(256, CAST(2 ** ceil(log2(ceil((SELECT count(*) FROM documents) / 20000))) AS BIGINT)) AS bucket
  FROM documents),
s AS (
  SELECT key, sum(size) AS source_size,
         CAST([5, 2, 1][1 + ((row_number() OVER (ORDER BY encode(key)) - 1) % 3)] AS DOUBLE) AS weight
  FROM d GROUP BY key),
c AS (
  SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS share,
         coalesce(sum(2.0 * source_size) OVER r, 0) AS below, sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS free
  FROM s WINDOW r AS (ORDER BY 2.0 * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((share - below) / free, cap / weight) FILTER ((share - below) / free <= cap / weight) AS level FROM c),
t AS (SELECT key, source_size, least(cap, level * weight) AS target FROM c CROSS JOIN l),
p AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies,
         row_number() OVER (PARTITION BY d.key ORDER BY bucket, size, doc_id) AS place,
         CAST('0x' || substr(md5('mix-1|' || d.key), 1, 8) AS BIGINT) / 4294967296.0 AS start
  FROM d JOIN t USING (key))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(floor(place * copies + start) - floor((place - 1) * copies + start) AS BIGINT) AS n_copies,
       CAST(floor(place * copies + start) - floor((place - 1) * copies + start) AS BIGINT) * size AS taken
FROM p
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


#: All windows as text; the smallest document of each; the words that later ones cover.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM late)),
g AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
         list_select(words, list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(ps, p))) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), ["doc_id"])
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(secrets.spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("all_spans")).alias("spans"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_htmlcrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(_table(spark, sf_dir, "pages"))


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(_table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """All distances of all parts to all entries by dot products, round by round."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT vec_id, part, w, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (
    SELECT vec_id, p.part, p.w, b.e,
           CAST(list_dot_product(p.w, p.w) - 2 * list_dot_product(p.w, b.c) + list_dot_product(b.c, b.c) AS BIGINT) AS d
    FROM p JOIN b{r} b ON b.part = p.part) GROUP BY ALL)"""
    updated = """
b{n} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT part, e, list(floor(s / n) ORDER BY i) AS c FROM (
      SELECT part, e, i, sum(w[i]) AS s, count(*) AS n FROM a{r}, range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL) m
    ON m.part = b.part AND m.e = b.e)"""
    rounds = vectorcodes.ROUNDS
    steps = ",".join(nearest.format(r=r) + "," + updated.format(r=r, n=r + 1) for r in range(rounds)) + "," + nearest.format(r=rounds)
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[16 * part + 1:16 * part + 16] AS w FROM k, range(4) t(part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, w AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),{steps},
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN k USING (vec_id) CROSS JOIN books
"""


def op12_urltrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Features as text; the CRC of each different one byte by byte, by the table that its polynomial gives.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT kind, id, unnest(words) AS feature FROM w
  UNION ALL
  SELECT kind, id, words[i] || ' ' || words[i + 1] FROM (SELECT kind, id, words, unnest(range(1, len(words))) AS i FROM w)),
each AS (SELECT kind, id, feature, count(*) AS n FROM f GROUP BY ALL),
hashed AS (
  SELECT feature, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM each)) CROSS JOIN crc),
bucketed AS (SELECT kind, id, bucket, sum(n) AS n FROM each JOIN hashed USING (feature) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM bucketed GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))::DOUBLE)) AS BIGINT) AS gain
  FROM sums),
means AS (
  SELECT id AS doc_id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features
  FROM bucketed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) >= 20 AS able,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN means ON means.doc_id = w.id WHERE kind = 'd'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_hostrules": op2_hostrules,
    "op3_simhash": op3_simhash,
    "op4_htmlcrf": op4_htmlcrf,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_licenses": op7_licenses,
    "op8_sharding": op8_sharding,
    "op9_secrets": op9_secrets,
    "op10_pieces": op10_pieces,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_urltrees": op12_urltrees,
    "op13_importance": op13_importance,
}
ORACLE_SQL: dict[str, str] = {"op2_hostrules": OP2_SQL, "op5_mixing": OP5_SQL, "op6_substrings": OP6_SQL, "op11_vectorcodes": _op11_sql(), "op13_importance": OP13_SQL}
