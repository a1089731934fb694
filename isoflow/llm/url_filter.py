"""URL rules behind a blocked Bloom filter, in DataFrame operations only.

The listed canonical URLs (host and path prefix) are hashed into a blocked Bloom filter: a key
sets its bits inside one 256-bit block, kept as four longs.  Each distinct host and path offers one
candidate key for each of its host suffixes on a label border and each length of path that the list
holds beneath that suffix.  Candidates whose bits are all set are possible hits; an exact join on the
key removes the false positives, and the longest listed key that remains decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4
BITS_PER_KEY = 16
BROADCAST_KEYS = 100_000
"""Listed keys up to which filter and list are broadcast; beyond, both joins are shuffle joins."""


def host_and_path(url):
    """``(host, path)``: after the first ``://``; null urls and those without it give two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def _block(key, n_blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _positions(key) -> list:
    bits = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(HASHES)]


def blocked_bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """``block, w0, w1, w2, w3``: one row for each block in which column ``key`` sets a bit."""
    ones = keys.select(_block(F.col("key"), n_blocks).alias("block"), F.explode(F.array(*_positions(F.col("key")))).alias("bit"))
    word = F.shiftright("bit", 6)
    mask = F.expr("shiftleft(1L, bit & 63)")
    return ones.groupBy("block").agg(*[F.bit_or(F.when(word == w, mask).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(4)])


def _all_set(key):
    test = F.lit(True)
    words = F.array("w0", "w1", "w2", "w3")
    for p in _positions(key):
        test = test & (F.expr("0L") != F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)))))
    return test


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains when the path
    of the url starts with the rule's; the longest rule (host plus path) wins, ties go to the
    longer host, then to the smaller verdict string.  Without a rule the url is not listed and
    gets ``default``.  Repeated rows are judged one by one; a null or broken url has an empty host
    and path and fits no rule (rules with an empty host are ignored).  Empty tables give empty
    results, and an empty list lists nothing.  Only the two named columns are read.
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").where("r_host <> ''")
    listed = listed.groupBy("r_host", "r_path").agg(F.min("verdict").alias("r_verdict")).withColumn("key", F.concat("r_host", F.lit(" "), "r_path"))
    n_keys, deepest = listed.agg(F.count(F.lit(1)), F.max(F.size(F.split("r_host", "\\.")))).first()
    n_blocks = max(1, n_keys * BITS_PER_KEY // 256)
    bloom = blocked_bloom(listed, n_blocks)
    hint = F.broadcast if n_keys <= BROADCAST_KEYS else (lambda df: df)
    lengths = listed.groupBy(F.col("r_host").alias("suffix")).agg(F.collect_set(F.length("r_path")).alias("p_lengths"))  # at most one number for each length of path

    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - (deepest or 1) + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    under = judged.select("host", "path", F.explode(suffixes).alias("suffix")).join(hint(lengths), "suffix")
    offered = under.select("host", "path", "suffix", F.explode("p_lengths").alias("p")).where(F.length("path") >= F.col("p"))
    offered = offered.select("host", "path", F.concat("suffix", F.lit(" "), F.substring("path", F.lit(1), F.col("p"))).alias("offer")).withColumn("block", _block(F.col("offer"), n_blocks))
    possible = offered.join(hint(bloom), "block").where(_all_set(F.col("offer"))).select("host", "path", "offer")
    hits = possible.join(hint(listed), F.col("offer") == F.col("key"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("best"))
    found = rows.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP5_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), p AS (
  SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
