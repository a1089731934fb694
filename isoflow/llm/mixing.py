"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source, targets are filled up by weight under a cap of repetitions, and
each document is emitted floor(rate) times plus one Bernoulli copy whose probability is the
fraction of the rate.  The coin of a document comes from the MD5 of its id, so every rerun
draws the same coins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoflow.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_RATE = 2.0


def word_count(text):
    """Maximal runs of characters other than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id):
    """A number from 0 to below 1, evenly spread and fixed by the id: the first 52 bits of its MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources by code point, null last, get the weights in turn.  With the level of a source being
    its cap over its weight, filling by weight stops sources in the order of their levels; the
    common level of those not stopped is found from running sums over the sources.  The windows
    run over one row per source, not over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        per_source.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("common", (F.col("budget") - F.col("stopped")) / F.col("open"))
        .withColumn("place", F.row_number().over(by_level))
    )
    first = F.min(F.when(F.col("level") >= F.col("common"), F.struct("place", "common"))).over(everything)
    return filled.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.least(F.col("cap"), F.coalesce(first["common"], F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


SMALL = 10_000
"""Sources up to which the table of sources is broadcast."""


def _hint(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.limit(SMALL + 1).count() <= SMALL else sources


def mixing_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``source, source_size, target, rate`` of every source."""
    sizes = docs.select(docs[source].alias("source"), word_count(docs[text]).alias("size"))
    targets = materialize(source_targets(sizes, weights, share, max_rate), "targets")
    return targets.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def with_copies(rows: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``rows`` with the columns of ``plan`` except ``source`` and ``copies``, how often the document is emitted."""
    plan = plan.withColumnRenamed("source", "_source")
    joined = rows.join(_hint(plan), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    extra = F.when(coin(F.col(doc_id)) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("copies", (F.floor("rate") + extra).cast("int"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, text: str = "text",
    doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for every input row.

    A null text has size 0; a document of size 0 is given rate and copies of its source but takes
    no words.  A source without words has rate 0.  A null source is a source of its own, the last.
    Repeated rows are documents of their own that share one coin; null ids share one coin too.
    An empty table gives an empty result.  Only the three named columns are read.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"))
    plan = mixing_plan(docs, weights, share, max_rate, text, source)
    return with_copies(narrow, plan).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def emit(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, text: str = "text",
    doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken, with their own columns.

    The cases of :func:`mix` hold: null texts, sources and ids, repeated rows and empty tables; columns
    of any name are kept as they are.
    """
    plan = mixing_plan(docs, weights, share, max_rate, text, source).select("source", "rate")
    own = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = docs.select(own, docs[doc_id].alias("_id"), docs[source].alias("_from"))
    taken = with_copies(rows, plan, "_id", "_from").where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':mix')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), f AS (
  SELECT *, row_number() OVER w AS place,
    (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS common
  FROM l WINDOW w AS (ORDER BY level, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT min_by(common, place) FROM f WHERE level >= common), 'inf'::DOUBLE) * weight) AS target FROM f
), r AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
