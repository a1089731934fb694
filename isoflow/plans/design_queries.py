"""Queries of the design, transcriptome, model and read operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoflow.functions import keys as N
from isoflow.operators import contrasts as K
from isoflow.operators import designs as D
from isoflow.operators import models as M
from isoflow.operators import psi as P
from isoflow.operators import reads as R
from isoflow.operators import sequences as S
from isoflow.plans import derive
from isoflow.plans.base import MEANS_CTE, PSI_CTE, ctes, pieces_cte, query, rounded
from isoflow.plans.count_queries import counts, means, psi_table
from isoflow.plans.sequence_queries import pieces
from isoflow.sources.scratch import written

_REGIONS = ctes("sequences") + pieces_cte(170) + """, r AS (SELECT doc_id, piece, seq AS z, CAST(doc_id % 7 - 3 AS INT) AS up_off, CAST(doc_id % 5 - 2 AS INT) AS down_off, least(len(seq), 60) AS a0, least(len(seq), 110) AS b0 FROM pieces),
 w AS (SELECT *, a0 + up_off AS a, b0 + down_off AS b, len(z) AS n, a0 + up_off >= 0 AND b0 + down_off >= a0 + up_off AND b0 + down_off <= len(z) AS fits FROM r),
 v AS (SELECT doc_id, piece, CASE WHEN fits THEN substr(z, 1, a) END AS adj_up, CASE WHEN fits THEN substr(z, a + 1, b - a) END AS adj_exon, CASE WHEN fits THEN substr(z, b + 1, n - b) END AS adj_down FROM w)"""


def regions(spark, d):
    """Consecutive windows of 170 bases as intron, exon and intron; a last, shorter one has its later regions cut."""
    offsets = [(F.col("doc_id") % 7 - 3).cast("int").alias("up_off"), (F.col("doc_id") % 5 - 2).cast("int").alias("down_off")]
    part = lambda at, n, name: F.substring("seq", at, n).alias(name)
    return pieces(spark, d, 170).select("doc_id", "window", *offsets, part(1, 60, "up_intron"), part(61, 50, "exon"), part(111, 60, "down_intron"))


@query(_REGIONS + ' SELECT doc_id, piece AS "window", adj_up, adj_exon, adj_down FROM v')
def adjusted_regions(spark, d):
    return D.adjusted_regions(regions(spark, d)).select("doc_id", "window", "adj_up", "adj_exon", "adj_down")


@query(_REGIONS + """, m AS (SELECT doc_id, piece, concat(right(adj_up, 20), left(adj_exon, 3)) AS t, concat(right(adj_exon, 3), left(adj_down, 6)) AS f FROM v)
 SELECT doc_id, piece AS "window", CASE WHEN len(t) = 23 THEN t END AS motif_3ss, CASE WHEN len(f) = 9 THEN f END AS motif_5ss FROM m""")
def splice_motifs(spark, d):
    return D.splice_motifs(D.adjusted_regions(regions(spark, d))).select("doc_id", "window", "motif_3ss", "motif_5ss")


COORDINATES = """SELECT l_orderkey AS event, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, l_partkey * 10 AS upstreamEE, l_partkey * 10 + l_suppkey AS exonStart_0base,
 l_partkey * 10 + l_suppkey + CAST(l_quantity AS BIGINT) AS exonEnd, l_partkey * 10 + l_suppkey + CAST(l_quantity AS BIGINT) + l_linenumber * 7 AS downstreamES, l_linenumber AS line FROM {lineitem}"""
_COORD = f"WITH c AS ({derive.sql(COORDINATES)})"


@query(_COORD + """ SELECT DISTINCT feature, length FROM (SELECT unnest([{'feature': 'exon', 'length': exonEnd - exonStart_0base}, {'feature': 'upstream_intron', 'length': exonStart_0base - upstreamEE}, {'feature': 'downstream_intron', 'length': downstreamES - exonEnd}], recursive := true) FROM c)""")
def feature_lengths(spark, d):
    return D.feature_lengths(derive.load(spark, d, COORDINATES))


@query(_COORD + """ SELECT event, line, exonEnd - exonStart_0base AS exon_length, CASE WHEN strand = '-' THEN downstreamES - exonEnd ELSE exonStart_0base - upstreamEE END AS up_intron, CASE WHEN strand = '-' THEN exonStart_0base - upstreamEE ELSE downstreamES - exonEnd END AS down_intron FROM c""")
def strand_coordinates(spark, d):
    return N.strand_coordinates(derive.load(spark, d, COORDINATES)).select("event", "line", "exon_length", "up_intron", "down_intron")


_DESIGN = """, dz AS (SELECT condition, event AS design, concat('P', substr(event, 7, 1)) AS parent, CASE WHEN event LIKE '%1' THEN 'up' ELSE 'down' END AS category, psi FROM means),
 par AS (SELECT condition, parent, avg(psi) AS parent_psi FROM dz GROUP BY ALL),
 dp AS (SELECT dz.*, parent_psi, CASE category WHEN 'up' THEN parent_psi <= 0.5 ELSE parent_psi >= 0.45 END AS start_ok, CASE category WHEN 'up' THEN psi >= 0.5 ELSE psi <= 0.5 END AS end_ok FROM dz JOIN par USING (condition, parent))"""


def designs(spark, d):
    m = means(spark, d)
    return m.select("condition", F.col("event").alias("design"), F.concat(F.lit("P"), F.substring("event", 7, 1)).alias("parent"), F.when(F.col("event").like("%1"), "up").otherwise("down").alias("category"), "psi")


def passed(spark, d):
    z = designs(spark, d)
    parents = z.groupBy("condition", "parent").agg(F.avg("psi").alias("psi"))
    rules = spark.createDataFrame([("up", 0.0, 0.5, 0.5, 1.0), ("down", 0.45, 1.0, 0.0, 0.5)], "category string, start_low double, start_high double, end_low double, end_high double")
    return D.design_pass(z, parents, rules)


@query(ctes("psi_counts") + MEANS_CTE + _DESIGN + " SELECT condition, design, parent, category, round(psi, 6) AS psi, round(parent_psi, 6) AS parent_psi, start_ok, end_ok, start_ok AND end_ok AS correct FROM dp")
def design_pass(spark, d):
    return rounded(passed(spark, d))


@query(ctes("psi_counts") + MEANS_CTE + _DESIGN + ", e AS (SELECT condition, category, avg(end_ok::INT) AS share FROM dp WHERE start_ok GROUP BY ALL) SELECT category, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, count(*) AS n FROM e GROUP BY category")
def design_accuracy(spark, d):
    return rounded(D.design_accuracy(passed(spark, d)))


@query(ctes("psi_counts") + MEANS_CTE + """, p AS (SELECT n_name AS name, n_nationkey AS one, (n_nationkey + 7) % 25 AS two FROM nation)
 SELECT name, a.event AS design, round(a.psi, 6) AS psi1, round(b.psi, 6) AS psi2, round(a.psi - b.psi, 6) AS diff, round(a.psi / b.psi, 6) AS fold FROM p JOIN means a ON a.condition = one JOIN means b ON b.condition = two AND b.event = a.event""")
def design_contrast(spark, d):
    pairs = derive.load(spark, d, "SELECT n_name AS name, n_nationkey AS one, (n_nationkey + 7) % 25 AS two FROM {nation}")
    return rounded(D.design_contrast(designs(spark, d), pairs))


@query(ctes("counts") + """, s AS (SELECT idx, up_off, down_off, CAST(coalesce(sum(cnt) FILTER (condition = 1), 0) AS BIGINT) AS n1, CAST(coalesce(sum(cnt) FILTER (condition = 2), 0) AS BIGINT) AS n2 FROM counts WHERE mode = 'INCLUDED' AND condition IN (1, 2) GROUP BY ALL),
 t AS (SELECT *, sum(n1) OVER (PARTITION BY idx) AS t1, sum(n2) OVER (PARTITION BY idx) AS t2 FROM s), u AS (SELECT *, CAST(n1 * 1000 // t1 AS BIGINT) AS scaled1, CAST(n2 * 1000 // t2 AS BIGINT) AS scaled2 FROM t WHERE t1 > 0 AND t2 > 0)
 SELECT idx, up_off, down_off, n1, n2, scaled1, scaled2, round(log2((scaled1 + 1) / (scaled2 + 1)::DOUBLE), 6) AS log2_ratio FROM u""")
def altss_compare(spark, d):
    return rounded(D.altss_compare(counts(spark, d), 1, 2))


@query(ctes("psi_counts") + MEANS_CTE + """, tr AS (SELECT event, condition, avg(included / (included + skipped)::DOUBLE) AS psi FROM psi_counts WHERE sample % 2 = 0 AND included + skipped > 0 GROUP BY ALL)
 SELECT event, condition, round(m.psi, 6) AS assay, round(tr.psi, 6) AS transcriptome, CASE WHEN m.psi >= 0.5 AND tr.psi >= 0.5 THEN 'both_high' WHEN m.psi >= 0.5 THEN 'assay_high' WHEN tr.psi >= 0.5 THEN 'transcriptome_high' ELSE 'both_low' END AS quadrant FROM means m JOIN tr USING (event, condition)""")
def transcriptome_compare(spark, d):
    t = psi_table(spark, d).where("sample % 2 = 0").withColumn("psi", P.psi_of(F.col("included"), F.col("skipped")))
    other = t.groupBy("event", "condition").agg(F.avg("psi").alias("psi")).where("psi is not null")
    return rounded(D.transcriptome_compare(means(spark, d), other))


@query(ctes("psi_counts") + MEANS_CTE + """, tr AS (SELECT event, condition, avg(included / (included + skipped)::DOUBLE) AS psi FROM psi_counts WHERE sample % 2 = 0 AND included + skipped > 0 GROUP BY ALL)
 SELECT condition, round(corr(m.psi, tr.psi), 6) AS r, count(*) AS n FROM means m JOIN tr USING (event, condition) GROUP BY condition""")
def transcriptome_correlation(spark, d):
    t = psi_table(spark, d).where("sample % 2 = 0").withColumn("psi", P.psi_of(F.col("included"), F.col("skipped")))
    other = t.groupBy("event", "condition").agg(F.avg("psi").alias("psi")).where("psi is not null")
    return rounded(D.transcriptome_correlation(D.transcriptome_compare(means(spark, d), other)))


JUNCTIONS = """SELECT l_orderkey AS k, CONCAT('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand,
 CONCAT('g', CAST(l_suppkey AS STRING)) AS GeneID, CONCAT('s', CAST(l_suppkey % 50 AS STRING)) AS geneSymbol, l_orderkey * 10 + 100 AS exonStart_0base, l_orderkey * 10 + 100 + l_partkey % 90 AS exonEnd,
 l_orderkey * 10 AS upstreamES, l_orderkey * 10 + 50 AS upstreamEE, l_orderkey * 10 + 300 AS downstreamES, l_orderkey * 10 + 400 AS downstreamEE,
 CONCAT(CAST(CAST(l_quantity AS BIGINT) AS STRING), ',', CAST(l_partkey % 40 AS STRING)) AS IJC_SAMPLE_1, CONCAT(CAST(l_linenumber AS STRING), ',', CAST(l_suppkey % 40 AS STRING)) AS SJC_SAMPLE_1 FROM {lineitem}"""


@query(f"WITH j AS ({derive.sql(JUNCTIONS)})" + """, e AS (SELECT *, concat_ws('-', chr, exonStart_0base, exonEnd, upstreamES, upstreamEE, downstreamES, downstreamEE) AS id,
  list_transform(string_split(IJC_SAMPLE_1, ','), lambda x: CAST(x AS DOUBLE)) AS i, list_transform(string_split(SJC_SAMPLE_1, ','), lambda x: CAST(x AS DOUBLE)) AS s FROM j),
 p AS (SELECT *, list_transform(list_zip(i, s), lambda x: CASE WHEN x[1] + x[2] > 0 THEN round(x[1] / (x[1] + x[2]) + 1e-12, 3) END) AS ps, round((i[1] + s[1] + i[2] + s[2]) / 2 + 1e-12, 0) AS mean_count FROM e)
 SELECT concat_ws(';', GeneID, geneSymbol, id) AS name, strand, ps[1] AS psi1, ps[2] AS psi2, mean_count, exonEnd - exonStart_0base AS exon_length,
  CASE strand WHEN '-' THEN downstreamES - exonEnd ELSE exonStart_0base - upstreamEE END AS up_intron_length, CASE strand WHEN '-' THEN exonStart_0base - upstreamEE ELSE downstreamES - exonEnd END AS down_intron_length
 FROM p WHERE mean_count >= 30""")
def junction_events(spark, d):
    out, of = D.junction_events(derive.load(spark, d, JUNCTIONS)), lambda k: F.get("psi_list", F.lit(k)).alias(f"psi{k + 1}")
    return out.select("name", "strand", of(0), of(1), "mean_count", "exon_length", "up_intron_length", "down_intron_length")


@query(ctes("expression") + " SELECT gene, round(var_samp(value), 9) AS var, round(max(value) - min(value), 6) AS range, round((count(value) - sum(value) / max(value)) / (count(value) - 1), 4) AS tau FROM expression WHERE gene % 3 = 0 OR gene % 5 = 0 GROUP BY gene")
def candidate_genes(spark, d):
    e = derive.load(spark, d, derive.EXPRESSION_SPARK)
    g = e.select("gene").distinct()
    out = D.candidate_genes(e, g.where("gene % 3 = 0"), g.where("gene % 5 = 0"))
    return out.select("gene", F.round("var", 9).alias("var"), F.round("range", 6).alias("range"), F.round("tau", 4).alias("tau"))


PLATES = "SELECT l_suppkey AS plate, l_linenumber AS condition, l_orderkey AS well, CAST(l_extendedprice AS DOUBLE) AS ratio FROM {lineitem}"


@query(f"WITH p AS ({derive.sql(PLATES)})" + """, v AS (SELECT *, log2(ratio) AS v FROM p WHERE ratio > 0), c AS (SELECT *, avg(v) FILTER (condition = 1) OVER w AS a, avg(v) FILTER (condition = 2) OVER w AS b FROM v WINDOW w AS (PARTITION BY plate)),
 s AS (SELECT *, (v - a) / (b - a) AS scaled FROM c) SELECT plate, well, condition, round((scaled - min(scaled) OVER (PARTITION BY plate)) / (max(scaled) OVER (PARTITION BY plate) - min(scaled) OVER (PARTITION BY plate)), 5) AS unit FROM s""")
def control_scale(spark, d):
    out = S.control_scale(derive.load(spark, d, PLATES), 1, 2)
    return out.select("plate", "well", "condition", F.round("unit", 5).alias("unit"))


DESIGN_NAMES = "SELECT l_orderkey AS k, l_linenumber AS line, CONCAT('vae_', CAST(l_partkey % 10 AS STRING), '_to_', CAST(l_suppkey AS STRING), '_', CAST(l_orderkey AS STRING)) AS name, CONCAT(CAST(l_partkey AS STRING), substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1)) AS label FROM {lineitem}"


@query(f"WITH n AS ({derive.sql(DESIGN_NAMES)})" + " SELECT k, line, regexp_replace(name, '_?[0-9]+$', '') AS category, CAST(regexp_extract(name, '([0-9]+)$', 1) AS INT) AS number, CAST(regexp_extract(label, '([0-9]+)', 1) AS INT) AS position, regexp_extract(label, '([A-Z])$', 1) AS nucleotide FROM n")
def parse_names(spark, d):
    category, number = N.parse_design(F.col("name"))
    position, nucleotide = N.parse_mutation(F.col("label"))
    return derive.load(spark, d, DESIGN_NAMES).select("k", "line", category.alias("category"), number.alias("number"), position.alias("position"), nucleotide.alias("nucleotide"))


# The constant sequences beside the barcode.
A1, A2 = "TTGCTAGGACCGGCCTTAAAGC", "CTACTTA"


@query(ctes("sequences") + pieces_cte(54) + f""", r AS (SELECT concat_ws('_', doc_id, piece) AS read_id,
  CASE WHEN doc_id % 3 = 0 THEN concat(substr(seq, 1, 10), '{A1}', substr(seq, 11, 14), '{A2}', substr(seq, 25, 30)) ELSE seq END AS seq FROM pieces),
 f AS (SELECT *, substr(seq, 11, 22) AS one, substr(seq, 47, 7) AS two FROM r), l AS (SELECT DISTINCT substr(seq, 11, 14) AS cb FROM pieces WHERE doc_id % 2 = 0 AND len(seq) >= 24)
 SELECT read_id, substr(seq, 33, 14) AS cb, substr(seq, 1, 10) AS umi FROM f WHERE len(one) = 22 AND len(two) = 7
 AND CASE WHEN len(one) = 22 THEN hamming(one, '{A1}') <= 2 END AND CASE WHEN len(two) = 7 THEN hamming(two, '{A2}') <= 1 END AND substr(seq, 33, 14) IN (SELECT cb FROM l)""")
def extract_umi(spark, d):
    """Every window of 54 bases is a read; each third document's are given anchors."""
    s = pieces(spark, d, 54)
    listed = s.where("doc_id % 2 = 0 and length(seq) >= 24").select(F.substring("seq", 11, 14).alias("cb"))
    anchored = F.concat(F.substring("seq", 1, 10), F.lit(A1), F.substring("seq", 11, 14), F.lit(A2), F.substring("seq", 25, 30))
    reads = s.select(F.concat_ws("_", "doc_id", "window").alias("read_id"), F.when(F.col("doc_id") % 3 == 0, anchored).otherwise(F.col("seq")).alias("seq"))
    ok, _ = R.extract_umi(reads, listed, A1, A2)
    return ok.select("read_id", "cb", "umi")


# The constant parts of the made-up construct.
CONSTRUCT = R.Construct("GGCATTCGATCCTAGGTTCA", "GTAAGTCCGATTACGCAGGTCATTGACCTGATCGGATTCA", "CCTTGGAACTGATCGTTACGTTCAGGATCCAAGTTC", "TTTCTCTCTTTCAGGACTGA")
KINDS = 8
"""Reads of a window in turn: included, shifted, skipped, two bases before the site, foreign, unspliced, at another site, without a site."""


def _called(spark, d):
    """Reads put together from windows of 174 bases; the barcodes of windows that no element has are unknown."""
    c = CONSTRUCT
    s = pieces(spark, d, 174).withColumn("id", F.concat_ws("_", "doc_id", "window"))
    first = F.struct("doc_id", "window")
    lib = s.where("doc_id % 11 <> 0").groupBy(F.substring("seq", 1, 14).alias("cb")).agg(F.min_by("seq", first).alias("q"), F.min_by("id", first).alias("idx"))
    library = lib.select("cb", "idx", F.substring("q", 20, 30).alias("up_intron"), F.substring("q", 50, 45).alias("exon"), F.substring("q", 95, 30).alias("down_intron"))
    kind = (F.col("doc_id") + F.col("window")) % KINDS
    exon, end = F.substring("seq", 50, 45), F.lit(c.downstream_exon)
    other = F.concat(F.lit(c.const_intron), F.lit(c.downstream_exon[5:]))
    rest = (
        F.when(kind == 0, F.concat(exon, end)).when(kind == 1, F.concat(F.substring("seq", 52, 41), end)).when(kind == 2, end).when(kind == 3, F.concat(F.lit("AC"), end))
        .when(kind == 4, F.concat(F.substring("seq", 130, 45), end)).when(kind == 5, F.lit(c.intron[3:])).when(kind == 6, F.concat(exon, other)).otherwise(exon)
    )
    seq = F.concat(F.substring("seq", 20, 6), F.lit(c.upstream_anchor), rest)
    reads = s.select(F.col("id").alias("read_id"), F.substring("seq", 1, 14).alias("cb"), F.substring("seq", 15, 5).alias("umi"), seq.alias("seq"))
    return R.call_events(reads, library, c)


def _called_sql() -> str:
    """The same in SQL: anchors stand where they were put; an insert that is not found exactly is sought with one edit at every place."""
    c = CONSTRUCT
    sites = " ".join(f"WHEN contains(rest, '{seq}') THEN {offset}" for offset, seq in c.alternative_sites())
    at = " ".join(f"WHEN contains(rest, '{seq}') THEN instr(rest, '{seq}') - 1" for _, seq in c.alternative_sites())
    n = len(c.upstream_anchor)
    return ctes("sequences") + pieces_cte(174) + f""", s AS (SELECT *, concat_ws('_', doc_id, piece) AS id, substr(seq, 1, 14) AS cb, (doc_id + piece) % {KINDS} AS kind FROM pieces),
 lib AS (SELECT cb, arg_min(id, (doc_id, piece)) AS idx, arg_min(seq, (doc_id, piece)) AS q FROM s WHERE doc_id % 11 <> 0 GROUP BY cb),
 made AS (SELECT id, cb, substr(seq, 15, 5) AS umi, concat(substr(seq, 20, 6), '{c.upstream_anchor}', CASE kind WHEN 0 THEN concat(substr(seq, 50, 45), '{c.downstream_exon}')
   WHEN 1 THEN concat(substr(seq, 52, 41), '{c.downstream_exon}') WHEN 2 THEN '{c.downstream_exon}' WHEN 3 THEN 'AC{c.downstream_exon}' WHEN 4 THEN concat(substr(seq, 130, 45), '{c.downstream_exon}')
   WHEN 5 THEN '{c.intron[3:]}' WHEN 6 THEN concat(substr(seq, 50, 45), '{c.const_intron}{c.downstream_exon[5:]}') ELSE substr(seq, 50, 45) END) AS read FROM s),
 cut AS (SELECT made.*, idx, substr(read, instr(read, '{c.upstream_anchor}') + {n}) AS rest, concat(substr(q, 20, 30), substr(q, 50, 45), substr(q, 95, 30), '{c.const_intron}') AS ref,
   len(substr(q, 20, 30)) AS n1, len(substr(q, 50, 45)) AS n2 FROM made LEFT JOIN lib USING (cb)),
 site AS (SELECT *, CASE WHEN len(rest) > 0 THEN instr('{c.intron}', substr(rest, 1, {c.probe})) - 1 ELSE -1 END AS intron,
   CASE WHEN contains(rest, '{c.downstream_exon[: c.probe]}') THEN 0 {sites} END AS const, CASE WHEN contains(rest, '{c.downstream_exon[: c.probe]}') THEN instr(rest, '{c.downstream_exon[: c.probe]}') - 1 {at} END AS start FROM cut),
 mid AS (SELECT *, substr(rest, 1, start) AS middle, instr(ref, substr(rest, 1, start)) - 1 AS exact FROM site),
 near AS (SELECT id, min({{'d': levenshtein(substr(ref, i + 1, len(middle) + e), middle), 'b': i, 'e': i + len(middle) + e}}) AS h FROM mid, range(0, 200) t(i), (SELECT unnest([-1, 0, 1]) AS e)
   WHERE idx IS NOT NULL AND intron < 0 AND start > 2 AND exact < 0 AND len(middle) > {c.probe} AND i + len(middle) + e <= len(ref) AND levenshtein(substr(ref, i + 1, len(middle) + e), middle) <= 1 GROUP BY id),
 got AS (SELECT mid.*, CASE WHEN exact >= 0 THEN exact ELSE coalesce(h.b, -1) END AS hit, CASE WHEN exact >= 0 THEN exact + len(middle) ELSE h.e END AS till FROM mid LEFT JOIN near USING (id)),
 oc AS (SELECT *, CASE WHEN idx IS NULL THEN 'bc_not_found' WHEN intron >= 0 THEN 'UNSPLICED' WHEN start IS NULL THEN 'no_downstream' WHEN start <= 2 THEN 'SKIPPED' WHEN hit < 0 THEN 'chimera' ELSE 'INCLUDED' END AS outcome FROM got),
 called AS (SELECT id AS read_id, cb, umi, idx, outcome, CAST(CASE outcome WHEN 'UNSPLICED' THEN intron WHEN 'INCLUDED' THEN hit - n1 END AS INT) AS up_off,
   CAST(CASE outcome WHEN 'INCLUDED' THEN till - n1 - n2 END AS INT) AS down_off, CAST(CASE WHEN outcome IN ('SKIPPED', 'INCLUDED') THEN const END AS INT) AS const_off,
   CAST(CASE WHEN outcome IN ('SKIPPED', 'INCLUDED') THEN len(middle) END AS INT) AS insert_size FROM oc)"""


@query(_called_sql() + " SELECT * FROM called")
def call_events(spark, d):
    """Outcome and offsets of every read (searches with edits are tested on constructed reads)."""
    return _called(spark, d)


@query(_called_sql() + """, e AS (SELECT *, outcome IN ('INCLUDED', 'SKIPPED', 'UNSPLICED') AS event, outcome IN ('INCLUDED', 'chimera') AS inc FROM called),
 a AS (SELECT count(*) AS total_reads, count(*) FILTER (event OR outcome = 'chimera') AS total_aligned_reads,
  (SELECT count(*) FROM (SELECT DISTINCT idx, outcome, up_off, down_off, const_off, insert_size, cb, umi FROM e WHERE event)) AS total_umi_count, count(*) FILTER (outcome = 'bc_not_found') AS bc_not_found,
  count(*) FILTER (outcome = 'SKIPPED') AS skipped_reads, count(*) FILTER (outcome = 'chimera') AS chimera_reads, count(*) FILTER (outcome = 'UNSPLICED' AND up_off = 0) AS unspliced_counter,
  count(*) FILTER (outcome = 'UNSPLICED' AND up_off <> 0) AS minor_splice_counter, count(*) FILTER (outcome = 'INCLUDED' AND up_off = 0 AND down_off = 0) AS perfect_middle_exon,
  count(*) FILTER (outcome = 'INCLUDED') AS everything_passed_with_middle_exon, count(*) FILTER (inc) AS inc FROM e)
 SELECT a.* EXCLUDE (inc), round(total_umi_count / total_aligned_reads::DOUBLE, 6) AS duplication_rate, round(bc_not_found / total_reads::DOUBLE, 6) AS perc_bc_not_found, round(chimera_reads / inc::DOUBLE, 6) AS perc_chimera_reads FROM a""")
def run_stats(spark, d):
    """The thirteen statistics of the called reads."""
    return rounded(R.run_stats(_called(spark, d)))


@query()
def chimera_pairs(spark, d):
    """Windows of 120 bases as elements; each read is a part of its own window or, in every third, of the next one of its
    document (minimisers have no SQL twin; tested in plain Python)."""
    s = pieces(spark, d, 120).where("length(seq) = 120").withColumn("idx", F.concat_ws("_", "doc_id", "window"))
    later = F.lead("seq").over(Window.partitionBy("doc_id").orderBy("window"))
    source = F.when((F.col("doc_id") + F.col("window")) % 3 == 0, F.coalesce(later, "seq")).otherwise(F.col("seq"))
    s = written(s.select("idx", F.col("seq").alias("exon"), F.substring(source, 21, 80).alias("seq")), "windows", **R.DENSE)
    return R.chimera_pairs(s.select(F.col("idx").alias("read_id"), "idx", "seq"), s.select("idx", "exon"))


@query(ctes("sequences") + pieces_cte(400) + """, e AS (SELECT concat_ws('_', doc_id, piece) AS idx, seq FROM pieces WHERE len(seq) >= 9)
 SELECT a.idx AS alt, b.idx AS ref FROM e a JOIN e b ON a.idx <> b.idx AND contains(b.seq, a.seq) AND (len(b.seq) > len(a.seq) OR b.idx < a.idx)""")
def contained_exons(spark, d):
    s = pieces(spark, d, 400).where("length(seq) >= 9").select(F.concat_ws("_", "doc_id", "window").alias("idx"), F.col("seq").alias("exon"))
    return R.contained_exons(s)


# The anchors on both sides of a micro-exon, and the first with one base changed and one left out.
LEFT, RIGHT = "GATTCAGCATCG", "CCTAGGATCTTA"
LEFTS = (LEFT, "GATTCTGCATCG", "GATTCAGCTCG")


@query(ctes("sequences") + pieces_cte(60) + f""", r AS (SELECT concat_ws('_', doc_id, piece) AS id, lang AS idx, concat(substr(seq, 10, 5), ['{LEFTS[0]}', '{LEFTS[1]}', '{LEFTS[2]}'][CAST((doc_id + piece) % 3 + 1 AS INT)],
  substr(seq, 20, CAST(1 + piece % 3 AS INT)), '{RIGHT}', substr(seq, 40, 6)) AS seq FROM pieces WHERE len(seq) = 60),
 l AS (SELECT id, min({{'d': levenshtein(substr(seq, i + 1, 12 + e), '{LEFT}'), 's': i, 't': i + 12 + e}}) AS h FROM r, range(0, 40) t(i), (SELECT unnest([-1, 0, 1]) AS e) WHERE i + 12 + e <= len(seq) AND levenshtein(substr(seq, i + 1, 12 + e), '{LEFT}') <= 1 GROUP BY id),
 m AS (SELECT id, idx, substr(seq, CAST(h.t + 1 AS INT)) AS rest FROM r JOIN l USING (id)),
 k AS (SELECT id, min({{'d': levenshtein(substr(rest, i + 1, 12 + e), '{RIGHT}'), 's': i, 't': i + 12 + e}}) AS h FROM m, range(0, 40) t(i), (SELECT unnest([-1, 0, 1]) AS e) WHERE i + 12 + e <= len(rest) AND levenshtein(substr(rest, i + 1, 12 + e), '{RIGHT}') <= 1 GROUP BY id)
 SELECT idx, substr(rest, 1, CAST(h.s AS INT)) AS middle, count(*) AS n FROM m JOIN k USING (id) GROUP BY ALL HAVING count(*) >= 6""")
def micro_exon_counts(spark, d):
    """Reads of one to three bases between two anchors, of which the first may have an edit."""
    s = pieces(spark, d, 60).where("length(seq) = 60")
    first = F.element_at(F.array(*[F.lit(a) for a in LEFTS]), ((F.col("doc_id") + F.col("window")) % 3 + 1).cast("int"))
    read = F.concat(F.substring("seq", 10, 5), first, F.substr("seq", F.lit(20), (1 + F.col("window") % 3).cast("int")), F.lit(RIGHT), F.substring("seq", 40, 6))
    return R.micro_exon_counts(s.select(F.col("lang").alias("idx"), read.alias("seq")), LEFT, RIGHT)


@query(ctes("sequences") + pieces_cte(174) + f""", e AS (SELECT concat_ws('_', doc_id, piece) AS idx, substr(seq, 20, 30) AS u, substr(seq, 50, 45) AS x, substr(seq, 95, 30) AS w FROM pieces)
 SELECT idx, 'SKIPPED' AS mode, substr(concat('{LEFT}', '{RIGHT}'), 1, 100) AS seq FROM e UNION ALL SELECT idx, 'UNSPLICED', substr(concat('{LEFT}', u, x, w, '{RIGHT}'), 1, 100) FROM e UNION ALL SELECT idx, 'INCLUDED', substr(concat('{LEFT}', x, '{RIGHT}'), 1, 100) FROM e""")
def spliced_reference(spark, d):
    part = lambda at, n: F.substring("seq", at, n)
    library = pieces(spark, d, 174).select(F.concat_ws("_", "doc_id", "window").alias("idx"), part(20, 30).alias("up_intron"), part(50, 45).alias("exon"), part(95, 30).alias("down_intron"))
    return R.spliced_reference(library, LEFT, RIGHT, 100)


_MOLECULES = pieces_cte(100) + """, m AS (SELECT lang AS idx, substr(seq, 1, 4) AS cb, substr(seq, 5, 2) AS umi, seq FROM pieces), g AS (SELECT *, instr(seq, 'CATG') AS b FROM m),
 h AS (SELECT *, instr(substr(seq, b + 4), 'GTAC') - 1 AS length FROM g WHERE b > 0), c AS (SELECT idx, cb, umi, length, count(*) AS n FROM h WHERE length >= 0 GROUP BY ALL)"""


@query(ctes("sequences") + _MOLECULES + " SELECT idx, cb, umi, CAST(arg_min(length, (-n, length)) AS INT) AS length, CAST(sum(n) AS BIGINT) AS reads FROM c GROUP BY ALL")
def insertion_lengths(spark, d):
    reads = pieces(spark, d, 100).select(F.col("lang").alias("idx"), F.substring("seq", 1, 4).alias("cb"), F.substring("seq", 5, 2).alias("umi"), "seq")
    return R.insertion_lengths(reads, "CATG", "GTAC")


@query(ctes("psi_counts") + ", p AS (SELECT condition, event, array_to_string(list(included ORDER BY sample), ',') AS i FROM psi_counts GROUP BY ALL) SELECT condition, event, CAST(list_sum(list_transform(string_split(i, ','), lambda x: TRY_CAST(x AS DOUBLE))) AS DOUBLE) AS total FROM p")
def unpack_lists(spark, d):
    packed = K.pack_replicates(psi_table(spark, d), ("condition", "event"), min_length=0).select("condition", "event", F.array_join("included", ",").alias("i"))
    return K.unpack_lists(packed, ["i"]).select("condition", "event", F.aggregate("i", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query()
def gmm_1d(spark, d):
    """Two-component mixture per gene; EM has no SQL twin (tested on separated values)."""
    return M.gmm_1d(derive.load(spark, d, derive.EXPRESSION_SPARK))


@query()
def expression_regression(spark, d):
    """Ridge of the first two components of PSI on the genes; penalties by cross-validation (tested against plain fits)."""
    scores, _, _ = M.psi_pca(means(spark, d))
    targets = scores.select(F.col("condition").alias("cell_line"), F.abs(F.get("pc", F.lit(0))).alias("one"), F.abs(F.get("pc", F.lit(1))).alias("two"))
    return rounded(M.expression_regression(derive.load(spark, d, derive.EXPRESSION_SPARK), targets.select("cell_line", F.array("one", "two").alias("y"))))


@query()
def class_border(spark, d):
    """Which line items were returned, by quantity and discount (tested against numpy)."""
    items = derive.load(spark, d, "SELECT CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_quantity AS DOUBLE) / 50 AS quantity, CAST(l_discount AS DOUBLE) * 10 AS discount FROM {lineitem}")
    found = M.class_border(items, ["quantity", "discount"])
    return rounded(found.select("intercept", F.get("weights", F.lit(0)).alias("first"), F.get("weights", F.lit(1)).alias("second"), "slope", "border", "log_likelihood"), 4)


@query()
def psi_pca(spark, d):
    """First two principal components of the conditions; signs are free, so sizes are returned (tested against numpy)."""
    scores, _, _ = M.psi_pca(means(spark, d))
    return rounded(scores.select("condition", F.abs(F.get("pc", F.lit(0))).alias("pc1"), F.abs(F.get("pc", F.lit(1))).alias("pc2")))


@query()
def top_loadings(spark, d):
    """The events that weigh most in the first component (tested against numpy)."""
    _, _, loadings = M.psi_pca(means(spark, d))
    return rounded(M.top_loadings(loadings).select("event", F.abs("weight").alias("weight")))
