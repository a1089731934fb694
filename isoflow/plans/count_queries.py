"""Queries of the count and PSI operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoflow.operators import counts as C
from isoflow.operators import psi as P
from isoflow.plans import derive
from isoflow.plans.base import MEANS_CTE, PSI_CTE, ctes, query, rounded
from isoflow.sources.scratch import written

RATES = "SELECT s_suppkey AS sample, CAST(s_suppkey % 20 AS DOUBLE) / 100 AS rate FROM {supplier}"


def counts(spark, d):
    return derive.load(spark, d, derive.COUNTS)


def psi_table(spark, d):
    return derive.load(spark, d, derive.PSI_COUNTS)


def means(spark, d):
    return P.psi_by_condition(psi_table(spark, d))


@query(ctes("file_counts") + " SELECT sample, condition, idx, mode, up_off, down_off, CAST(sum(cnt) AS BIGINT) AS cnt FROM file_counts GROUP BY ALL")
def merge_replicate_files(spark, d):
    return C.merge_replicate_files(derive.load(spark, d, derive.FILE_COUNTS))


@query(ctes("counts") + """ SELECT *, CAST(sum(cnt) OVER (PARTITION BY sample, idx) AS BIGINT) AS total, CAST(sum(cnt) OVER (PARTITION BY sample, idx, mode) AS BIGINT) AS mode_total,
 round(cnt / sum(cnt) OVER (PARTITION BY sample, idx) + 1e-10, 6) AS frac_of_total, round(cnt / sum(cnt) OVER (PARTITION BY sample, idx, mode) + 1e-10, 6) AS frac_of_mode FROM counts""")
def count_fractions(spark, d):
    return rounded(C.count_fractions(counts(spark, d)), nudge=1e-10)


_V3 = """, t AS (SELECT *, coalesce(sum(cnt) FILTER (mode = 'INCLUDED') OVER w, 0) AS i, sum(cnt) FILTER (mode <> 'INCLUDED') OVER w AS o
 FROM counts JOIN rates USING (sample) WINDOW w AS (PARTITION BY sample, idx))
 SELECT sample, condition, idx, mode, up_off, down_off, cnt, CASE WHEN mode = 'INCLUDED' THEN cnt
 ELSE greatest(0, CAST(trunc((o - rate * i) / (1 + rate) * (cnt::DOUBLE / o)) AS BIGINT)) END AS cnt_scaled FROM t"""


@query(ctes("counts", "rates") + _V3)
def chimera_correct_v3(spark, d):
    return C.chimera_correct_v3(counts(spark, d), derive.load(spark, d, RATES))


@query(ctes("counts", "rates") + """ SELECT sample, condition, idx, mode, up_off, down_off, cnt,
 CASE WHEN mode = 'INCLUDED' THEN cnt ELSE CAST(trunc(cnt * (1 - rate)) AS BIGINT) END AS cnt_scaled FROM counts JOIN rates USING (sample)""")
def chimera_correct_v2(spark, d):
    return C.chimera_correct_v2(counts(spark, d), derive.load(spark, d, RATES))


ANCHORS = "SELECT DISTINCT p_brand AS event FROM {part} WHERE p_brand LIKE '%1'"


@query(ctes("psi_counts") + """, r AS (SELECT sample, 1 / exp(avg(ln(included / (included + skipped)::DOUBLE)) FILTER (included > 0)) - 1 AS swap_rate
 FROM psi_counts WHERE event LIKE '%1' GROUP BY sample)
 SELECT sample, condition, event, included, skipped, round(swap_rate, 6) AS swap_rate, CAST(trunc(round(skipped * (1 - swap_rate), 6)) AS BIGINT) AS skipped_scaled FROM psi_counts JOIN r USING (sample)""")
def anchor_correct(spark, d):
    out = C.anchor_correct(psi_table(spark, d), derive.load(spark, d, ANCHORS))
    return rounded(out.withColumn("skipped_scaled", F.round(F.col("skipped") * (1 - F.col("swap_rate")), 6).cast("long")))


@query(ctes("psi_counts") + """ SELECT event, round(avg(included / (included + skipped)::DOUBLE), 6) AS mean_psi, CAST(sum(included + skipped) AS BIGINT) AS total
 FROM psi_counts WHERE included + skipped > 0 GROUP BY event HAVING count(DISTINCT condition) >= 20 AND avg(included / (included + skipped)::DOUBLE) > 0.5 AND sum(included + skipped) > 1000""")
def select_anchors(spark, d):
    return rounded(C.select_anchors(psi_table(spark, d), 20, 0.5, 1000, limit=None))


_A7 = """, g AS (SELECT sample, condition, idx, list([{'u': up_off, 'd': down_off, 'c': cnt}] ORDER BY cnt DESC, up_off, down_off) AS l
 FROM counts WHERE mode = 'INCLUDED' GROUP BY ALL),
 m AS (SELECT sample, condition, idx, list_reduce(l, lambda a, e: CASE WHEN len(list_filter(a, lambda x: abs(x.u - e[1].u) <= 1 AND abs(x.d - e[1].d) <= 1)) > 0
  THEN list_transform(a, lambda x: CASE WHEN x = list_filter(a, lambda y: abs(y.u - e[1].u) <= 1 AND abs(y.d - e[1].d) <= 1)[1] THEN {'u': x.u, 'd': x.d, 'c': x.c + e[1].c} ELSE x END)
  ELSE list_concat(a, e) END) AS k FROM g)
 SELECT sample, condition, idx, x.u AS up_off, x.d AS down_off, x.c AS cnt FROM (SELECT sample, condition, idx, unnest(k) AS x FROM m)"""


@query(ctes("counts") + _A7)
def merge_near_offsets(spark, d):
    return C.merge_near_offsets(counts(spark, d).where("mode = 'INCLUDED'"))


_CATALOG = """, f AS (SELECT *, sum(cnt) OVER (PARTITION BY sample, idx, mode) AS mt FROM counts),
 catalog AS (SELECT DISTINCT p_brand AS idx, 0 AS up_off, 0 AS down_off FROM part UNION ALL
 SELECT idx, up_off, down_off FROM f WHERE mode = 'INCLUDED' AND (up_off <> 0 OR down_off <> 0) AND mt >= 100 GROUP BY ALL HAVING max(cnt) >= 5 AND max(cnt / mt) > 0.05)"""


def catalog(spark, d, of=None):
    elements = derive.load(spark, d, "SELECT p_brand AS idx FROM {part}")
    return C.included_event_catalog(counts(spark, d) if of is None else of, elements, min_mode_total=100, min_frac=0.05)


@query(ctes("counts") + _CATALOG + " SELECT * FROM catalog")
def included_event_catalog(spark, d):
    return catalog(spark, d)


@query(ctes("counts") + """, f AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY sample, idx, mode) AS x FROM counts)
 SELECT mode, up_off, count(*) AS n, round(max(x), 6) AS max_frac, max(cnt) AS max_reads FROM f WHERE mode = 'UNSPLICED' GROUP BY ALL""")
def unspliced_catalog(spark, d):
    return rounded(C.unspliced_catalog(counts(spark, d)))


_GRID = """, grid AS (SELECT sample, condition, c.* FROM catalog c, (SELECT DISTINCT sample, condition FROM counts)),
 pc AS (SELECT sample, condition, idx, up_off, down_off, CAST(coalesce(i, 0) AS BIGINT) AS included, CAST(coalesce(s, 0) AS BIGINT) AS skipped FROM grid
 LEFT JOIN (SELECT sample, idx, up_off, down_off, sum(cnt) AS i FROM counts WHERE mode = 'INCLUDED' GROUP BY ALL) USING (sample, idx, up_off, down_off)
 LEFT JOIN (SELECT sample, idx, sum(cnt) AS s FROM counts WHERE mode = 'SKIPPED' GROUP BY ALL) USING (sample, idx))"""


def grid_counts(spark, d):
    c = written(counts(spark, d), "counts")
    return P.psi_counts(c, catalog(spark, d, c))


@query(ctes("counts") + _CATALOG + _GRID + " SELECT * FROM pc")
def psi_counts(spark, d):
    return grid_counts(spark, d)


@query(ctes("psi_counts") + PSI_CTE.replace(">= 30", ">= 200") + " SELECT * REPLACE (round(psi + 1e-10, 6) AS psi) FROM psi")
def psi(spark, d):
    return rounded(P.psi(psi_table(spark, d), 200), nudge=1e-10)


@query(ctes("psi_counts") + """, g AS (SELECT condition, event, CAST(sum(included) AS BIGINT) AS included, CAST(sum(skipped) AS BIGINT) AS skipped FROM psi_counts GROUP BY ALL)
 SELECT *, round(included / (included + skipped)::DOUBLE, 6) AS psi FROM g WHERE included + skipped >= 30""")
def psi_pooled(spark, d):
    return rounded(P.psi_pooled(psi_table(spark, d)))


@query(ctes("psi_counts") + MEANS_CTE + " SELECT event, condition, round(psi, 6) AS psi FROM means")
def psi_by_condition(spark, d):
    return rounded(means(spark, d))


@query(ctes("counts") + """, s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY sample, idx) AS x FROM counts WHERE mode = 'INCLUDED')
 SELECT condition, idx, up_off, down_off, round(avg(x), 6) AS share FROM s GROUP BY ALL""")
def included_fraction(spark, d):
    return rounded(P.included_fraction(counts(spark, d)))


_LOG = """, lp AS (SELECT *, log2((included * 1000 // (included + skipped) + 1) / (skipped * 1000 // (included + skipped) + 1)::DOUBLE) AS log_psi FROM psi_counts WHERE included + skipped > 0)"""


@query(ctes("psi_counts") + _LOG + " SELECT * REPLACE (round(log_psi, 6) AS log_psi) FROM lp")
def log_psi(spark, d):
    return rounded(P.log_psi(psi_table(spark, d).where("included + skipped > 0")))


@query(ctes("psi_counts") + _LOG + """ SELECT sample, event, round(greatest(0, least(1, (1001 * pow(2, log_psi) - 1) / (pow(2, log_psi) + 1) / 1000)), 6) AS bounded FROM lp""")
def unlog_psi(spark, d):
    table = P.log_psi(psi_table(spark, d).where("included + skipped > 0"))
    return rounded(table.select("sample", "event", P.unlog_psi(F.col("log_psi")).alias("bounded")))


def flagship(spark, d):
    """Counts, corrected for chimeras, to PSI, condition means and specificity scores of each element."""
    from isoflow.operators.specificity import specificity_scores

    corrected = C.chimera_correct_v3(counts(spark, d), derive.load(spark, d, RATES)).withColumn("cnt", F.col("cnt_scaled")).drop("cnt_scaled")
    part = lambda m: F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("cnt"))), F.lit(0))
    table = corrected.groupBy("sample", "condition", F.col("idx").alias("event")).agg(part("INCLUDED").alias("included"), part("SKIPPED").alias("skipped"))
    return specificity_scores(P.psi_by_condition(table, 30, 1), 3)


@query(ctes("counts") + " SELECT sample, idx, count(DISTINCT (mode, up_off, down_off)) AS n_events FROM counts GROUP BY ALL")
def events_per_element(spark, d):
    return C.events_per_element(counts(spark, d))


@query(ctes("counts") + """, s AS (SELECT idx, up_off, down_off FROM counts WHERE mode = 'INCLUDED' AND (up_off <> 0 OR down_off <> 0) GROUP BY ALL HAVING count(DISTINCT condition) >= 21)
 SELECT idx, count(*) AS n_sites FROM s GROUP BY idx""")
def alt_site_counts(spark, d):
    return C.alt_site_counts(counts(spark, d))


@query(ctes("counts") + """, f AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY sample, idx) AS x FROM counts), e AS (SELECT sample, count(DISTINCT idx) AS n FROM counts GROUP BY ALL)
 SELECT sample, up_off, round(sum(x) / any_value(n), 6) AS share FROM f JOIN e USING (sample) WHERE mode = 'UNSPLICED' GROUP BY ALL""")
def unspliced_profile(spark, d):
    return rounded(C.unspliced_profile(counts(spark, d)))


@query(ctes("counts") + """, t AS (SELECT condition, sample, sum(cnt) AS total FROM counts GROUP BY ALL)
 SELECT condition, round(avg(total), 6) AS mean_total, round(stddev_samp(total), 6) AS sd_total, count(*) AS n_samples FROM t GROUP BY ALL""")
def sample_depth(spark, d):
    return rounded(C.sample_depth(counts(spark, d)))


@query(ctes("counts") + " SELECT *, CAST(trunc(cnt * 5e7::DOUBLE / sum(cnt) OVER (PARTITION BY sample)) AS BIGINT) AS cnt_scaled FROM counts")
def depth_normalise(spark, d):
    return C.depth_normalise(counts(spark, d))


ALT_REF = "SELECT DISTINCT p_brand AS alt, CONCAT('Brand#', substr(p_brand, 7, 1), '1') AS ref FROM {part} WHERE p_brand LIKE '%2'"


@query(ctes("counts") + """ SELECT sample, condition, CASE WHEN idx LIKE '%2' THEN concat('Brand#', substr(idx, 7, 1), '1') ELSE idx END AS idx, mode, up_off, down_off, CAST(sum(cnt) AS BIGINT) AS cnt
 FROM counts GROUP BY ALL""")
def apply_alt_ref(spark, d):
    return C.apply_alt_ref(counts(spark, d), derive.load(spark, d, ALT_REF))


@query(ctes("molecules") + """, a AS (SELECT idx, cb, count(*) AS dna FROM molecules WHERE mode = 'A' GROUP BY ALL), r AS (SELECT idx, cb, count(*) AS rna FROM molecules WHERE mode <> 'A' GROUP BY ALL)
 SELECT idx, CAST(coalesce(sum(dna), 0) AS BIGINT) AS dna, CAST(coalesce(sum(rna), 0) AS BIGINT) AS rna, count(*) FILTER (dna IS NOT NULL AND rna IS NOT NULL) AS barcodes_both
 FROM a FULL JOIN r USING (idx, cb) GROUP BY idx""")
def library_coverage(spark, d):
    m = derive.load(spark, d, derive.MOLECULES)
    return C.library_coverage(m.where("mode = 'A'"), m.where("mode <> 'A'"))


@query(ctes("counts") + """, t AS (SELECT sample, condition, sum(cnt)::DOUBLE AS total FROM counts GROUP BY ALL), w AS (SELECT *, min(total) OVER (PARTITION BY condition) AS lo, max(total) OVER (PARTITION BY condition) AS hi FROM t)
 SELECT condition, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((total - lo) * 20 / (hi - lo)), 19) END AS INT) AS bin, count(*) AS n FROM w GROUP BY ALL""")
def histogram(spark, d):
    totals = counts(spark, d).groupBy("sample", "condition").agg(F.sum("cnt").cast("double").alias("total"))
    return C.histogram(totals, "condition", "total")


@query(ctes("molecules") + " SELECT idx, mode, count(DISTINCT (cb, umi)) AS cnt FROM molecules GROUP BY ALL")
def umi_dedup(spark, d):
    return C.umi_dedup(derive.load(spark, d, derive.MOLECULES))


@query(ctes("molecules") + " SELECT idx, mode, cb, umi, count(*) AS reads FROM molecules GROUP BY ALL")
def molecule_counts(spark, d):
    return C.molecule_counts(derive.load(spark, d, derive.MOLECULES))


@query(ctes("counts") + _CATALOG + _GRID + """, t AS (SELECT *, row_number() OVER (PARTITION BY sample, idx ORDER BY included DESC, up_off, down_off) AS r FROM pc),
 v AS (SELECT idx, up_off, down_off, count(*) AS votes FROM t WHERE r = 1 GROUP BY ALL)
 SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY idx ORDER BY votes DESC, up_off, down_off) = 1""")
def major_event_by_vote(spark, d):
    return P.major_event_by_vote(grid_counts(spark, d))


_MAJOR = """, tt AS (SELECT *, sum(cnt) OVER (PARTITION BY sample, idx) AS total FROM counts WHERE mode <> 'UNSPLICED'),
 sh AS (SELECT idx, up_off, down_off, avg(cnt / total) AS share FROM tt WHERE total >= 30 AND mode = 'INCLUDED' GROUP BY ALL),
 major AS (SELECT * FROM (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY idx ORDER BY round(share, 9) DESC, up_off, down_off) = 1) WHERE share > 0.01 AND up_off < 200 AND down_off < 200)"""


@query(ctes("counts") + _MAJOR + " SELECT idx, up_off, down_off, round(share, 6) AS share FROM major")
def major_event_by_share(spark, d):
    return rounded(P.major_event_by_share(counts(spark, d)))


@query(ctes("counts") + _MAJOR + """ SELECT m.idx, m.up_off AS major_up, m.down_off AS major_down, e.up_off AS minor_up, e.down_off AS minor_down
 FROM major m JOIN (SELECT DISTINCT idx, up_off, down_off FROM counts WHERE mode = 'INCLUDED') e ON m.idx = e.idx AND (m.up_off <> e.up_off OR m.down_off <> e.down_off)""")
def event_pairs(spark, d):
    c = counts(spark, d)
    return P.event_pairs(P.major_event_by_share(c), c.where("mode = 'INCLUDED'"))


_SUMMARY = """ SELECT event, round(min(psi), 6) AS row_min, round(max(psi), 6) AS row_max, round(avg(psi), 6) AS row_mean, round(median(psi), 6) AS row_median, round(var_samp(psi), 6) AS row_var,
 arg_min(condition, (-psi, condition)) AS max_condition, arg_min(condition, (psi, condition)) AS min_condition, count(psi) AS n, 25 - count(psi) AS n_missing FROM means GROUP BY event"""


@query(ctes("psi_counts") + MEANS_CTE + _SUMMARY)
def event_summary(spark, d):
    return rounded(P.event_summary(means(spark, d), 25))


@query(ctes("psi_counts") + MEANS_CTE + " SELECT event, round(var_pop(psi), 6) AS residual FROM means GROUP BY event")
def row_residual(spark, d):
    return rounded(P.row_residual(means(spark, d)))


@query(ctes("psi_counts") + """, c AS (SELECT event, count(*) FILTER (included + skipped >= 300) AS seen FROM psi_counts GROUP BY event), s AS (SELECT seen / (SELECT count(DISTINCT sample) FROM psi_counts) AS x FROM c)
 SELECT count(*) AS n_events, count(*) FILTER (x < 0.5) AS below_50, count(*) FILTER (x < 0.8) AS below_80, count(*) FILTER (x < 0.9) AS below_90 FROM s""")
def completeness(spark, d):
    return P.completeness(psi_table(spark, d), min_total=300)


@query(ctes("psi_counts") + PSI_CTE + """, m AS (SELECT condition, median(psi) AS b FROM psi GROUP BY condition)
 SELECT p.sample, p.condition, event, round(CASE WHEN psi IN (0, 1) THEN psi ELSE greatest(0.001, least(0.999, psi - (b - (SELECT median(psi) FROM psi)))) END, 6) AS shifted FROM psi p JOIN m USING (condition)""")
def batch_median_shift(spark, d):
    return rounded(P.batch_median_shift(P.psi(psi_table(spark, d)), "condition").select("sample", "condition", "event", "shifted"))


_HOLES = ", holes AS (SELECT event, condition, CASE WHEN condition % 4 <> 1 THEN psi END AS psi FROM means)"


@query(ctes("psi_counts") + MEANS_CTE + _HOLES + """ SELECT event, condition, round(psi, 6) AS psi, round(coalesce(psi, avg(psi) OVER (PARTITION BY event), median(psi) OVER (PARTITION BY condition)), 6) AS filled
 FROM holes QUALIFY avg(CASE WHEN psi IS NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY event) <= 0.5""")
def impute(spark, d):
    return rounded(P.impute(means(spark, d).withColumn("psi", F.when(F.col("condition") % 4 != 1, F.col("psi")))))


@query(ctes("psi_counts") + MEANS_CTE + """ SELECT event, condition, round(psi, 6) AS psi, round(coalesce((psi - min(psi) OVER w) / nullif(max(psi) OVER w - min(psi) OVER w, 0), 0), 6) AS scaled FROM means WINDOW w AS (PARTITION BY event)""")
def min_max(spark, d):
    return rounded(P.min_max(means(spark, d), "event", "psi"))


@query(ctes("psi_counts") + PSI_CTE + """, s AS (SELECT sample, list(psi ORDER BY psi) AS v, count(*) AS n FROM psi GROUP BY sample), top AS (SELECT max(n) AS t FROM s),
 g AS (SELECT sample, v, n, t, j, CASE WHEN t > 1 THEN j * (n - 1) // (t - 1) ELSE 0 END AS k FROM s, top, range(0, (SELECT t FROM top)) r(j)),
 m AS (SELECT j, avg(v[k + 1] + CASE WHEN t > 1 AND k + 2 <= n THEN (j * (n - 1) / (t - 1)::DOUBLE - k) * (v[k + 2] - v[k + 1]) ELSE 0 END) AS mean FROM g GROUP BY j),
 r AS (SELECT sample, event, psi, n, t, (rank() OVER (PARTITION BY sample ORDER BY psi) - 1) * 2 + count(*) OVER (PARTITION BY sample, psi) - 1 AS r2 FROM psi JOIN s USING (sample), top),
 p AS (SELECT *, CASE WHEN n > 1 THEN r2 * (t - 1) ELSE t - 1 END AS up, CASE WHEN n > 1 THEN 2 * (n - 1) ELSE 2 END AS den FROM r)
 SELECT sample, event, round(psi + 1e-10, 6) AS psi, round(a.mean + coalesce((up % den) / den::DOUBLE * (b.mean - a.mean), 0) + 1e-10, 6) AS normalised
 FROM p JOIN m a ON a.j = up // den LEFT JOIN m b ON b.j = up // den + 1""")
def quantile_normalise(spark, d):
    return rounded(P.quantile_normalise(P.psi(psi_table(spark, d))).select("sample", "event", "psi", "normalised"), nudge=1e-10)


@query(ctes("counts") + """, o AS (SELECT sample, idx, mode, cnt, CASE mode WHEN 'SKIPPED' THEN '0' ELSE concat(up_off, ':', down_off) END AS "offset" FROM counts WHERE mode <> 'UNSPLICED'),
 i AS (SELECT idx, max("offset") AS initial FROM o GROUP BY idx) SELECT o.*, initial FROM o JOIN i USING (idx) WHERE initial = "offset" OR "offset" = '0'""")
def own_event_only(spark, d):
    c = counts(spark, d).where("mode <> 'UNSPLICED'")
    o = c.select("sample", "idx", "mode", "cnt", F.when(F.col("mode") == "SKIPPED", "0").otherwise(F.concat("up_off", F.lit(":"), "down_off")).alias("offset"))
    initial = o.groupBy("idx").agg(F.max("offset").alias("initial"))
    return P.own_event_only(o.join(initial, "idx"), "initial").select("sample", "idx", "mode", "cnt", "offset", "initial")
