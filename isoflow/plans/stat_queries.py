"""Queries of the specificity and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoflow.operators import psi as P
from isoflow.operators import specificity as S
from isoflow.operators import stats as T
from isoflow.plans import derive
from isoflow.plans.base import MEANS_CTE, PSI_CTE, ctes, query, rounded
from isoflow.plans.count_queries import means, psi_table

_AGG = ", a AS (SELECT event, count(psi)::DOUBLE AS n, sum(psi) AS s, max(psi) AS hi, min(psi) AS lo FROM means GROUP BY event)"
_SCORES = """round(CASE WHEN n >= {m} THEN (n - s / hi) / (n - 1) END, 6) AS tau, round(CASE WHEN n >= {m} THEN (n - (n - s) / (1 - lo)) / (n - 1) END, 6) AS tau_reverse,
 round(CASE WHEN n >= {m} THEN 2 * (n - (s + n) / (hi + 1)) / (n - 1) END, 6) AS upsilon, round(CASE WHEN n >= {m} THEN 2 * (n - (2 * n - s) / (2 - lo)) / (n - 1) END, 6) AS upsilon_reverse"""


@query(ctes("psi_counts") + MEANS_CTE + _AGG + " SELECT event, " + _SCORES.format(m=20) + " FROM a")
def specificity_scores(spark, d):
    return rounded(S.specificity_scores(means(spark, d)))


@query(ctes("psi_counts") + MEANS_CTE + _AGG + ", sc AS (SELECT event, " + _SCORES.format(m=20) + """ FROM a),
 su AS (SELECT event, min(psi) AS lo, max(psi) AS hi, avg(psi) AS mean, arg_min(condition, (-psi, condition)) AS maxc, arg_min(condition, (psi, condition)) AS minc, count(psi) AS n FROM means GROUP BY event)
 SELECT event, tau, tau_reverse, upsilon, upsilon_reverse, round(hi, 6) AS row_max, round(lo, 6) AS row_min, round(mean, 6) AS row_mean, 25 - n AS n_missing,
 coalesce(upsilon >= 0.2 OR upsilon_reverse >= 0.2 OR (tau >= 0.2 AND hi - lo >= 0.1) OR (tau_reverse >= 0.2 AND hi - lo >= 0.1), false) AS specific,
 CASE WHEN coalesce(upsilon >= 0.2 OR tau >= 0.2, false) THEN maxc ELSE minc END AS target FROM sc JOIN su USING (event) WHERE 25 - n < 10""")
def specificity_table(spark, d):
    out = S.specificity_table(means(spark, d), 25, high=0.2, min_range=0.1)
    return rounded(out.select("event", "tau", "tau_reverse", "upsilon", "upsilon_reverse", "row_max", "row_min", "row_mean", "n_missing", "specific", "target"))


@query(ctes("psi_counts", "lines") + MEANS_CTE.replace("means AS", "cm AS") + ", means AS (SELECT event, lineage AS grp, avg(psi) AS psi FROM cm JOIN lines USING (condition) GROUP BY ALL)"
       + _AGG.replace("SELECT event,", "SELECT event, ") + " SELECT event, " + _SCORES.format(m=3) + " FROM a")
def specificity_by_group(spark, d):
    groups = derive.load(spark, d, derive.NATION).select("condition", F.col("lineage").alias("grp"))
    return rounded(S.specificity_by_group(means(spark, d), groups, 3))


_METRICS = """, x0 AS (SELECT event, psi AS x, row_number() OVER (PARTITION BY event ORDER BY psi) AS r, count(*) OVER w AS n, sum(psi) OVER w AS s, sum(psi * psi) OVER w AS ss, median(psi) OVER w AS m,
 avg(psi) OVER w AS mean, stddev_samp(psi) OVER w AS sd FROM means WINDOW w AS (PARTITION BY event)),
 x1 AS (SELECT *, abs(x - m) AS dev, x / s AS p FROM x0), x2 AS (SELECT *, median(dev) OVER (PARTITION BY event) AS mad FROM x1),
 x3 AS (SELECT *, CASE WHEN abs((x - m) / (5 * mad + 1e-4)) <= 1 THEN pow(1 - pow((x - m) / (5 * mad + 1e-4), 2), 2) ELSE 0 END AS w FROM x2),
 x4 AS (SELECT *, abs(x - sum(x * w) OVER (PARTITION BY event) / sum(w) OVER (PARTITION BY event)) AS far FROM x3), x5 AS (SELECT *, far / sum(far) OVER (PARTITION BY event) AS pf FROM x4),
 b AS (SELECT event, any_value(n)::DOUBLE AS n, any_value(s) AS s, max(x) AS hi, any_value(mean) AS mean, any_value(sd) AS sd, count(*) FILTER (x > 0.15) AS above, sum((2 * r - n - 1) * x) AS g, sum(p * p) AS simpson,
 sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS h, sum(CASE WHEN pf > 0 THEN pf * log2(pf) ELSE 0 END) AS hf, stddev_samp(x / sqrt(ss)) AS ssd, max(x / sqrt(ss)) AS spm, max(p) AS tsi,
 sum((p + 1.0 / n) / 2 * log2((p + 1.0 / n) / 2)) AS hm FROM x5 GROUP BY event)
 SELECT event, round((n - above) / (n - 1), 6) AS counts, round((n - s / hi) / (n - 1), 6) AS tau, round(g / ((n - 1) * s), 6) AS gini, round((simpson - 1 / n) / (1 - 1 / n), 6) AS simpson,
 round((log2(n) + h) / log2(n), 6) AS shannon, round((log2(n) + hf) / log2(n), 6) AS roku, round(ssd * sqrt(n), 6) AS spm_dpm, round(tsi, 6) AS tsi,
 round(((hi - mean) / sd + (n - 1) / sqrt(n)) / (2 * (n - 1) / sqrt(n)), 6) AS z_score, round(spm, 6) AS spm, round(1 - sqrt(greatest(0, (h - log2(n)) / 2 - hm)), 6) AS jss FROM b"""


@query(ctes("psi_counts") + MEANS_CTE + _METRICS)
def specificity_metrics(spark, d):
    return rounded(S.specificity_metrics(means(spark, d)))


PVALUES = "SELECT l_suppkey AS contrast, l_orderkey AS event, l_linenumber AS line, CAST(l_partkey % 997 AS DOUBLE) / 997 AS p FROM {lineitem}"
_BH = """, r AS (SELECT *, p * count(*) OVER (PARTITION BY contrast) / row_number() OVER (PARTITION BY contrast ORDER BY p, event, line) AS raw FROM pv)
 SELECT contrast, event, line, round(p, 6) AS p, round(least(1, min(raw) OVER (PARTITION BY contrast ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS fdr FROM r"""


@query(f"WITH pv AS ({derive.sql(PVALUES)})" + _BH)
def bh_adjust(spark, d):
    return rounded(T.bh_adjust(derive.load(spark, d, PVALUES), by=("contrast",)))


LINES = "SELECT l_returnflag AS grp, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM {lineitem}"


@query(f"WITH t AS ({derive.sql(LINES)})" + """, r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2 AS ry FROM t)
 SELECT grp, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r GROUP BY grp""")
def correlate(spark, d):
    return rounded(T.correlate(derive.load(spark, d, LINES), "x", "y", by=("grp",)))


@query(ctes("psi_counts") + MEANS_CTE + " SELECT a.condition AS a, b.condition AS b, round(corr(a.psi, b.psi), 6) AS r, count(*) AS n FROM means a JOIN means b ON a.event = b.event AND a.condition <= b.condition GROUP BY ALL")
def correlation_matrix(spark, d):
    return rounded(T.correlation_matrix(means(spark, d)))


@query(ctes("psi_counts") + PSI_CTE + " SELECT a.condition, a.sample AS a, b.sample AS b, round(pow(corr(a.psi, b.psi), 2), 6) AS r2, count(*) AS n FROM psi a JOIN psi b ON a.event = b.event AND a.condition = b.condition AND a.sample < b.sample GROUP BY ALL")
def replicate_r2(spark, d):
    return rounded(T.replicate_r2(P.psi(psi_table(spark, d))))


_GENES = " SELECT event, gene, round(corr(psi, value), 6) AS r, count(*) AS n FROM means JOIN expression ON condition = cell_line GROUP BY ALL"


@query(ctes("psi_counts", "expression") + MEANS_CTE + _GENES)
def gene_event_correlation(spark, d):
    return rounded(T.gene_event_correlation(means(spark, d), derive.load(spark, d, derive.EXPRESSION_SPARK)))


@query(ctes("psi_counts", "expression") + MEANS_CTE + ", c AS (" + _GENES + ") SELECT gene, count(*) FILTER (abs(r) > 0.5) AS num_high FROM c GROUP BY gene")
def high_correlations(spark, d):
    table = rounded(T.gene_event_correlation(means(spark, d), derive.load(spark, d, derive.EXPRESSION_SPARK)))
    return T.high_correlations(table)


@query(ctes("psi_counts") + " SELECT *, rank() OVER (PARTITION BY condition ORDER BY included DESC) AS rank FROM psi_counts QUALIFY rank <= 3")
def top_with_ties(spark, d):
    return T.top_with_ties(psi_table(spark, d), "condition", "included", 3).withColumn("rank", F.col("rank").cast("long"))


@query(ctes("psi_counts") + MEANS_CTE + " SELECT event, condition, round(psi, 6) AS psi, row_number() OVER (PARTITION BY condition ORDER BY psi DESC, event) AS rank FROM means QUALIFY rank <= 5")
def top_n_per_group(spark, d):
    return rounded(T.top_n_per_group(means(spark, d), "condition", "psi", 5, "event").withColumn("rank", F.col("rank").cast("long")))


@query(ctes("psi_counts") + MEANS_CTE + """, v AS (SELECT event, round(var_samp(psi), 9) AS v FROM means GROUP BY event)
 SELECT event, round(v, 6) AS v FROM v QUALIFY row_number() OVER (ORDER BY v DESC, event) <= (SELECT ceil(count(*) * 0.2) FROM v)""")
def top_fraction(spark, d):
    variances = means(spark, d).groupBy("event").agg(F.round(F.var_samp("psi"), 9).alias("v"))
    return rounded(T.top_fraction(variances, "v", 0.2, "event"))


SERIES = "SELECT l_suppkey AS grp, CAST(l_orderkey % 60 AS INT) AS pos, avg(l_discount) * 10 - 0.5 AS effect FROM {lineitem} GROUP BY 1, 2"
_SERIES = f"WITH s0 AS ({derive.sql(SERIES)}), series AS (SELECT grp, pos, round(effect, 9) AS effect FROM s0)"


def series(spark, d):
    return derive.load(spark, d, SERIES).withColumn("effect", F.round("effect", 9))


@query(_SERIES + """, f AS (SELECT *, CASE WHEN effect > 0.05 THEN 1 WHEN effect < -0.05 THEN -1 ELSE 0 END AS flag FROM series),
 i AS (SELECT *, pos - row_number() OVER (PARTITION BY grp, flag ORDER BY pos) AS island FROM f WHERE flag <> 0)
 SELECT grp, CAST(flag AS INT) AS flag, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS len, round(avg(effect), 6) AS mean FROM i GROUP BY grp, flag, island HAVING count(*) >= 3 AND avg(effect) * flag >= 0.1""")
def call_blocks(spark, d):
    flag = F.when(F.col("effect") > 0.05, 1).when(F.col("effect") < -0.05, -1).otherwise(0)
    return rounded(T.call_blocks(series(spark, d).withColumn("flag", flag), "flag", "grp", "pos", "effect", 3, 0.1))


@query(_SERIES + """, q AS (SELECT grp, quantile_cont(effect, 0.25) AS a, median(effect) AS b, quantile_cont(effect, 0.75) AS c FROM series GROUP BY grp)
 SELECT grp, pos, round((effect - b) / CASE WHEN c - a > 0 THEN (c - a) / 1.349 ELSE 1e-6 END, 6) + 0.0 AS z FROM series JOIN q USING (grp)""")
def robust_z(spark, d):
    return rounded(T.robust_z(series(spark, d), "grp", "effect").drop("effect")).withColumn("z", F.col("z") + 0.0)


@query(_SERIES + """ SELECT grp, pos, round(lag(effect, 2) OVER w + 2 * lag(effect, 1) OVER w + 3 * effect + 2 * lead(effect, 1) OVER w + lead(effect, 2) OVER w, 6) AS smooth
 FROM series WINDOW w AS (PARTITION BY grp ORDER BY pos)""")
def smooth_positions(spark, d):
    return rounded(T.smooth_positions(series(spark, d), "grp", "pos", "effect").drop("effect"))


_KERNEL = "list_transform(range(-4, 5), lambda k: exp(-0.5 * pow(k / 1.1, 2)))"


@query(_SERIES + f""", a AS (SELECT grp, list(effect ORDER BY pos) AS v, list(pos ORDER BY pos) AS p, count(*) AS n FROM series GROUP BY grp),
 e AS (SELECT grp, v, p, n, unnest(range(0, n)) AS i FROM a), k AS (SELECT *, unnest(range(-4, 5)) AS k FROM e),
 m AS (SELECT *, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS j FROM k)
 SELECT grp, p[i + 1] AS pos, round(sum(exp(-0.5 * pow(k / 1.1, 2)) * v[CASE WHEN j < n THEN j ELSE 2 * n - 1 - j END + 1]) / list_sum({_KERNEL}), 6) AS smooth
 FROM m GROUP BY grp, p[i + 1], i""")
def gaussian_smooth(spark, d):
    return rounded(T.gaussian_smooth(series(spark, d), "grp", "pos", "effect").drop("effect"))


@query(ctes("psi_counts") + MEANS_CTE + " SELECT x::DOUBLE AS x, round((SELECT count(*) FILTER (psi <= x) / count(psi)::DOUBLE FROM means), 6) AS share FROM (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8]) AS x)")
def ecdf(spark, d):
    return rounded(T.ecdf(means(spark, d), "psi", [0.2, 0.4, 0.5, 0.6, 0.8]))


@query(ctes("psi_counts") + PSI_CTE + """, c AS (SELECT unnest([0.3, 0.45, 0.5, 0.55, 0.7])::DOUBLE AS cut), t AS (SELECT psi, included > 200 AS truth FROM psi),
 g AS (SELECT cut, count(*) FILTER (truth) AS pos, count(*) FILTER (psi >= cut AND truth) AS tp, count(*) FILTER (psi >= cut) AS pp FROM t, c GROUP BY cut)
 SELECT cut, tp, round(tp / nullif(pp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(pos, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(pp + pos, 0)::DOUBLE, 6) AS f1 FROM g""")
def threshold_sweep(spark, d):
    table = P.psi(psi_table(spark, d)).withColumn("truth", F.col("included") > 200)
    return rounded(T.threshold_sweep(table, "psi", "truth", [0.3, 0.45, 0.5, 0.55, 0.7]))


@query(f"WITH t AS ({derive.sql(LINES)}), s AS (SELECT *, CAST(x % 3 AS INT) AS seed FROM t)" + """, r AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY x) + (count(*) OVER (PARTITION BY seed, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY seed ORDER BY y) + (count(*) OVER (PARTITION BY seed, y) - 1) / 2 AS ry FROM s),
 e AS (SELECT seed, corr(x, y) AS p, corr(rx, ry) AS s FROM r GROUP BY seed)
 SELECT round(avg(p), 6) AS pearson_mean, round(stddev_pop(p), 6) AS pearson_sd, round(avg(s), 6) AS spearman_mean, round(stddev_pop(s), 6) AS spearman_sd, count(*) AS n_seeds FROM e""")
def evaluate_predictions(spark, d):
    table = derive.load(spark, d, LINES).withColumn("seed", (F.col("x") % 3).cast("int"))
    return rounded(T.evaluate_predictions(table, "seed", "x", "y"))


@query()
def group_split(spark, d):
    """Split of the reads by barcode; a hash split has no SQL twin."""
    return T.group_split(derive.load(spark, d, derive.MOLECULES), "cb")


@query()
def correlation_pvalues(spark, d):
    """Gene by event correlations with p-values and FDR; the t tail has no SQL twin."""
    c = T.gene_event_correlation(means(spark, d), derive.load(spark, d, derive.EXPRESSION_SPARK))
    return rounded(T.bh_adjust(c.withColumn("p", T.correlation_p(F.col("r"), F.col("n"))), by=("gene",)))
