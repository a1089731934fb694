"""Queries of the contrast operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoflow.operators import contrasts as K
from isoflow.operators import psi as P
from isoflow.plans import derive
from isoflow.plans.base import MEANS_CTE, PSI_CTE, ctes, query, rounded
from isoflow.plans.count_queries import _MAJOR, counts, means, psi_table
from isoflow.sources.scratch import written

LINEAGES = "SELECT n_nationkey AS condition, n_regionkey AS grp FROM {nation}"
_LINEAGE = ", g AS (SELECT n_nationkey AS condition, n_regionkey AS grp FROM nation), k AS (SELECT CAST(o.grp AS STRING) AS contrast, CASE WHEN o.grp = g.grp THEN 1 ELSE 2 END AS side, condition FROM g, (SELECT DISTINCT grp FROM g) o)"
_POOL = """, pool AS (SELECT contrast, event, sum(CASE side WHEN 1 THEN included END)::DOUBLE AS i1, sum(CASE side WHEN 1 THEN skipped END)::DOUBLE AS s1,
 sum(CASE side WHEN 2 THEN included END)::DOUBLE AS i2, sum(CASE side WHEN 2 THEN skipped END)::DOUBLE AS s2 FROM psi_counts JOIN k USING (condition) GROUP BY ALL)"""


def lineage_contrasts(spark, d):
    return K.groups_against_rest(derive.load(spark, d, LINEAGES))


@query("WITH c AS (SELECT n_nationkey AS condition FROM nation) SELECT concat(o.condition, '_all') AS contrast, CASE WHEN o.condition = c.condition THEN 1 ELSE 2 END AS side, c.condition FROM c, c o")
def one_against_rest(spark, d):
    return K.one_against_rest(derive.load(spark, d, LINEAGES))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def condition_pairs(spark, d):
    return K.condition_pairs(derive.load(spark, d, LINEAGES))


_PACKED = "array_to_string(list({c} ORDER BY sample), ',')"


@query(ctes("psi_counts") + f" SELECT condition, event, {_PACKED.format(c='included')} AS included, {_PACKED.format(c='skipped')} AS skipped FROM psi_counts GROUP BY ALL HAVING count(*) >= 2")
def pack_replicates(spark, d):
    packed = K.pack_replicates(psi_table(spark, d), ("condition", "event")).where(F.exists("included", lambda x: x.isNotNull()))
    several = psi_table(spark, d).groupBy("condition", "event").count().where("count >= 2").select("condition", "event")
    return packed.join(several, ["condition", "event"]).select("condition", "event", *[F.array_join(c, ",").alias(c) for c in ("included", "skipped")])


_CONTRAST = ctes("psi_counts") + _LINEAGE + """, r AS (SELECT *, included / nullif(included + skipped, 0)::DOUBLE AS psi FROM psi_counts JOIN k USING (condition)),
 m AS (SELECT contrast, event, avg(CASE side WHEN 1 THEN psi END) - avg(CASE side WHEN 2 THEN psi END) AS diff FROM r GROUP BY ALL HAVING abs(diff) >= 0.03)"""


@query(_CONTRAST + """, l AS (SELECT contrast, event, side, array_to_string(list(included ORDER BY sample), ',') AS i, array_to_string(list(skipped ORDER BY sample), ',') AS s FROM r GROUP BY ALL)
 SELECT m.contrast, m.event, a.i AS i1, a.s AS s1, b.i AS i2, b.s AS s2, round(diff, 6) AS diff FROM m JOIN l a ON a.contrast = m.contrast AND a.event = m.event AND a.side = 1 JOIN l b ON b.contrast = m.contrast AND b.event = m.event AND b.side = 2""")
def contrast_counts(spark, d):
    out = K.contrast_counts(psi_table(spark, d), lineage_contrasts(spark, d), 0.03)
    return rounded(out.select("contrast", "event", *[F.array_join(c, ",").alias(c) for c in ("i1", "s1", "i2", "s2")], "diff"))


_G = """, t AS (SELECT *, i1 + s1 + i2 + s2 AS n FROM pool)
 SELECT contrast, event, round(i1 / (i1 + s1), 6) AS psi1, round(i2 / (i2 + s2), 6) AS psi2,
 round(2 * (i1 * ln(i1 * n / ((i1 + s1) * (i1 + i2))) + s1 * ln(s1 * n / ((i1 + s1) * (s1 + s2))) + i2 * ln(i2 * n / ((i2 + s2) * (i1 + i2))) + s2 * ln(s2 * n / ((i2 + s2) * (s1 + s2)))), 4) AS g FROM t"""


@query(ctes("psi_counts") + _LINEAGE + _POOL + _G)
def pooled_g(spark, d):
    out = K.pooled_g(psi_table(spark, d), lineage_contrasts(spark, d))
    return out.select("contrast", "event", F.round("psi1", 6).alias("psi1"), F.round("psi2", 6).alias("psi2"), F.round("g", 4).alias("g"))


_SLOPE = "coalesce(i1 / nullif(m + shift, 0), 0) - coalesce(s1 / nullif(1 - m - shift, 0), 0) + coalesce(i2 / nullif(m, 0), 0) - coalesce(s2 / nullif(1 - m, 0), 0)"
_L = "(CASE WHEN i1 > 0 THEN i1 * ln({a}) ELSE 0 END + CASE WHEN s1 > 0 THEN s1 * ln(1 - ({a})) ELSE 0 END + CASE WHEN i2 > 0 THEN i2 * ln({b}) ELSE 0 END + CASE WHEN s2 > 0 THEN s2 * ln(1 - ({b})) ELSE 0 END)"


@query("WITH RECURSIVE" + (ctes("psi_counts") + _LINEAGE + _POOL)[4:] + f""", t AS (SELECT *, i1 / (i1 + s1) AS p1, i2 / (i2 + s2) AS p2, CASE WHEN i1 / (i1 + s1) > i2 / (i2 + s2) THEN 0.02 ELSE -0.02 END::DOUBLE AS shift FROM pool),
 h AS (SELECT *, greatest(0.0, -shift)::DOUBLE AS low, least(1.0, 1 - shift)::DOUBLE AS high, 0 AS k FROM t
  UNION ALL SELECT * EXCLUDE (low, high, k, m), CASE WHEN {_SLOPE} > 0 THEN m ELSE low END, CASE WHEN {_SLOPE} > 0 THEN high ELSE m END, k + 1 FROM (SELECT *, (low + high) / 2 AS m FROM h WHERE k < 60)),
 e AS (SELECT *, (low + high) / 2 AS q FROM h WHERE k = 60)
 SELECT contrast, event, round(p1, 6) AS psi1, round(p2, 6) AS psi2, round(CASE WHEN abs(p1 - p2) > 0.02 THEN greatest(0, 2 * ({_L.format(a='p1', b='p2')} - {_L.format(a='q + shift', b='q')})) ELSE 0 END, 4) + 0.0 AS g FROM e""")
def interval_g(spark, d):
    """The statistic of a difference beyond 0.02 (the given shares lie close together)."""
    out = K.pooled_g(psi_table(spark, d), lineage_contrasts(spark, d), 0.02)
    return out.select("contrast", "event", F.round("psi1", 6).alias("psi1"), F.round("psi2", 6).alias("psi2"), (F.round("g", 4) + 0.0).alias("g"))


@query()
def differential_test(spark, d):
    """Test of a difference beyond 0.1 with FDR; the tail has no SQL twin (the statistic has: interval_g)."""
    return rounded(K.differential_test(psi_table(spark, d), lineage_contrasts(spark, d)))


_LISTS = """, e AS (SELECT m.contrast, m.event, list(included ORDER BY sample) FILTER (side = 1) AS i1, list(skipped ORDER BY sample) FILTER (side = 1) AS s1, list(included ORDER BY sample) FILTER (side = 2) AS i2, list(skipped ORDER BY sample) FILTER (side = 2) AS s2
 FROM m JOIN r ON r.contrast = m.contrast AND r.event = m.event GROUP BY ALL),
 z AS (SELECT contrast, event, list_transform(list_zip(i1, s1), lambda x: round(x[1] / (x[1] + x[2])::DOUBLE + 1e-10, 3)) AS p1, list_transform(list_zip(i2, s2), lambda x: round(x[1] / (x[1] + x[2])::DOUBLE + 1e-10, 3)) AS p2,
 round(list_avg(list_transform(list_zip(i1, s1), lambda x: x[1] + x[2])), 0) AS count1, round(list_avg(list_transform(list_zip(i2, s2), lambda x: x[1] + x[2])), 0) AS count2 FROM e)"""


def enriched(spark, d):
    packed = K.contrast_counts(psi_table(spark, d), lineage_contrasts(spark, d), 0.03)
    return K.enrich_results(packed.drop("diff"))


@query(_CONTRAST + _LISTS + " SELECT contrast, event, round(list_avg(p1), 2) AS mean1, round(list_avg(p2), 2) AS mean2, list_min(p1) AS min1, list_max(p1) AS max1, list_min(p2) AS min2, list_max(p2) AS max2, count1, count2 FROM z WHERE count1 >= 30 AND count2 >= 30")
def enrich_results(spark, d):
    packed = K.contrast_counts(psi_table(spark, d), lineage_contrasts(spark, d), 0.03).drop("diff")
    nudged = lambda i, s: F.zip_with(i, s, lambda a, b: F.round(F.try_divide(a, a + b) + 1e-10, 3))
    out = K.enrich_results(packed).withColumns({"psi1": nudged("i1", "s1"), "psi2": nudged("i2", "s2")})
    means_ = {f"mean{k}": F.round(K.list_mean(F.col(f"psi{k}")), 2) for k in (1, 2)}
    return out.withColumns(means_).select("contrast", "event", "mean1", "mean2", *[f(f"psi{k}").alias(f"{n}{k}") for k in (1, 2) for n, f in (("min", F.array_min), ("max", F.array_max))], "count1", "count2")


RESULTS = "SELECT CAST(l_suppkey % 10 AS STRING) AS contrast, p_brand AS event, CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS fdr, CAST(l_orderkey % 200 AS DOUBLE) / 100 - 1 AS diff FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"
_RESULTS = f"WITH res AS ({derive.sql(RESULTS)})"


@query(_RESULTS + " SELECT contrast, CASE WHEN fdr < 0.05 AND diff > 0.1 THEN 'up' WHEN fdr < 0.05 AND diff < -0.1 THEN 'down' ELSE 'ns' END AS call, count(*) AS n FROM res GROUP BY ALL")
def volcano_calls(spark, d):
    return K.volcano_calls(derive.load(spark, d, RESULTS))


@query(_RESULTS + """, s AS (SELECT * FROM res WHERE fdr < 0.01), x AS (SELECT event FROM s WHERE contains(contrast, '1') GROUP BY event HAVING count(*) >= 4 UNION SELECT event FROM s WHERE contains(contrast, '2') GROUP BY event HAVING count(*) >= 4)
 SELECT * FROM s WHERE event NOT IN (SELECT event FROM x)""")
def exclude_control_hits(spark, d):
    return K.exclude_control_hits(derive.load(spark, d, RESULTS).where("fdr < 0.01"), ["1", "2"])


@query(ctes("psi_counts") + PSI_CTE + """, b AS (SELECT event, condition, avg(psi) FILTER (sample % 2 = 0) AS o, avg(psi) FILTER (sample % 2 = 1) AS n FROM psi GROUP BY ALL) SELECT DISTINCT event FROM b WHERE abs(n - o) >= 0.2""")
def batch_blacklist(spark, d):
    batches = derive.load(spark, d, "SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS batch FROM {supplier}")
    return K.batch_blacklist(P.psi(psi_table(spark, d)), batches, 0.2)


@query(_RESULTS + " SELECT event, count(DISTINCT contrast) AS n_contrasts FROM res WHERE fdr < 0.002 GROUP BY event HAVING count(DISTINCT contrast) >= 8")
def recurrent_events(spark, d):
    return K.recurrent_events(derive.load(spark, d, RESULTS).where("fdr < 0.002"), 8)


_PAIRS = _MAJOR + """, pairs AS (SELECT m.idx, m.up_off AS mu, m.down_off AS md, e.up_off AS nu, e.down_off AS nd FROM major m JOIN (SELECT DISTINCT idx, up_off, down_off FROM counts WHERE mode = 'INCLUDED') e ON m.idx = e.idx AND (m.up_off <> e.up_off OR m.down_off <> e.down_off)),
 inc AS (SELECT sample, idx, up_off, down_off, sum(cnt) AS c FROM counts WHERE mode = 'INCLUDED' GROUP BY ALL),
 sh2 AS (SELECT s.condition, s.sample, p.*, coalesce(a.c, 0) / nullif(coalesce(a.c, 0) + coalesce(b.c, 0), 0)::DOUBLE AS share FROM pairs p, (SELECT DISTINCT sample, condition FROM counts) s
 LEFT JOIN inc a ON a.sample = s.sample AND a.idx = p.idx AND a.up_off = mu AND a.down_off = md LEFT JOIN inc b ON b.sample = s.sample AND b.idx = p.idx AND b.up_off = nu AND b.down_off = nd)"""


@query(ctes("counts") + _PAIRS + _LINEAGE.replace(", k AS", ", k AS") + """ SELECT contrast, idx, mu AS major_up, md AS major_down, nu AS minor_up, nd AS minor_down, round(avg(share) FILTER (side = 1), 6) AS share1, round(avg(share) FILTER (side = 2), 6) AS share2
 FROM sh2 JOIN k USING (condition) GROUP BY ALL HAVING abs(avg(share) FILTER (side = 1) - avg(share) FILTER (side = 2)) >= 0.2""")
def altss_contrast(spark, d):
    c = written(counts(spark, d), "counts")
    included = c.where("mode = 'INCLUDED'")
    pairs = written(P.event_pairs(P.major_event_by_share(c), included), "pairs")
    return rounded(K.altss_contrast_of_sums(K.altss_sums(included, pairs), lineage_contrasts(spark, d), 0.2))


@query(ctes("counts") + " SELECT sample, idx, up_off, down_off, CAST(sum(cnt) OVER w - cnt AS BIGINT) AS others, round(cnt / sum(cnt) OVER w + 1e-10, 6) AS share FROM counts WHERE mode = 'INCLUDED' WINDOW w AS (PARTITION BY sample, idx)")
def other_splice_contrast(spark, d):
    return rounded(K.other_splice_share(counts(spark, d)).select("sample", "idx", "up_off", "down_off", "others", "share"), nudge=1e-10)


@query(ctes("counts") + " SELECT DISTINCT idx, up_off, down_off FROM counts WHERE mode = 'INCLUDED' AND condition IN (0, 1, 2) AND (idx, up_off, down_off) NOT IN (SELECT (idx, up_off, down_off) FROM counts WHERE mode = 'INCLUDED' AND condition NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17))")
def condition_only_events(spark, d):
    c = counts(spark, d).where("mode = 'INCLUDED' and (condition in (0, 1, 2) or condition > 17)")
    return K.condition_only_events(c, [0, 1, 2])


@query(ctes("counts") + """, s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY sample, idx) AS x FROM counts WHERE mode = 'INCLUDED'),
 f AS (SELECT idx, up_off, down_off, avg(x) FILTER (condition = 1) AS a, avg(x) FILTER (condition = 2) AS b FROM s WHERE condition IN (1, 2) GROUP BY ALL)
 SELECT idx, up_off, down_off, round(a, 6) AS share1, round(b, 6) AS share2, round(a - b, 6) AS diff, round(log2(a / b), 6) AS log2_ratio FROM f WHERE abs(a - b) >= 0""")
def fraction_diff(spark, d):
    return rounded(K.fraction_diff(P.included_fraction(counts(spark, d)), 1, 2))


@query(ctes("psi_counts") + MEANS_CTE + """, t AS (SELECT event, condition, psi, CASE WHEN condition % 2 = 0 THEN 1 - psi END AS rev FROM means),
 b AS (SELECT event, condition % 5 AS target, condition, greatest(psi, rev) AS best FROM t) SELECT event, condition, target, round(best, 6) AS best FROM b QUALIFY row_number() OVER (PARTITION BY target ORDER BY best DESC NULLS LAST, event) <= 3""")
def validation_shortlist(spark, d):
    t = means(spark, d).withColumns({"rev": F.when(F.col("condition") % 2 == 0, 1 - F.col("psi")), "target": F.col("condition") % 5})
    return rounded(K.validation_shortlist(t, ["psi", "rev"], n=3).select("event", "condition", "target", "best"))


@query(ctes("psi_counts") + MEANS_CTE + " SELECT event, round(avg(psi) FILTER (condition = 3), 6) AS target_mean, round(avg(psi) FILTER (condition <> 3), 6) AS rest_mean, round(avg(psi) FILTER (condition = 3) - avg(psi) FILTER (condition <> 3), 6) AS diff FROM means GROUP BY event")
def target_specific(spark, d):
    return rounded(K.target_specific(means(spark, d), 3))


@query("""WITH c AS (SELECT n_name AS condition FROM nation), x AS (SELECT 'america' AS contrast, 'UNITED|CANADA|BRAZIL|PERU' AS a, NULL AS b UNION ALL SELECT 'i_u', '^I', '^U' UNION ALL SELECT 'both', 'AN', 'IRAN|IRAQ')
 SELECT contrast, 1 AS side, condition FROM c, x WHERE regexp_matches(condition, a) UNION ALL SELECT contrast, 2, condition FROM c, x WHERE CASE WHEN b IS NULL THEN NOT regexp_matches(condition, a) ELSE regexp_matches(condition, b) END""")
def pattern_contrasts(spark, d):
    names = derive.load(spark, d, "SELECT n_name AS condition FROM {nation}")
    return K.pattern_contrasts(names, [("america", "UNITED|CANADA|BRAZIL|PERU", None), ("i_u", "^I", "^U"), ("both", "AN", "IRAN|IRAQ")])
