"""Queries of the sequence, mutagenesis, imaging and model operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoflow.functions import keys as N
from isoflow.functions import sequences as Q
from isoflow.operators import counts as C
from isoflow.operators import psi as P
from isoflow.operators import sequences as S
from isoflow.operators import stats as T
from isoflow.plans import derive
from isoflow.plans.base import MEANS_CTE, ctes, pieces_cte, query, rounded
from isoflow.plans.count_queries import counts, means
from isoflow.sources.scratch import written


def seqs(spark, d):
    return derive.load(spark, d, derive.SEQUENCES_SPARK)


def pieces(spark, d, size):
    """Consecutive windows of every whole sequence, keyed by ``doc_id, window``."""
    s = seqs(spark, d)
    return s.select("doc_id", "lang", F.explode(Q.windows(F.col("seq"), size)).alias("w")).select("doc_id", "lang", "w.*")


def satmut(spark, d):
    return derive.load(spark, d, derive.SATMUT)


@query(ctes("sequences") + " SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM sequences")
def reverse_complement(spark, d):
    return seqs(spark, d).select("doc_id", Q.reverse_complement(F.col("seq")).alias("rc"))


_KMERS = ", km AS (SELECT doc_id, lang, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM sequences WHERE len(seq) >= {k}), k AS (SELECT doc_id, lang, i, substr(seq, i, {k}) AS kmer, len(seq) - {k} + 1 AS m FROM km)"


@query(ctes("sequences") + _KMERS.format(k=4) + " SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY kmer")
def kmers(spark, d):
    return S.kmer_totals(seqs(spark, d), 4)


@query(ctes("sequences") + _KMERS.format(k=3) + """, n AS (SELECT lang, count(*) AS n FROM sequences WHERE len(seq) >= 3 GROUP BY lang), c AS (SELECT lang, doc_id, m, kmer, count(*) AS c FROM k GROUP BY ALL)
 SELECT lang, kmer, round(sum(c / m::DOUBLE) / any_value(n), 6) AS frequency FROM c JOIN n USING (lang) GROUP BY lang, kmer""")
def kmer_frequency(spark, d):
    return rounded(S.kmer_frequency(seqs(spark, d)))


_ENRICH = _KMERS.format(k=4) + """, g AS (SELECT s.doc_id, quality = 0 AS g FROM sequences s JOIN labels USING (doc_id)),
 x AS (SELECT kmer, count(DISTINCT doc_id) FILTER (g) AS a, count(DISTINCT doc_id) FILTER (NOT g) AS c FROM k JOIN g USING (doc_id) GROUP BY kmer)
 SELECT kmer, a, (SELECT count(*) FROM g WHERE g) - a AS b, c, (SELECT count(*) FROM g WHERE NOT g) - c AS d FROM x"""


def quality_groups(spark, d):
    labels = derive.load(spark, d, "SELECT doc_id, quality = 0 AS grp FROM {labels}")
    return seqs(spark, d).join(labels, "doc_id")


@query(ctes("sequences") + _ENRICH)
def kmer_enrichment(spark, d):
    return S.kmer_enrichment(quality_groups(spark, d))


@query()
def kmer_test(spark, d):
    """k-mer counts with Fisher's test and FDR; the test has no SQL twin."""
    return rounded(S.kmer_test(quality_groups(spark, d)))


@query()
def kmer_background(spark, d):
    """k-mer counts of random draws; the draws have no SQL twin."""
    return S.kmer_background(seqs(spark, d), 5, 50)


MOTIFS = ["GCAUG", "YCAY", "UGUNNR"]
_HITS = """, hits AS (SELECT doc_id, lang, seq, unnest([{'motif': 'GCAUG', 'n': len(regexp_extract_all(seq, 'GCATG'))}, {'motif': 'YCAY', 'n': len(regexp_extract_all(seq, '[CT]CA[CT]'))}, {'motif': 'UGUNNR', 'n': len(regexp_extract_all(seq, 'TGT[ACGT][ACGT][AG]'))}]) AS h FROM sequences)"""


@query(ctes("sequences") + _HITS + " SELECT doc_id, h.motif AS motif, CAST(h.n AS INT) AS n, h.n > 0 AS present FROM hits")
def motif_hits(spark, d):
    return S.motif_hits(seqs(spark, d).select("doc_id", "seq"), MOTIFS).drop("seq")


@query(ctes("sequences") + """, p AS (SELECT lang, seq, unnest(range(1, len(seq) - 2)) AS i FROM sequences WHERE len(seq) >= 4), n AS (SELECT lang, count(*) AS n FROM sequences GROUP BY lang)
 SELECT lang, CAST(i AS INT) AS position, round(count(*) / any_value(n)::DOUBLE + 1e-10, 6) AS share FROM p JOIN n USING (lang) WHERE regexp_full_match(substr(seq, i, 4), '[CT]CA[CT]') GROUP BY lang, i""")
def motif_profile(spark, d):
    return rounded(S.motif_profile(seqs(spark, d), "YCAY", 4), nudge=1e-10)


@query(ctes("sequences") + """, m AS (SELECT max(len(seq)) AS l, greatest(3, CAST(ceil(round(max(len(seq)) * 0.1, 9)) AS BIGINT)) AS w FROM sequences),
 p AS (SELECT lang, seq, unnest(range(1, len(seq) - 2)) AS i FROM sequences WHERE len(seq) >= 4), c AS (SELECT lang, i, count(*) AS n FROM p WHERE regexp_full_match(substr(seq, i, 4), '[CT]CA[CT]') GROUP BY ALL),
 g AS (SELECT lang, i, l, w, CAST(ceil(w / 2.0) AS BIGINT) AS mid, CAST(floor(w / 2.0) AS BIGINT) AS aft FROM (SELECT DISTINCT lang FROM sequences), m, unnest(range(1, l + 1)) t(i)),
 d AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (lang, i)),
 s AS (SELECT *, sum(n * i) OVER u - (i + aft - w) * sum(n) OVER u AS rise, coalesce((i + aft + 1) * sum(n) OVER f - sum(n * i) OVER f, 0) AS fall FROM d
  WINDOW u AS (PARTITION BY lang ORDER BY i ROWS BETWEEN (w - 1 - aft) PRECEDING AND (w - aft - mid) PRECEDING), f AS (PARTITION BY lang ORDER BY i ROWS BETWEEN (aft - w + mid + 1) FOLLOWING AND aft FOLLOWING))
 SELECT lang, CAST(i AS INT) AS position, n, CASE WHEN i + aft - w >= 0 AND i + aft <= l THEN round((rise + fall) / (mid * (mid + 1) / 2 + (w - mid) * (w - mid + 1) / 2)::DOUBLE + 1e-10, 6) END AS smooth FROM s""")
def motif_counts_smoothed(spark, d):
    return rounded(S.motif_counts_smoothed(seqs(spark, d), "YCAY", 4), nudge=1e-10)


@query()
def motif_test(spark, d):
    """motif_ttest with one-sided p-values and FDR; the tail has no SQL twin."""
    chars = derive.load(spark, d, "SELECT doc_id, CAST(n_chars AS DOUBLE) AS x FROM {documents}")
    return rounded(S.motif_test(seqs(spark, d).join(chars, "doc_id"), MOTIFS, "x"))


@query(ctes("sequences") + _HITS + """, v AS (SELECT h.motif AS motif, h.n > 0 AS p, n_chars::DOUBLE AS x FROM hits JOIN documents USING (doc_id)),
 a AS (SELECT motif, avg(x) FILTER (p) AS m1, avg(x) FILTER (NOT p) AS m0, var_samp(x) FILTER (p) AS v1, var_samp(x) FILTER (NOT p) AS v0, count(x) FILTER (p) AS n1, count(x) FILTER (NOT p) AS n0 FROM v GROUP BY motif)
 SELECT motif, round(m1, 6) AS mean1, round(m0, 6) AS mean0, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 6) AS df FROM a""")
def motif_ttest(spark, d):
    chars = derive.load(spark, d, "SELECT doc_id, CAST(n_chars AS DOUBLE) AS x FROM {documents}")
    return rounded(S.motif_ttest(seqs(spark, d).join(chars, "doc_id"), MOTIFS, "x"))


_SUBS = pieces_cte(200) + """, par AS (SELECT lang AS parent, arg_min(seq, (-len(seq), doc_id, piece)) AS pseq FROM pieces GROUP BY lang),
 sub AS (SELECT doc_id, piece, lang AS parent, i AS position, substr(pseq, i, 1) AS from_base, substr(seq, i, 1) AS to_base
 FROM pieces JOIN par ON lang = parent, range(1, 201) t(i) WHERE i <= len(seq) AND substr(pseq, i, 1) <> substr(seq, i, 1))"""


def subs(spark, d, each=None):
    """Every window against the first of its language's longest windows, as far as the window goes."""
    each = written(pieces(spark, d, 200), "windows") if each is None else each
    each = each.select("doc_id", "window", F.col("lang").alias("parent"), "seq", F.struct("lang", F.length("seq").alias("n")).alias("key"))
    first = each.where("window = 0 and parent is not null").groupBy("key.lang").agg(F.min_by("seq", F.struct(-F.length("seq"), "doc_id")).alias("seq"))  # no window of a text is longer than its first
    cut = first.select("lang", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("n"), "seq")
    parents = cut.select(F.struct("lang", "n").alias("key"), F.substr("seq", F.lit(1), F.col("n")).alias("seq"))
    return S.substitutions(each, parents, "key").drop("key")


@query(ctes("sequences") + _SUBS + ' SELECT doc_id, piece AS "window", parent, CAST(position AS INT) AS position, from_base, to_base FROM sub')
def substitutions(spark, d):
    return subs(spark, d)


@query(ctes("sequences") + _SUBS + " SELECT CAST(position AS INT) AS position, to_base, round(count(*) / (SELECT count(*) FROM pieces)::DOUBLE, 6) AS share FROM sub GROUP BY position, to_base")
def substitution_profile(spark, d):
    each = written(pieces(spark, d, 200), "windows")
    return rounded(S.substitution_profile(subs(spark, d, each), each.count()))


@query(ctes("sequences") + """, b AS (SELECT i AS position, substr(seq, i, 1) AS base, count(*) AS n FROM sequences, range(1, 24) t(i) WHERE len(seq) >= 23 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY position) AS share FROM b)
 SELECT CAST(position AS INT) AS position, base, round(share, 6) AS share, round(share * (2 + sum(share * log2(share)) OVER (PARTITION BY position)), 6) AS bits FROM s""")
def logo_matrix(spark, d):
    return rounded(S.logo_matrix(seqs(spark, d), 23))


@query(ctes("sequences") + " SELECT lang, base, CAST(sum(len(seq) - len(replace(seq, base, ''))) AS BIGINT) AS n FROM sequences, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) GROUP BY ALL")
def base_composition(spark, d):
    return S.base_composition(seqs(spark, d))


@query(ctes("sequences") + pieces_cte(60) + f""", lib AS ({derive.sql(derive.LIBRARY_DUCKDB)}), r AS (SELECT DISTINCT substr(seq, w * 60 + 1, 60) AS ref FROM (SELECT seq, unnest(range(0, CAST(ceil(len(seq) / 60.0) AS BIGINT))) AS w FROM lib)),
 d AS (SELECT seq, CAST(min(levenshtein(seq, ref)) AS INT) AS distance FROM (SELECT DISTINCT seq FROM pieces), r GROUP BY seq)
 SELECT doc_id, piece AS "window", distance FROM pieces JOIN d USING (seq)""")
def min_edit_distance(spark, d):
    """Windows of 60 bases of all documents against those of the library, the benchmark passages."""
    library = derive.load(spark, d, derive.LIBRARY_SPARK).select(F.explode(Q.windows(F.col("seq"), 60)).alias("w")).select("w.seq")
    return S.min_edit_distance(pieces(spark, d, 60).select("doc_id", "window", "seq"), library, 3).drop("seq")


_LANES = ", ".join(f"translate(seq, 'ACGT', '{''.join('01'[b == c] for c in 'ACGT')}') AS {b.lower()}" for b in "ACGT")


@query(ctes("sequences") + f" SELECT doc_id, CAST(len(seq) AS INT) AS n, {_LANES} FROM sequences")
def one_hot(spark, d):
    """The lanes of all bases of every whole text, each as a string of 0 and 1."""
    s = seqs(spark, d).withColumn("encoding", Q.one_hot(F.col("seq")))
    lane = lambda k: F.when(F.length("seq") > 0, F.array_join(F.transform("encoding", lambda r: F.get(r, F.lit(k)).cast("string")), "")).otherwise(F.substring("seq", 1, 0))
    return s.select("doc_id", F.length("seq").alias("n"), *[lane(k).alias(b) for k, b in enumerate("acgt")])


@query(ctes("sequences") + pieces_cte(120) + """, p AS (SELECT doc_id, piece, lang, seq, concat(substr(seq, 31, 9), translate(substr(seq, 40, 1), 'ACGT', 'CGTA'), substr(seq, 41, 10)) AS own,
  lag(substr(seq, 31, 20)) OVER (PARTITION BY doc_id ORDER BY piece) AS other FROM pieces WHERE len(seq) >= 60),
 u AS (SELECT doc_id, piece, seq, 'own' AS kind, own AS probe FROM p UNION ALL SELECT doc_id, piece, seq, 'other', other FROM p WHERE other IS NOT NULL),
 w AS (SELECT doc_id, piece, kind, levenshtein(substr(seq, i + 1, 20 + e), probe) AS distance, i AS start, i + 20 + e AS stop FROM u, range(0, 102) t(i), (SELECT unnest([-1, 0, 1]) AS e)
  WHERE i + 20 + e <= len(seq) AND (contains(seq, substr(probe, 1, 10)) OR contains(seq, substr(probe, 11, 10)))),
 b AS (SELECT doc_id, piece, kind, min({'distance': distance, 'start': start, 'stop': stop}) AS h FROM w WHERE distance <= 1 GROUP BY ALL)
 SELECT u.doc_id, u.piece AS "window", u.kind, CAST(h.distance AS INT) AS distance, CAST(h.start AS INT) AS start, CAST(h.stop AS INT) AS stop FROM u LEFT JOIN b USING (doc_id, piece, kind)""")
def find_approx(spark, d):
    """Two probes for each window: a part of its own with one base changed, and the same part of the window before."""
    s = pieces(spark, d, 120).where(F.length("seq") >= 60)
    own = F.concat(F.substring("seq", 31, 9), F.translate(F.substring("seq", 40, 1), "ACGT", "CGTA"), F.substring("seq", 41, 10))
    other = F.lag(F.substring("seq", 31, 20)).over(Window.partitionBy("doc_id").orderBy("window"))
    probes = F.explode(F.array(F.struct(F.lit("own").alias("kind"), own.alias("probe")), F.struct(F.lit("other").alias("kind"), F.col("before").alias("probe"))))
    s = s.withColumn("before", other).select("doc_id", "window", "seq", probes.alias("p")).select("doc_id", "window", "seq", "p.*").where("probe is not null")
    hit = Q.find_approx(F.col("seq"), F.col("probe"), 1)
    return s.select("doc_id", "window", "kind", hit.alias("h")).select("doc_id", "window", "kind", "h.distance", "h.start", F.col("h.end").alias("stop"))


_DELTA = """, r AS (SELECT *, included / (included + skipped)::DOUBLE AS psi FROM satmut WHERE included + skipped >= 30),
 par AS (SELECT condition, idx, avg(psi) AS parent_psi FROM r WHERE position = 0 GROUP BY ALL), m AS (SELECT condition, idx, position, nucleotide, avg(psi) AS psi FROM r WHERE position > 0 GROUP BY ALL),
 dl AS (SELECT m.*, parent_psi, psi - parent_psi AS delta FROM m LEFT JOIN par USING (condition, idx))"""


@query(ctes("satmut") + _DELTA + " SELECT condition, idx, position, nucleotide, round(psi, 6) AS psi, round(parent_psi, 6) AS parent_psi, round(delta, 6) + 0.0 AS delta FROM dl")
def satmut_delta(spark, d):
    return rounded(S.satmut_delta(satmut(spark, d))).withColumn("delta", F.col("delta") + 0.0)


@query(ctes("satmut") + _DELTA + """ SELECT position, round(avg(delta), 6) + 0.0 AS mean_delta, count(delta) AS n, round((avg(delta) - (SELECT avg(delta) FROM dl)) / ((SELECT stddev_samp(delta) FROM dl) / sqrt(count(delta))), 5) + 0.0 AS z FROM dl GROUP BY position""")
def position_effects(spark, d):
    out = S.position_effects(S.satmut_delta(satmut(spark, d)))
    return out.select("position", (F.round("mean_delta", 6) + 0.0).alias("mean_delta"), "n", (F.round("z", 5) + 0.0).alias("z"))


@query()
def position_tests(spark, d):
    """Position effects with normal p-values and FDR; the tail has no SQL twin."""
    return rounded(S.position_tests(S.satmut_delta(satmut(spark, d))))


@query(ctes("satmut") + _DELTA + " SELECT condition, idx, position, round(-sum(delta) / 3, 6) + 0.0 AS effect FROM dl GROUP BY ALL")
def effect_means(spark, d):
    return rounded(S.effect_means(S.satmut_delta(satmut(spark, d)))).withColumn("effect", F.col("effect") + 0.0)


_MATRIX = ", ".join(f"coalesce(max(delta) FILTER (nucleotide = '{b}'), 0) AS \"{b}\"" for b in "ACGT")


def element_lengths(spark, d):
    return satmut(spark, d).groupBy("idx").agg(F.max("position").alias("length"))


@query(ctes("satmut") + _DELTA + f""", n AS (SELECT idx, max(position) AS length FROM satmut GROUP BY idx), g AS (SELECT condition, idx, unnest(range(1, length + 1)) AS position FROM (SELECT DISTINCT condition, idx FROM dl) JOIN n USING (idx)),
 b AS (SELECT condition, idx, position, {_MATRIX} FROM g LEFT JOIN dl USING (condition, idx, position) GROUP BY ALL)
 SELECT condition, idx, CAST(position AS INT) AS position, round("A", 6) + 0.0 AS "A", round("C", 6) + 0.0 AS "C", round("G", 6) + 0.0 AS "G", round("T", 6) + 0.0 AS "T", round(-("A" + "C" + "G" + "T") / 3, 6) + 0.0 AS effect FROM b""")
def effect_matrix(spark, d):
    out = rounded(S.effect_matrix(S.satmut_delta(satmut(spark, d)), element_lengths(spark, d)))
    return out.select("condition", "idx", "position", *[(F.col(c) + 0.0).alias(c) for c in ("A", "C", "G", "T", "effect")])


@query()
def effect_blocks(spark, d):
    """Blocks of mutations with an effect (tested against numpy)."""
    return rounded(S.effect_blocks(S.satmut_delta(satmut(spark, d)), element_lengths(spark, d), z=1.0, min_mean=0.01))


@query(ctes("satmut") + " SELECT condition, idx, position, sample, nucleotide, dense_rank() OVER (PARTITION BY condition, idx ORDER BY position) AS place FROM satmut")
def global_position(spark, d):
    return S.global_position(satmut(spark, d)).select("condition", "idx", "position", "sample", "nucleotide", F.col("place").cast("long").alias("place"))


@query(ctes("satmut") + _DELTA + ", o AS (SELECT idx, condition, delta AS x, delta * delta - (position % 3) / 10.0 AS y FROM dl WHERE delta IS NOT NULL) SELECT condition, round(corr(x, y), 6) AS r, count(*) AS n FROM o GROUP BY condition")
def observed_vs_predicted(spark, d):
    seen = S.satmut_delta(satmut(spark, d))
    predicted = seen.withColumn("delta", F.col("delta") * F.col("delta") - (F.col("position") % 3) / 10.0)
    both = S.observed_vs_predicted(seen, predicted).where("observed is not null")
    return rounded(both.groupBy("condition").agg(F.corr("observed", "predicted").alias("r"), F.count(F.lit(1)).alias("n")))


@query(ctes("imaging") + """, c AS (SELECT *, greatest(intensity - CASE WHEN channel = 'click' THEN 20.0 ELSE 0 END, 0) AS clean FROM imaging WHERE area >= 1)
 SELECT well, channel, round(sum(clean * area), 4) AS total, round(sum(clean * area) / sum(area), 6) AS mean, round(sum(area), 6) AS area FROM c GROUP BY ALL""")
def well_intensity(spark, d):
    out = S.well_intensity(derive.load(spark, d, derive.IMAGING), {"click": 20.0}, 1.0)
    return out.select("well", "channel", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("area", 6).alias("area"))


@query(ctes("expression") + """, x AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY gene) AS n, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS s, sum(value) OVER (PARTITION BY gene) AS t, lead(value) OVER w AS nxt FROM expression WINDOW w AS (PARTITION BY gene ORDER BY value, cell_line)),
 y AS (SELECT *, CASE WHEN k < n AND nxt > value THEN round(s * s / k + (t - s) * (t - s) / (n - k), 9) END AS score FROM x), c AS (SELECT gene, arg_min(k, (-score, k)) AS cut FROM y WHERE score IS NOT NULL GROUP BY gene)
 SELECT gene, cell_line, CASE WHEN k <= coalesce(cut, n) THEN 1 ELSE 2 END AS cluster FROM y LEFT JOIN c USING (gene)""")
def two_means_1d(spark, d):
    return S.two_means_1d(derive.load(spark, d, derive.EXPRESSION_SPARK)).drop("value")


@query(ctes("expression") + """, x AS (SELECT gene, cell_line, CASE WHEN value > 0 THEN 2 ELSE 1 END AS c FROM expression), s AS (SELECT gene, coalesce(string_agg(CASE c WHEN 1 THEN cell_line END, ',' ORDER BY cell_line), '') AS a, coalesce(string_agg(CASE c WHEN 2 THEN cell_line END, ',' ORDER BY cell_line), '') AS b FROM x GROUP BY gene)
 SELECT concat(least(a, b), '|', greatest(a, b)) AS split, count(*) AS n_genes, min(gene) AS first_gene FROM s GROUP BY 1""")
def partition_groups(spark, d):
    e = derive.load(spark, d, derive.EXPRESSION_SPARK).withColumn("cluster", F.when(F.col("value") > 0, 2).otherwise(1))
    return S.partition_groups(e)


@query(ctes("expression") + """, z AS (SELECT gene, cell_line, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM expression WINDOW w AS (PARTITION BY gene)), c AS (SELECT gene, covar_samp(z, cell_line::DOUBLE) AS c FROM z GROUP BY gene)
 SELECT gene, round(c / sqrt((SELECT sum(c * c) FROM c)), 6) AS weight FROM c""")
def pls_weights(spark, d):
    e = derive.load(spark, d, derive.EXPRESSION_SPARK)
    return rounded(S.pls_weights(e, e.select("cell_line", F.col("cell_line").cast("double").alias("y")).distinct()))


@query(ctes("counts") + ", g AS (SELECT sample, idx, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(len(idx) * 100 AS INT) AS length FROM counts GROUP BY ALL) SELECT sample, idx, cnt, length, round(log2(1e6 * (cnt / length::DOUBLE) / sum(cnt / length::DOUBLE) OVER (PARTITION BY sample) + 1), 6) AS log_tpm FROM g")
def log_tpm(spark, d):
    g = counts(spark, d).groupBy("sample", "idx").agg(F.sum("cnt").alias("cnt")).withColumn("length", F.length("idx") * 100)
    return rounded(S.log_tpm(g))


@query(ctes("psi_counts", "expression") + MEANS_CTE + """, v AS (SELECT cell_line, list(value ORDER BY gene) AS e FROM expression GROUP BY cell_line)
 SELECT condition, event, concat(event, 'ACGT') AS seq, round(psi, 6) AS psi, CAST(len(e) AS INT) AS n_genes, round(e[1], 6) AS first_value FROM means JOIN v ON condition = cell_line""")
def model_dataset(spark, d):
    m = means(spark, d)
    sequences = m.select("event", F.concat("event", F.lit("ACGT")).alias("seq")).distinct()
    out = S.model_dataset(m, sequences, derive.load(spark, d, derive.EXPRESSION_SPARK))
    return rounded(out.select("condition", "event", "seq", "psi", F.size("expression").alias("n_genes"), F.get("expression", F.lit(0)).alias("first_value")))


@query(ctes("counts") + """, b AS (SELECT DISTINCT idx, up_off, down_off FROM counts WHERE mode = 'INCLUDED' AND condition = 0)
 SELECT sample, idx, up_off, down_off, cnt FROM counts c WHERE mode = 'INCLUDED' AND abs(up_off) <> 1 AND abs(down_off) <> 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.idx = c.idx AND b.up_off = c.up_off AND b.down_off = c.down_off)""")
def blacklist_filter(spark, d):
    c = counts(spark, d).where("mode = 'INCLUDED'")
    listed = c.where("condition = 0").select("idx", "up_off", "down_off").distinct()
    return N.blacklist_filter(N.drop_near_offsets(c), listed, ["idx", "up_off", "down_off"]).select("sample", "idx", "up_off", "down_off", "cnt")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A')")
def except_rows(spark, d):
    rows = derive.load(spark, d, "SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM {lineitem}")
    return N.except_rows(rows, rows.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query(ctes("counts") + """ SELECT condition, idx, CAST(coalesce(sum(cnt) FILTER (mode = 'INCLUDED'), 0) AS BIGINT) AS "INCLUDED", CAST(coalesce(sum(cnt) FILTER (mode = 'SKIPPED'), 0) AS BIGINT) AS "SKIPPED" FROM counts GROUP BY ALL""")
def mode_counts(spark, d):
    return C.mode_counts(counts(spark, d), ("condition", "idx"))


_COLUMNS = ", ".join(f"round(max(psi) FILTER (condition = {c}), 6) AS c{c}" for c in range(25))  # one for each nation


@query(ctes("psi_counts") + MEANS_CTE + f" SELECT event, {_COLUMNS} FROM means GROUP BY event")
def to_matrix(spark, d):
    conditions = sorted(r.condition for r in derive.load(spark, d, derive.NATION).select("condition").distinct().collect())  # the nations
    wide = P.to_matrix(means(spark, d), conditions)
    return rounded(wide.select("event", *[F.col(str(c)).alias(f"c{c}") for c in conditions]))


@query(ctes("psi_counts") + " SELECT sample, event, 'included' AS kind, included AS n FROM psi_counts UNION ALL SELECT sample, event, 'skipped', skipped FROM psi_counts")
def to_long(spark, d):
    return P.to_long(derive.load(spark, d, derive.PSI_COUNTS), ["sample", "event"], ["included", "skipped"])


@query("SELECT n_regionkey AS lineage, count(DISTINCT n_name) AS n_lines FROM nation GROUP BY 1")
def lineage_counts(spark, d):
    return C.lineage_counts(derive.load(spark, d, derive.NATION))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')")
def common_ids(spark, d):
    rows = derive.load(spark, d, "SELECT l_partkey AS k, l_returnflag AS flag FROM {lineitem}")
    return N.common_ids([rows.where("flag = 'A'"), rows.where("flag = 'N'")], "k")


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7")
def all_ids(spark, d):
    rows = derive.load(spark, d, "SELECT l_suppkey AS k, l_returnflag AS flag, l_linenumber AS line FROM {lineitem}")
    return N.all_ids([rows.where("flag = 'A'"), rows.where("line = 7")], "k")


@query("""WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3)
 SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second""")
def table_differences(spark, d):
    rows = derive.load(spark, d, "SELECT l_partkey, l_suppkey, l_linenumber AS line FROM {lineitem}")
    return N.table_differences(rows.where("line <= 3").drop("line"), rows.where("line >= 3").drop("line"))
