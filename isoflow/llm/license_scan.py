"""Licence scan in DataFrame operations: TF-IDF cosine to templates, then directory inheritance.

What is compared with the licence templates (titles, notices and full texts) by the cosine of sparse
TF-IDF vectors: the header of a file, licence files as a whole, and, for notices elsewhere, each
line, each sentence of a line and each run of up to four lines.  Inverse document frequencies come
from all files; words outside the templates count as rarest.  A passage that reaches the threshold
shares at least one of a template's heavy words (the light ones together weigh less than the
threshold), so files and passages without any are skipped without loss.  Each distinct passage is
scored once.  Versions and relatives of a licence share most words; a passage must also have the few that tell
them apart (``license_texts.GUARDS``), and a short one that denies is none.  Files without a licence of their own inherit that of the licence file in their nearest
ancestor directory; ancestors are joined once for each distinct directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table
from isoflow.llm.license_texts import GUARDS, SPDX, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"
THRESHOLD = 0.7
COMMON = {"a", "and", "any", "are", "by", "code", "for", "in", "is", "it", "of", "or", "the", "this", "to", "under", "use", "with", "work", "you"}
"""Frequent words, which count as light first; any order keeps the skipping exact."""
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
WINDOW = 4
"""Lines of a notice at most, unless it is the header or a file of its own."""
BROADCAST_ROWS = 250_000
"""Paths or passages up to which a join against them is broadcast."""


def words_of(text):
    """Lower-cased words as an array; an empty string may stand at either end."""
    return F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")


def template_vectors(templates: list[tuple[str, str]], df: dict[str, int], n_files: int) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies, that of a word outside the templates, and the unit vector of each template."""
    counts = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
    idf = {w: math.log((1 + n_files) / (1 + df.get(w, 0))) + 1 for c in counts for w in c}
    vectors = []
    for c in counts:
        v = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    return idf, math.log(1 + n_files) + 1, vectors


SHORT = 20
"""Words of a template that names a licence instead of quoting it; a passage that denies is not one."""
NEGATIONS = ("isn", "never", "not")


def guard(name: str, text: str) -> tuple[list[str], list[str], list[str]]:
    """Words of which a passage must hold all, one (if there are any) and none to have the licence of a template.

    The cosine alone cannot tell versions and relatives of a licence apart, since they share all other words.
    """
    words = re.findall(WORD, text.lower())
    every, some, none = (set(x) for x in GUARDS.get(name, ((), (), ())))
    if text.startswith(SPDX):
        every, some = set(re.findall(WORD, name.lower())), set()
    if len(words) <= SHORT:
        none |= set(NEGATIONS) - set(words)
    return sorted(every), sorted(some), sorted(none)


def heavy_words(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a line must hold one to reach the threshold with any template."""
    heavy: set[str] = set()
    for v in vectors:
        light = 0.0
        for w, x in sorted(v.items(), key=lambda p: (p[0] not in COMMON, p[1], p[0])):
            light += x * x
            if light >= threshold**2 - 1e-9:
                heavy.add(w)
    return sorted(heavy)


def scored_passages(
    passages: DataFrame, templates: list[tuple[str, str]], idf: dict[str, float], unseen: float, vectors: list[dict[str, float]],
    threshold: float,
) -> DataFrame:
    """``id, license, score, place`` of the passages ``(id, words)`` that reach the threshold and have the words that tell
    the licence from its relatives; ties go to the template listed first."""
    spark = passages.sparkSession
    rows = [(w, k, x) for k, v in enumerate(vectors) for w, x in sorted(v.items())]
    weights = F.broadcast(spark.createDataFrame(rows, "word string, template int, weight double"))  # the templates' words
    frequencies = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    guards = [(k, name, *guard(name, text)) for k, (name, text) in enumerate(templates)]
    names = F.broadcast(spark.createDataFrame(guards, "template int, license string, every array<string>, some array<string>, none array<string>"))
    words = passages.select("id", F.explode("words").alias("word")).where("word <> ''")
    values = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")).join(frequencies, "word", "left").select("id", "word", (F.col("n") * F.coalesce("idf", F.lit(unseen))).alias("x"))
    norms = values.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = values.join(weights, "word").groupBy("id", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold).join(names, "template")
    held = scores.join(passages, "id")
    fits = (F.size(F.array_except("every", "words")) == 0) & ((F.size("some") == 0) | F.arrays_overlap("some", "words")) & ~F.arrays_overlap("none", "words")
    scores = held.where(fits).select("id", "template", "license", "score")
    return scores.groupBy("id").agg(F.max_by(F.struct("license", "score", F.col("template").alias("place")), F.struct("score", (-F.col("template")).alias("t"))).alias("best")).select("id", "best.*")


def passages_of(text, name):
    """The passages of a file: header, the whole of a licence file, lines, sentences and runs of lines."""
    lines = F.split(text, "\n")
    blank = F.array_position(F.transform(lines, lambda x: x.rlike(r"^[ \t\r]*$")), True)
    header = F.array_join(F.when(blank > 0, F.slice(lines, F.lit(1), F.greatest(blank.cast("int") - 1, F.lit(0)))).otherwise(lines), " ")
    sentences = F.split(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), "\n")
    n = F.size(lines)

    def run(k: int):
        joined = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(lines, i, F.lit(k)), " "))
        return F.when(n >= k, joined).otherwise(F.array().cast("array<string>"))

    runs = [run(k) for k in range(2, WINDOW + 1)]
    whole = F.when(name.rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(header), whole, lines, sentences, *runs))


def scan_licenses(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, path: str = "path",
    text: str = "text",
) -> DataFrame:
    """``path, own_license, own_score, license, licensed_by`` for every row of ``files``.

    ``own_license`` is the best template of any passage of the file (ties to the one listed first);
    ``license`` is that or, failing it, the one of the licence file in the nearest ancestor
    directory, which ``licensed_by`` names (a file's own directory first; the root is '').  Of
    several licence files in a directory the best score counts, then the smaller path.  Rows of
    one path are one file.  Null or empty texts have no licence of their own; a null path gives
    nulls throughout.  An empty table gives an empty result.  Only the two named columns are read.
    """
    files = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in templates for w in re.findall(WORD, t.lower())})])
    seen = materialize(
        files.select("path", F.coalesce(F.array_intersect(words_of(F.col("text")), vocabulary), F.array().cast("array<string>")).alias("words")),
        "seen",
    )
    counted = seen.select(F.explode("words").alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counted.collect()}  # words of the templates only
    idf, unseen, vectors = template_vectors(templates, df, seen.count())
    heavy = F.array(*[F.lit(w) for w in heavy_words(vectors, threshold)])
    hint = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df

    likely = materialize(seen.where(F.arrays_overlap("words", heavy) & F.col("path").isNotNull()).select("path").distinct(), "likely")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    parts = files.join(hint(likely, likely.count()), "path", "left_semi").where("text is not null").select("path", F.explode(passages_of(F.col("text"), name)).alias("passage"))
    parts = parts.withColumn("words", words_of(F.col("passage"))).where(F.arrays_overlap("words", heavy)).select("path", F.md5("passage").alias("id"), "words")
    parts = materialize(parts, "passages")
    once = parts.groupBy("id").agg(F.first("words").alias("words"))
    scored = materialize(scored_passages(once, templates, idf, unseen, vectors, threshold), "scored")
    own = parts.select("path", "id").join(hint(scored, scored.count()), "id")
    own = own.groupBy("path").agg(F.max_by(F.struct(F.col("license").alias("own_license"), F.col("score").alias("own_score")), F.struct("score", (-F.col("place")).alias("p"))).alias("o")).select("path", "o.*")
    own = materialize(own, "own")
    for old in (seen, likely, parts, scored):
        discard(old)

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    holders = own.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)).select(directory.alias("holder"), F.struct("own_score", F.lit(0)).alias("s"), "own_license", "path")
    holders = holders.groupBy("holder").agg(F.max("s.own_score").alias("top"), F.min(F.struct((-F.col("s.own_score")).alias("a"), F.col("path").alias("b"), "own_license")).alias("m")).select("holder", F.col("m.own_license").alias("held"))
    parts = F.split("dir", "/")
    dirs = files.where("path is not null").select(directory.alias("dir")).distinct()
    chain = dirs.select(
        "dir",
        F.explode(F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))).alias("holder"),
    )
    nearest = chain.join(holders, "holder").groupBy("dir").agg(F.max_by(F.struct("holder", "held"), F.length("holder")).alias("h")).select("dir", "h.*")
    out = files.select("path", directory.alias("dir")).join(own, "path", "left").join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        "path", "own_license", "own_score", F.coalesce("own_license", "held").alias("license"),
        F.when(inherits, F.col("holder")).alias("licensed_by"),
    )


def document_path(per_dir: int = 100):
    """A path for each document, since the table has none: source, language and id make directories
    of several depths, and ids divisible by ten are named as licence files."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt")))
    top, lang, group = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("und")), F.floor(F.col("doc_id") / per_dir).cast("string")
    depth = F.coalesce(F.col("doc_id") % 4, F.lit(0))
    return F.when(depth == 0, F.concat_ws("/", top, name)).when(depth == 1, F.concat_ws("/", top, lang, name)).when(depth == 2, F.concat_ws("/", top, lang, group, name)).otherwise(F.concat_ws("/", top, lang, group, F.lit("src"), name))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs.select(document_path().alias("path"), "text"))


def _sql() -> str:
    """The same without skipping anything: every passage of every file is scored."""
    listed = lambda words: "CAST([" + ", ".join(f"'{w}'" for w in words) + "] AS VARCHAR[])"
    values = ", ".join("({}, '{}', '{}', {}, {}, {})".format(k, name, text.replace("'", "''"), *map(listed, guard(name, text))) for k, (name, text) in enumerate(TEMPLATES))
    runs = ", ".join(f"list_transform(range(1, greatest(len(lines) - {k} + 2, 1)), lambda i: array_to_string(lines[i:i+{k - 1}], ' '))" for k in range(2, WINDOW + 1))
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH tpl(template, license, body, has_all, has_one, has_none) AS (VALUES {values}
), tw AS (SELECT template, unnest(regexp_extract_all({lower.format('body')}, '{WORD}')) AS word FROM tpl
), tc AS (SELECT template, word, count(*) AS n FROM tw GROUP BY ALL
), files AS (
  SELECT CASE doc_id % 4 WHEN 0 THEN concat_ws('/', coalesce(source, 'none'), f) WHEN 1 THEN concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'und'), f)
    WHEN 2 THEN concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'und'), CAST(doc_id // 100 AS VARCHAR), f) ELSE concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'und'), CAST(doc_id // 100 AS VARCHAR), 'src', f) END AS path, text, f
  FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN concat('LICENSE.', doc_id) ELSE concat(doc_id, '.txt') END AS f FROM documents)
), vocabulary AS (SELECT DISTINCT word FROM tw
), df AS (SELECT word, count(DISTINCT path) AS n FROM (SELECT path, unnest(list_distinct(regexp_extract_all({lower.format('text')}, '{WORD}'))) AS word FROM files) WHERE word IN (SELECT word FROM vocabulary) GROUP BY word
), idf AS (SELECT word, ln((1.0::DOUBLE + (SELECT count(*) FROM files)) / (1 + coalesce(n, 0))) + 1 AS idf FROM vocabulary LEFT JOIN df USING (word)
), tv AS (SELECT template, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS weight FROM tc JOIN idf USING (word)
), ls AS (SELECT path, text, f, string_split(text, chr(10)) AS lines FROM files WHERE text IS NOT NULL
), hd AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_full_match(x, '[ \t\r]*')), true), 0) AS blank FROM ls
), ps AS (
  SELECT path, unnest(list_distinct(flatten([[array_to_string(CASE WHEN blank > 0 THEN lines[1:blank-1] ELSE lines END, ' ')], CASE WHEN starts_with(f, 'LICENSE') THEN [text] ELSE [] END, lines,
    string_split(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10)), {runs}]))) AS passage FROM hd
), pw AS (SELECT passage, unnest(regexp_extract_all({lower.format('passage')}, '{WORD}')) AS word FROM (SELECT DISTINCT passage FROM ps)
), pl AS (SELECT passage, list(word) AS words FROM pw GROUP BY passage
), px AS (SELECT passage, word, n * coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM files)) + 1) AS x FROM (SELECT passage, word, count(*) AS n FROM pw GROUP BY ALL) LEFT JOIN idf USING (word)
), nm AS (SELECT passage, sqrt(sum(x * x)) AS norm FROM px GROUP BY passage
), sc AS (SELECT passage, template, round(sum(x * weight) / any_value(norm), 6) AS score FROM px JOIN tv USING (word) JOIN nm USING (passage) GROUP BY passage, template
), fl AS (SELECT path, template, license, score FROM ps JOIN sc USING (passage) JOIN tpl USING (template) JOIN pl USING (passage) WHERE score >= {THRESHOLD} AND list_has_all(words, has_all) AND (len(has_one) = 0 OR list_has_any(words, has_one)) AND NOT list_has_any(words, has_none)
), own AS (SELECT path, arg_max(license, (score, -template)) AS own_license, max(score) AS own_score FROM fl GROUP BY path
), holders AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS holder, arg_min(own_license, (-own_score, path)) AS held FROM own
  WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^LICENSE') GROUP BY 1
), fd AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files
), nearest AS (
  SELECT dir, arg_max(holder, length(holder)) AS holder, arg_max(held, length(holder)) AS held
  FROM (SELECT DISTINCT dir FROM fd) d JOIN holders ON d.dir = holder OR starts_with(d.dir, concat(holder, '/')) GROUP BY dir
)
SELECT path, own_license, own_score, coalesce(own_license, held) AS license, CASE WHEN own_license IS NULL THEN holder END AS licensed_by
FROM fd LEFT JOIN own USING (path) LEFT JOIN nearest USING (dir)
"""


OP9_SQL = _sql()
