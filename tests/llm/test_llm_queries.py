import pytest

from isoflow.llm import queries
from tests.conftest import TESTDATA, rows_of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, f"{TESTDATA}/sf0.01").toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_pipeline_stages(spark, odd_docs, no_docs):
    import corpus_pipeline as pipeline

    docs, counts = odd_docs, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        docs = out.cache()
        counts.append(docs.count())
        if name == "exact_dedup":
            texts = [r.text.lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert all(counts)
    for _, stage in pipeline.STAGES:
        assert stage(spark, no_docs, "").count() == 0


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    exact = pipeline.drop_exact_copies(spark, docs, "")
    assert exact.count() == exact.select("text").distinct().count()
    near = pipeline.drop_near_copies(spark, exact, "")
    from isoflow.llm.jaccard_join import jaccard_components

    groups = jaccard_components(exact)
    assert near.count() == groups.select("component_id").distinct().count()


def test_pipeline_rows_against_brute_force(spark):
    """Each stage on what the one before kept, worked out in plain Python; only the language model is taken as it is."""
    import hashlib
    import math
    import zlib
    from collections import Counter, defaultdict

    import corpus_pipeline as pipeline
    from isoflow.llm import langid, mixing, packing
    from tests.llm.test_joins_and_search import LOW, brute_components

    folder = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = langid.identify(docs, langid.fit(docs)).collect()
    rows = [(r.doc_id, r.text, r.source) for r in judged if r.lang_pred != "und" and r.lang_score >= pipeline.MIN_LANGUAGE_SHARE]
    best = {}
    for i, text, _ in rows:
        best[(text or "").translate(LOW)] = max(i, best.get((text or "").translate(LOW), i))
    rows = [r for r in rows if best[(r[1] or "").translate(LOW)] == r[0]]
    keep = {i for i, _, component in brute_components([(i, t) for i, t, _ in rows]) if i == component}
    rows = [r for r in rows if r[0] in keep]

    plan = {r.source: r.rate for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    emitted = Counter()
    for i, _, source in rows:
        u = int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) / (1 << 52)
        emitted[i] = math.floor(plan[source]) + (u < plan[source] - math.floor(plan[source]))
    assert all(0 <= n <= 2 for n in emitted.values())

    got = pipeline.run(spark, folder).collect()
    bpe = packing.ByteBpe(packing.tokenizer_file())
    want = Counter()
    for i, text, _ in rows:
        ids = bpe.encode(text or "") + b"\0\0\0\0"
        for piece, (start, length) in enumerate(packing.cut(len(ids) // 4, packing.CAPACITY)):
            want[(i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))] += emitted[i]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for part in places.values():
        end = 0
        for offset, length in sorted(part):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_pipeline_stages_with_repeated_and_null_ids_and_clashing_names(spark):
    import corpus_pipeline as pipeline

    words = " ".join(f"the w{i} and" for i in range(60))
    rows = [(5, words, "en"), (9, words.upper(), "en"), (5, "another text of the house and the garden", "en"), (None, words, "en"), (None, words + " end", "en"), (7, None, None), (8, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", "x", "y") for i, t, lang in rows], "doc_id long, text string, lang string, source string, lang_pred string, component string")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "packing":
            assert out.count() > 0
            break
        assert out.columns == docs.columns and {r.component for r in out.collect()} == {"y"} and {r.lang_pred for r in out.collect()} == {"x"}
        docs = out.cache()
        if name == "exact_dedup":
            assert {(r.doc_id, len(r.text)) for r in docs.collect()} == {(9, len(words)), (5, len(rows[2][1])), (None, len(words) + 4)}
        if name == "jaccard_join":
            assert {(r.doc_id, len(r.text)) for r in docs.collect()} == {(9, len(words)), (5, len(rows[2][1]))}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0
