import numpy as np
from pyspark.sql import functions as F

from isoflow.llm import langid, quality
from isoflow.llm.hashing import FlatWords, chunks
from tests.conftest import TESTDATA


def test_words_and_hashes():
    flat = FlatWords([b"one Two\tone", b"", b" two  "], lower=True)
    words = [flat.data[s:e].tobytes() for s, e in zip(flat.starts, flat.ends)]
    assert words == [b"one", b"two", b"one", b"two"] and flat.doc.tolist() == [0, 0, 0, 2]
    h = flat.hash.of(flat.starts, flat.ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_long_texts_are_cut_at_blanks():
    text = "word " * 1000 + "x" * 3000 + " tail"
    parts = [p for _, group in chunks([text, None], limit=512) for p in group]
    assert b"".join(parts) == text.encode()
    assert all(len(p) <= 512 or b"x" in p for p in parts)


def test_quality_on_held_out_labels(spark):
    got = quality.op2_quality(spark, f"{TESTDATA}/sf0.01").join(spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    assert n > 50 and right > 0.95


def test_quality_edge_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 1), (8, 0), (10, 0), (12, None), (None, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    scored = quality.score(odd_docs, model)
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert set(odd_docs.columns) < set(scored.columns)
    assert quality.score(no_docs, model).count() == 0
    untrained = quality.fit(odd_docs, labels.where("false"))
    assert {r.quality_score for r in quality.score(odd_docs, untrained).collect()} == {0.5}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    got = langid.op4_language_id(spark, f"{TESTDATA}/sf0.01").join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97


def test_language_edge_cases(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    for i in (1, 2, 12, 13):
        assert (rows[i].lang_pred, rows[i].lang_score) == ("und", 0.0)
    assert rows[8].lang_pred == "en" and all(0 <= r.lang_score <= 1 for r in rows.values())
    assert langid.identify(no_docs, model).count() == 0
    none = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, none).collect()} == {"und"}


def test_words_of_mixed_text_are_labelled_one_by_one():
    texts = ["the house and the garden of the king " * 8] * 20 + ["das haus und der garten des herrn " * 8] * 20
    model = langid.train(texts, np.array([0] * 20 + [1] * 20), ["en", "de"])
    labels = [lang for _, lang, _ in langid.word_labels(model, "the house and the garden und der garten des herrn")]
    assert labels == ["en"] * 5 + ["de"] * 5


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    score, move, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.forward_backward(score, np.array([0, 4]), move, start)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(start[path[0]] + sum(score[a + i, y] for i, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_a_text_is_one_chain_however_it_is_cut():
    rng = np.random.default_rng(12)
    sizes = [1, 7, 64, 65, 300, 2, 129]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    score, move, start = 4 * rng.normal(size=(len(doc), 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    whole = langid.forward_backward(score, np.flatnonzero(np.diff(doc, prepend=-1)), move, start)
    for piece in (1, 3, 64, 1000):
        assert np.allclose(langid.whole_chains(score, doc, move, start, piece), whole)


def test_scores_of_long_texts_are_held_until_they_end(monkeypatch):
    texts = ["the house and the garden of the king " * 8] * 20 + ["das haus und der garten des herrn " * 8] * 20
    model = langid.train(texts, np.array([0] * 20 + [1] * 20), ["en", "de"])
    asked = ["the house und der garten " * 50, None, "", "das haus", " ", "the king and the house " * 90, "der garten"]
    whole = langid.document_shares(model, asked)
    cut = langid.chunks
    monkeypatch.setattr(langid, "chunks", lambda t: cut(t, limit=100))
    pieces = langid.document_shares(model, asked)
    assert (whole[0] == pieces[0]).all() and np.allclose(whole[1], pieces[1], atol=1e-5)


def test_labels_of_plain_python_forward_backward(spark):
    """Every document of a small table against a chain worked out word by word in plain Python."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold() != 2))
    got = {r.doc_id: r for r in langid.op4_language_id(spark, f"{TESTDATA}/sf0.001").collect()}
    move, begin = np.exp(model.transition), np.exp(model.start)
    for r in docs.collect():
        flat = FlatWords([(r.text or "").encode()], lower=True)
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        w = np.exp(langid.emissions(model, flat))
        alpha, beta = [begin * w[0]], [np.ones(len(begin))]
        for t in range(1, len(w)):
            a = (alpha[-1] @ move) * w[t]
            alpha.append(a / a.sum())
        for t in range(len(w) - 1, 0, -1):
            b = move @ (w[t] * beta[-1])
            beta.append(b / b.sum())
        p = np.array(alpha) * np.array(beta[::-1])
        p /= p.sum(axis=1, keepdims=True)
        word = [flat.data[s:e].tobytes() for s, e in zip(flat.starts, flat.ends)]
        share = p[[bool(langid.LETTER[list(x)].any()) for x in word]].sum(axis=0)
        assert abs(got[r.doc_id].score - share.max() / share.sum()) < 1e-4
        assert got[r.doc_id].lang_pred == model.languages[int(share.argmax())] or np.sort(share)[-2] > 0.999 * share.max()


def test_language_without_ids_and_with_clashing_names(spark):
    rows = [(None, "the house and the garden", "en", "x"), (None, "das haus und der garten", "de", "y")] * 5 + [(3, None, "en", "z"), (3, "1 2", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, _judged string").withColumn("lang_pred", F.lit(1)).withColumn("_row", F.lit("r"))
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    got = langid.identify(docs, model)
    assert sorted(got.columns) == sorted([*docs.columns, "lang_score"])
    assert {r.lang_pred for r in got.where("_judged = 'x'").collect()} == {"en"} and {r.lang_pred for r in got.where("_judged = 'z'").collect()} == {"und"}
    kept = langid.confident(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == 10 and {r.lang_pred for r in kept.collect()} == {1}


def test_quality_scores_against_plain_python(spark):
    """The score of a text from the stored vectors, feature by feature."""
    texts = ["good clean words here", "word word word", "", None, "naïve x", "spam!!! spam " * 40]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    labels = spark.createDataFrame([("0", 1), ("1", 0), ("4", 1), ("5", 0), (None, 1)], "doc_id string, quality int")
    model = quality.fit(docs, labels)
    vectors, weights, bias = model

    def bucket(raw, salt):
        flat = FlatWords([raw], lower=False)
        h = flat.hash.of(np.array([0]), np.array([len(raw)])) + np.uint64(salt)
        return int(quality.mix(h)[0] >> np.uint64(64 - quality.BITS))

    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    for i, text in enumerate(texts):
        ids, last = [], None
        for w in (text or "").encode().split():
            ids += [bucket(w, 1), bucket(w[:3], 2), bucket(w[-3:], 3)] + [quality.REPEAT] * (w == last)
            ids += [bucket(w[k : k + n], n + 10) for n in quality.NGRAMS for k in range(len(w) - n + 1)]
            last = w
        mean = sum((vectors[k] for k in ids), np.zeros(quality.DIM)) / (len(ids) + quality.PAD)
        z = mean @ weights + bias
        assert abs(got[str(i)] - np.exp(z[1]) / np.exp(z).sum()) < 1e-6


def test_draws_are_the_smallest_of_each_group(spark):
    from isoflow.llm.sampling import smallest_draws

    rows = spark.range(4000).select(F.xxhash64("id").alias("draw"), (F.col("id") % 7 == 0).cast("int").alias("g"), "id")
    got = {(r.g, r.id) for r in smallest_draws(rows, rows.groupBy("g").count(), "g", 40).collect()}
    every = sorted((r.g, r.draw, r.id) for r in rows.collect())
    assert got == {(g, i) for k in (0, 1) for g, _, i in [r for r in every if r[0] == k][:40]}
