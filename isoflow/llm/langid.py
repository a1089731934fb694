"""Language identification with a linear-chain conditional random field over words.

Each word has scores per language from its affixes, character n-grams, its own hash and its
membership in learned lexicons of frequent words; learned transitions link neighbouring words.
Forward-backward gives every word a distribution over languages, so code-switched text is
labelled word by word; a document takes the language with the largest expected share of its
lettered words.  The model is fitted in numpy on a bounded sample; transitions between languages
come from training chains that splice two documents together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import prepare, table
from isoflow.llm.hashing import FlatWords, chunks, mix
from isoflow.llm.sampling import smallest_draws

BITS = 16
NONE = 1 << BITS
AFFIXES = (1, 2, 3)
NGRAMS = (2, 3)
LEXICON = 300
"""Most frequent training words of a language that make its lexicon."""
CHAIN = 64
"""Words of a training chain at most, and of the pieces in which a chain is worked on at scoring."""
TRAIN_ROWS = 250
"""Documents of each language that the model is fitted on: those with the smallest hash of id and text."""
TRAIN_CHAINS = 4000
"""Chains of these documents that the model is fitted on: the second bound of the labelled sample."""
EPOCHS, RATE, BATCH = 3, 0.3, 128
UNKNOWN = "und"

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray  # (2**BITS + 1, K): the last row, of no feature, is zero
    lexicon: np.ndarray  # sorted hashes of all lexicon words
    member: np.ndarray  # (len(lexicon) + 1, K): indicator of each language's lexicon; the last row is zero
    member_weight: np.ndarray  # (K, K)
    transition: np.ndarray  # (K, K)
    start: np.ndarray  # (K,)


def word_features(flat: FlatWords) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word hashes; a (words, features) array of whole-word and affix buckets; buckets of n-grams by byte position."""
    s, e = flat.starts, flat.ends
    shift = np.uint64(64 - BITS)
    bucket = lambda h, salt: (mix(h + np.uint64(salt)) >> shift).astype(np.int32)
    whole = flat.hash.of(s, e)
    columns = [bucket(whole, 1)]
    for n in AFFIXES:
        columns.append(bucket(flat.hash.of(s, np.minimum(s + n, e)), 10 + n))
        columns.append(bucket(flat.hash.of(np.maximum(e - n, s), e), 20 + n))
    room = flat.room()
    grams = []
    for n in NGRAMS:
        at = np.flatnonzero(room >= n)
        found = np.full(len(flat.data), NONE, dtype=np.int32)
        found[at] = bucket(flat.hash.of(at, at + n), 30 + n)
        grams.append(found)
    return mix(whole), np.stack(columns, axis=1), grams


def lexicon_rows(model: Model, hashes: np.ndarray) -> np.ndarray:
    if not len(model.lexicon):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == hashes, at, len(model.lexicon))


def emissions(model: Model, flat: FlatWords) -> np.ndarray:
    """(words, K) scores; each distinct word is scored once."""
    if not len(flat.starts):
        return np.zeros((0, len(model.languages)))
    _, first, which = np.unique(mix(flat.hash.of(flat.starts, flat.ends)), return_index=True, return_inverse=True)
    raw = flat.data.tobytes()
    distinct = FlatWords([b" ".join([raw[s:e] for s, e in zip(flat.starts[first].tolist(), flat.ends[first].tolist())])], lower=False)
    hashes, columns, grams = word_features(distinct)
    score = (model.member @ model.member_weight)[lexicon_rows(model, hashes)]
    for k in range(columns.shape[1]):
        score = score + model.emission[columns[:, k]]
    at_byte = model.emission[grams[0]]
    for g in grams[1:]:
        at_byte += model.emission[g]
    return (score + np.add.reduceat(at_byte, distinct.starts, axis=0))[which]


def chain_borders(doc: np.ndarray, length: int = CHAIN) -> np.ndarray:
    """Starts of the chains over words sorted by text: at each new text and every ``length`` words."""
    n = len(doc)
    first = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return np.flatnonzero(place % length == 0)


def forward_backward(score: np.ndarray, starts: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals (words, K) of all chains at once; with ``pairs`` also the expected transitions and first labels."""
    n, k = score.shape
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    weight = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-300
    moves, first = np.exp(transition - transition.max()), np.exp(start - start.max())
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    alive = np.array([np.searchsorted(-lengths, -t, side="left") for t in range(int(lengths[0]) if len(lengths) else 0)])
    for t, m in enumerate(alive):
        at = starts[:m] + t
        now = weight[at] * (first if t == 0 else alpha[at - 1] @ moves)
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        now = (weight[at + 1] * beta[at + 1]) @ moves.T
        beta[at] = now / now.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    if not pairs:
        return marginal
    follow = np.ones(n, dtype=bool)
    follow[starts] = False
    b = np.flatnonzero(follow)
    joint = alpha[b - 1][:, :, None] * moves[None] * (weight[b] * beta[b])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return marginal, joint.sum(axis=0), marginal[starts].sum(axis=0)


def whole_chains(score: np.ndarray, doc: np.ndarray, transition: np.ndarray, start: np.ndarray, piece: int = CHAIN) -> np.ndarray:
    """Marginals (words, K) where all words of a text are one chain; the words of a text are neighbours in ``doc``.

    Chains are worked on in pieces.  The transfer matrix of each piece is found for all pieces at
    once; along a chain only these matrices are multiplied, which carries alpha and beta from piece
    to piece; then the words of all pieces are done at once from what was carried to them.
    """
    n, k = score.shape
    if not n:
        return np.zeros((0, k))
    weight = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-300
    moves, first = np.exp(transition - transition.max()), np.exp(start - start.max())
    begins = chain_borders(doc, piece)
    lengths = np.diff(np.append(begins, n))
    new = np.flatnonzero(np.diff(doc[begins], prepend=doc[0] - 1) != 0)
    pieces = np.diff(np.append(new, len(begins)))
    order = np.argsort(-lengths, kind="stable")
    alive = [order[: np.searchsorted(-lengths[order], -t, side="left")] for t in range(int(lengths.max()))]
    unit = lambda x, axes: x / x.sum(axis=axes, keepdims=True)

    through = unit(np.eye(k)[None] * weight[begins][:, :, None], (1, 2))
    for t in range(1, len(alive)):
        through[alive[t]] = unit((through[alive[t]] @ moves) * weight[begins[alive[t]] + t][:, None, :], (1, 2))
    before, after = np.tile(first / first.sum(), (len(begins), 1)), np.ones((len(begins), k))
    by_size = np.argsort(-pieces, kind="stable")
    steps = [new[by_size[: np.searchsorted(-pieces[by_size], -t, side="left")]] for t in range(int(pieces.max()))]
    for t in range(1, len(steps)):
        at = steps[t] + t
        before[at] = unit((before[at - 1][:, None, :] @ through[at - 1])[:, 0] @ moves, 1)
    for t in range(len(steps) - 2, -1, -1):
        at = steps[t + 1] + t
        after[at] = unit((through[at + 1] @ after[at + 1][:, :, None])[:, :, 0] @ moves.T, 1)

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    for t, at in enumerate(alive):
        word = begins[at] + t
        alpha[word] = unit(weight[word] * (before[at] if t == 0 else alpha[word - 1] @ moves), 1)
    beta[begins + lengths - 1] = after
    for t in range(len(alive) - 2, -1, -1):
        word = begins[alive[t + 1]] + t
        beta[word] = unit((weight[word + 1] * beta[word + 1]) @ moves.T, 1)
    return unit(alpha * beta, 1)


def train(texts: list[str], labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Fit by AdaGrad on the conditional log-likelihood of word labels (each word has its document's)."""
    k = len(languages)
    rng = np.random.default_rng(seed)
    hashes, columns, grams, doc = [], [], [], []
    for owner, parts in chunks(texts):
        flat = FlatWords(parts, lower=True)
        h, c, g = word_features(flat)
        cuts = np.append(flat.starts, len(flat.data))
        hashes.append(h)
        columns.append(c)
        for i in range(len(h)):
            grams.append(np.concatenate([x[cuts[i] : cuts[i + 1]] for x in g]))
        doc.append(owner[flat.doc])
    hashes, columns, doc = np.concatenate(hashes), np.concatenate(columns), np.concatenate(doc)
    grams = [g[g != NONE] for g in grams]
    words = {}
    for lang in range(k):
        found, counts = np.unique(hashes[labels[doc] == lang], return_counts=True)
        for h in found[np.argsort(-counts, kind="stable")[:LEXICON]]:
            words.setdefault(int(h), set()).add(lang)
    lexicon = np.array(sorted(words), dtype=np.uint64)
    member = np.zeros((len(lexicon) + 1, k))
    for i, h in enumerate(lexicon):
        member[i, list(words[int(h)])] = 1
    model = Model(languages, np.zeros((NONE + 1, k)), lexicon, member, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    in_lexicon = lexicon_rows(model, hashes)

    starts = chain_borders(doc)
    ends = np.append(starts[1:], len(doc))
    kept = rng.permutation(len(starts))[:TRAIN_CHAINS]
    halves = [np.arange(starts[c], ends[c]) for c in kept]
    mixed = [np.concatenate([a[: len(a) // 2], b[len(b) // 2 :]]) for a, b in zip(halves[::3], halves[1::3])]  # spliced: two texts in one chain
    data = [c for c in halves + mixed if len(c)]
    size_g = np.array([len(g) for g in grams])
    sums = [np.full_like(x, 1e-8) for x in (model.emission, model.member_weight, model.transition, model.start)]
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            batch = [data[c] for c in order[a : a + BATCH]]
            at = np.concatenate(batch)
            lengths = np.array([len(c) for c in batch])
            first = np.cumsum(lengths) - lengths
            flat_g = np.concatenate([grams[i] for i in at])
            of_word = np.repeat(np.arange(len(at)), size_g[at])
            score = model.emission[columns[at]].sum(axis=1) + model.member[in_lexicon[at]] @ model.member_weight
            at_gram = model.emission[flat_g]
            score += np.stack([np.bincount(of_word, weights=at_gram[:, c], minlength=len(at)) for c in range(k)], axis=1)
            gold = labels[doc[at]]
            p, moves, begin = forward_backward(score, first, model.transition, model.start, pairs=True)
            error = np.eye(k)[gold] - p
            follow = np.ones(len(at), dtype=bool)
            follow[first] = False
            b = np.flatnonzero(follow)
            seen = np.bincount(gold[b - 1] * k + gold[b], minlength=k * k).reshape(k, k)
            ids = np.concatenate([columns[at].ravel(), flat_g])
            errors = np.concatenate([np.repeat(error, columns.shape[1], axis=0), error[of_word]])
            grads = [
                np.stack([np.bincount(ids, weights=errors[:, c], minlength=NONE + 1) for c in range(k)], axis=1),
                model.member[in_lexicon[at]].T @ error,
                seen - moves,
                np.bincount(gold[first], minlength=k) - begin,
            ]
            for value, grad, total in zip((model.emission, model.member_weight, model.transition, model.start), grads, sums):
                grad = grad / len(at)
                total += grad**2
                value += RATE * grad / np.sqrt(total)
            model.emission[NONE] = 0
    return model


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> Model:
    """Learn from rows with text and language.  The sample is bounded for each language; the number
    of languages is taken to be small (their distinct values are read).  Null and repeated ids do not
    matter; an empty table gives a model without languages."""
    prepare(docs.sparkSession)
    known = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and trim(text) <> ''")
    counts = known.groupBy("lang").count().orderBy("lang")
    languages = [r.lang for r in counts.collect()]
    if not languages:
        return Model([], np.zeros((NONE + 1, 0)), np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    draws = known.withColumn("draw", F.xxhash64(F.coalesce("doc_id", F.lit("")), "text", F.lit(11)))
    picked = smallest_draws(draws, counts, "lang", train_rows)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        rows = pd.concat(list(batches), ignore_index=True).sort_values(["doc_id", "lang", "text"], kind="stable")
        model = train(rows["text"].tolist(), rows["lang"].map(languages.index).to_numpy(), languages)
        model.emission = model.emission.astype(np.float32)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    import pickle

    sample = picked.select("lang", "doc_id", "text").repartition(1)
    return pickle.loads(sample.mapInPandas(learn, "model binary").first().model)


def whole_texts(model: Model, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """``(text of each word, scores, lettered, words)`` with all words of a text in one group.

    Texts are read in pieces; the scores of a text that goes on in the next piece are held back.
    """
    held: list[tuple] = []

    def joined(rows: list[tuple]) -> tuple:
        return *(np.concatenate([r[k] for r in rows]) for k in range(3)), [w for r in rows for w in r[3]]

    for owner, parts in chunks(texts):
        flat = FlatWords(parts, lower=True)
        if not len(flat.starts):
            continue
        raw, who = flat.data.tobytes(), owner[flat.doc]
        lettered = np.add.reduceat(LETTER[flat.data], flat.starts) > 0
        row = who, emissions(model, flat).astype(np.float32), lettered, [raw[s:e] for s, e in zip(flat.starts.tolist(), flat.ends.tolist())]
        if held and held[-1][0][-1] != who[0]:
            yield joined(held)
            held = []
        cut = int(np.searchsorted(who, who[-1]))
        if cut:
            yield joined([*held, tuple(x[:cut] for x in row)])
            held = []
        held.append(tuple(x[cut:] for x in row))
    if held:
        yield joined(held)


def document_shares(model: Model, texts) -> tuple[np.ndarray, np.ndarray]:
    """For each text the language index and its expected share of the lettered words (0 and 0 without any)."""
    sums = np.zeros((len(texts), len(model.languages)))
    for who, score, lettered, _ in whole_texts(model, texts):
        marginal = whole_chains(score.astype(float), who, model.transition, model.start)
        for c in range(sums.shape[1]):
            sums[:, c] += np.bincount(who, weights=marginal[:, c] * lettered, minlength=len(texts))
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    return best, np.where(total > 0, sums.max(axis=1) / np.maximum(total, 1e-300), 0.0)


def word_labels(model: Model, text: str) -> list[tuple[str, str, float]]:
    """``(word, language, probability)`` of each lower-cased word of a text."""
    out = []
    for who, score, _, words in whole_texts(model, [text]):
        p = whole_chains(score.astype(float), who, model.transition, model.start)
        out += [(w.decode("utf-8", "replace"), model.languages[int(row.argmax())], float(row.max())) for w, row in zip(words, p)]
    return out


def judged_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``_row`` (a struct of all columns of ``docs``), ``lang_pred`` and ``lang_score`` of every row."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].alias("_text"))
    if not model.languages:
        return rows.select("_row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            best, share = document_shares(shared.value, texts.tolist())
            yield pd.DataFrame({"lang": [shared.value.languages[b] for b in best], "score": share})

    judged = rows.withColumn("_judged", F.pandas_udf(label, "lang string, score double")(F.col("_text")))
    known = F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False))
    return judged.select(
        "_row", F.when(known, F.col("_judged.lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.col("_judged.score")).otherwise(F.lit(0.0)).alias("lang_score"),
    )


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, lang_score``, the expected share of lettered words in that language.

    Null texts and those without a letter are ``und`` with score 0.  Ties go to the language first
    in order.  Every row is judged by its text alone, repeated rows alike; nulls in other columns do
    not matter.  The words of a text are one chain, however long.  An empty table gives an empty
    result, and a model without languages calls everything ``und``.  Columns of ``docs`` named
    ``lang_pred`` or ``lang_score`` are replaced.
    """
    own = [f"_row.`{c}`" for c in docs.columns if c not in ("lang_pred", "lang_score")]
    return judged_rows(docs, model, text).select(*own, "lang_pred", "lang_score")


def confident(docs: DataFrame, model: Model, least_share: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns and no others, in which one language holds at least ``least_share`` of the lettered words."""
    return judged_rows(docs, model, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least_share)).select("_row.*")


def fold(doc_id="doc_id"):
    """Remainder of the CRC-32 of the id's text modulo 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from documents whose id has a CRC-32 not congruent to 2 modulo 4 and label every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold() != 2))
    judged = identify(docs.select("doc_id", "text", (fold() == 2).alias("held_out")), model)
    return judged.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
