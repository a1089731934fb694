"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its words, of their prefixes and suffixes and of their
character n-grams, all hashed into one table; a linear layer with softmax gives the classes.  The
table and the layer are learned by stochastic gradient descent in numpy on a bounded sample of
labelled documents.  The logit is linear in the mean, so scoring needs one number per hash bucket
and runs as plain array work in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import prepare, table
from isoflow.llm.hashing import FlatWords, chunks, mix
from isoflow.llm.sampling import smallest_draws

BITS, DIM = 16, 8
NGRAMS = (3, 4)
REPEAT = 0
"""Bucket of a word that repeats the one before it."""
PAD = 20
"""Zero vectors in every mean, so that a handful of words decides little."""
TRAIN_ROWS = 3000
"""Labelled documents of each class that the model is fitted on: those with the smallest hash of their id."""
EPOCHS, RATE = 6, 1.0


def feature_buckets(flat: FlatWords) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(byte positions, buckets)`` of the features: word, prefix, suffix, repetition and n-grams."""
    s, e = flat.starts, flat.ends
    shift = np.uint64(64 - BITS)
    bucket = lambda h, salt: (mix(h + np.uint64(salt)) >> shift).astype(np.int64)
    out = [
        (s, bucket(flat.hash.of(s, e), 1)),
        (s, bucket(flat.hash.of(s, np.minimum(s + 3, e)), 2)),
        (s, bucket(flat.hash.of(np.maximum(e - 3, s), e), 3)),
    ]
    again = np.flatnonzero((out[0][1][1:] == out[0][1][:-1]) & (flat.doc[1:] == flat.doc[:-1])) + 1
    out.append((s[again], np.full(len(again), REPEAT)))
    room = flat.room()
    for n in NGRAMS:
        at = np.flatnonzero(room >= n)
        out.append((at, bucket(flat.hash.of(at, at + n), n + 10)))
    return out


def _bags(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(index, buckets, counts)`` of each text."""
    pending: dict[int, list[np.ndarray]] = {}
    for owner, parts in chunks(texts):
        flat = FlatWords(parts, lower=False)
        docs, ids = [], []
        for at, bucket in feature_buckets(flat):
            docs.append(np.searchsorted(flat.doc_starts, at, side="right") - 1)
            ids.append(bucket)
        docs, ids = np.concatenate(docs), np.concatenate(ids)
        order = np.argsort(docs, kind="stable")
        borders = np.searchsorted(docs[order], np.arange(len(parts) + 1))
        for k, i in enumerate(owner):
            pending.setdefault(int(i), []).append(ids[order[borders[k] : borders[k + 1]]])
    for i, found in pending.items():
        buckets, counts = np.unique(np.concatenate(found), return_counts=True)
        yield i, buckets.astype(np.int32), counts.astype(np.int32)


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = RATE,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases; ``prior`` is the share of label 1 among all training labels."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    weights, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, counts = bags[k]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = counts / (counts.sum() + PAD)
            mean = share @ vectors[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = weights @ p
            weights -= lr * np.outer(mean, p)
            bias -= lr * p
            vectors[ids] -= (lr * len(ids) ** 0.5) * share[:, None] * back
    seen = np.bincount(labels, minlength=2) + 1.0
    bias[1] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(seen[1] / seen[0])
    return vectors, weights, bias


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text", doc_id: str = "doc_id",
    label: str = "quality",
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Learn from ``labels`` (0 or 1; several labels of an id count as their maximum, nulls not at all).

    Ids may be of any type that both tables share; null ids have no label.  Rows of ``docs`` repeated
    with one id are all learned from.  Without any label the model is untrained.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    counts = known.groupBy("label").count()
    of = {r["label"]: r["count"] for r in counts.collect()}
    if not of:
        return np.zeros((1 << BITS, DIM)), np.zeros((DIM, 2)), np.zeros(2)
    share = of.get(1, 0) / sum(of.values())
    picked = smallest_draws(known, counts, "label", train_rows).select("doc_id", "label")
    kind = docs.schema[doc_id].dataType.simpleString()

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(_bags(batch["text"].tolist()))
            yield pd.DataFrame({"doc_id": [batch["doc_id"].iloc[i] for i, *_ in found], "label": [int(batch["label"].iloc[i]) for i, *_ in found], "ids": [b.tobytes() for _, b, _ in found], "counts": [c.tobytes() for *_, c in found]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.assign(size=rows["ids"].map(len)).sort_values(["doc_id", "label", "size"], kind="stable")
        data = [(np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for i, c in zip(rows["ids"], rows["counts"])]
        v, w, b = train(data, rows["label"].to_numpy(), share)
        yield pd.DataFrame({"vectors": [v.astype(np.float32).tobytes()], "weights": [w.tobytes()], "bias": [b.tobytes()]})

    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    bag_rows = sample.mapInPandas(bags, f"doc_id {kind}, label int, ids binary, counts binary")
    model = bag_rows.repartition(1).mapInPandas(learn, "vectors binary, weights binary, bias binary").first()
    if model is None:
        return np.zeros((1 << BITS, DIM)), np.zeros((DIM, 2)), np.zeros(2)
    return np.frombuffer(model.vectors, np.float32).reshape(-1, DIM).astype(float), np.frombuffer(model.weights).reshape(DIM, 2), np.frombuffer(model.bias)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, the probability of class 1 of the whole text.

    Null and empty texts get the probability that the biases give.  Every row is judged by its text
    alone, repeated rows alike; nulls in other columns do not matter.  An empty table gives an
    empty result, and an untrained model 0.5.  A column of ``docs`` named ``quality_score`` is
    replaced.
    """
    vectors, weights, bias = model
    pull = docs.sparkSession.sparkContext.broadcast((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64))
    start = float(bias[1] - bias[0])

    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for owner, parts in chunks(texts.tolist()):
                flat = FlatWords(parts, lower=False)
                for at, bucket in feature_buckets(flat):
                    who = owner[np.searchsorted(flat.doc_starts, at, side="right") - 1]
                    total += np.bincount(who, weights=pull.value[bucket], minlength=len(texts))
                    count += np.bincount(who, minlength=len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(start + total / (count + PAD), -50, 50))))

    return docs.withColumn("quality_score", F.pandas_udf(probabilities, "double")(F.col(text)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labels whose id has a CRC-32 not congruent to 1 modulo 3 and score every document."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold != 1))
    scored = score(docs.select("doc_id", "text", (fold == 1).alias("held_out")), model)
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"))
