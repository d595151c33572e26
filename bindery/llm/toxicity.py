"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space runs become one space, and its character n-grams of ``ORDERS`` are hashed into
2 ^ ``BITS`` features, each the n-gram's share of the text. From labelled texts Spark sums the shares by label, which
gives each feature's log-count ratio r = ln((p + PRIOR) / |p|) - ln((q + PRIOR) / |q|). Logistic regression over shares times
ratios is trained by Adagrad in ``PARTS`` parts of the labelled texts; after each round the parts' weights are averaged
and sent out again. A score is the logistic of the mean weight of the text's n-grams,
calibrated (Platt scaling) on one more part that teaches nothing else.

Training uses a sample of at most about ``train_rows`` labelled rows, twice that where ids are repeated (by hash of
doc_id and text, alike at every size), the documented bound; it is what the broadcast and the training tasks are sized
by. Everything else covers all rows.

Defined cases: null, empty and blank texts get the score of a text without features; labels of null are not learnt
from; without labels of both kinds all scores are 0; repeated rows are scored alike and teach once, each of the labels of
a repeated doc_id with each of its texts; very long texts are read whole, in pieces; an empty table gives an empty
table; columns other than ``doc_id`` and ``text`` are not read, and ``without_toxic`` passes all columns on as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import each_text, rows_by_text, stage

BITS = 18
ORDERS = (4, 5, 6)
PARTS = 4
ROUNDS = 3
EPOCHS = 4
RATE = 0.4  # of Adagrad
PRIOR = 3.0  # added to each feature's sum of shares
TRAIN_ROWS = 16_000
RUN = 1 << 17
SCALE = 500.0
LEAST = 600  # n-grams that a shorter text counts as having


def features(text: str | None):
    """Feature numbers of a text's n-grams, repeats included, in bounded pieces."""
    line = " " + " ".join((text or "").lower().split()) + " "
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for a in range(0, len(points), RUN):  # pieces overlap by the longest n-gram less one
        piece = points[a : a + RUN + ORDERS[-1] - 1]
        h = np.zeros(len(piece), np.uint64)
        for k in range(1, ORDERS[-1] + 1):
            n = min(RUN, len(piece) - k + 1)
            if n <= 0:
                break
            h = (h[: len(piece) - k + 1] ^ piece[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k in ORDERS:
                yield ((h[:n] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct features, their shares in the text times SCALE)."""
    found = np.concatenate([np.zeros(0, np.int32), *features(text)])
    distinct, counts = np.unique(found, return_counts=True)
    return distinct, (counts * (SCALE / max(LEAST, len(found)))).astype(np.float32)


def logits(weights: np.ndarray, bias: float, texts: Iterable[str | None]) -> np.ndarray:
    z = []
    for t in texts:
        total, n = 0.0, 0
        for found in features(t):
            total += float(weights[found].sum(dtype=np.float64))
            n += len(found)
        z.append(bias + SCALE * total / max(LEAST, n))
    return np.array(z, np.float64)


def scores(weights: np.ndarray, bias: float, texts: Iterable[str | None]) -> np.ndarray:
    z = logits(weights, bias, texts)
    return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(part, toxic, text) of the training sample, each different (doc_id, text, toxic) once. The labels' ids are at most
    about ``train_rows``, so they are broadcast and the texts stay where they are; where ids are repeated in ``docs``,
    the rows are sampled once more."""
    space = 1 << 30
    within = lambda share, *cols: F.pmod(F.xxhash64(*cols), F.lit(space)) < int(share * space)
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    picked = known.where(within(min(1.0, train_rows / max(1, known.count())), "doc_id"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), "doc_id")
    found = rows.select("doc_id", "toxic", "h").distinct().count()
    if found > 2 * train_rows:
        rows = rows.where(within(train_rows / found, F.lit(5), "doc_id", "h"))
    once = rows.groupBy("doc_id", "toxic", "h").agg(F.first("text").alias("text"))
    return stage(once.select(F.pmod(F.xxhash64("doc_id", "toxic", "h"), F.lit(PARTS + 1)).cast("int").alias("part"), "toxic", "text"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias) learnt from ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    labelled = _labelled(docs, labels, train_rows)
    sample = labelled.where(F.col("part") < PARTS).groupBy("part")
    order = [("toxic", "ascending"), ("text", "ascending")]  # so that reruns agree

    def count(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        held = np.zeros((2, 1 << BITS), np.float32)
        rows = [0, 0]
        for y, t in zip(part.column("toxic").to_pylist(), each_text(part.column("text"))):
            found, share = shares(t)
            held[int(y > 0)][found] += share
            rows[int(y > 0)] += 1
        return pa.Table.from_arrays([pa.array([rows[0]]), pa.array([rows[1]]), pa.array([held.tobytes()])], ["n0", "n1", "counts"])

    parts = sample.applyInArrow(count, "n0 bigint, n1 bigint, counts binary").collect()
    n = np.array([[r.n0, r.n1] for r in parts]).reshape(-1, 2).sum(axis=0)
    if not n.all():
        return np.zeros(1 << BITS, np.float32), -np.inf
    sums = sum(np.frombuffer(r.counts, np.float32).reshape(2, -1).astype(np.float64) for r in parts)
    counts = sums * (n.min() / n)[:, None] + PRIOR  # as of equally many texts, so that rare n-grams lean to neither label
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio = ratio.astype(np.float32)
    weights, bias = np.full(1 << BITS, 0.1, np.float32), float(np.log(n[1] / n[0]))
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast((ratio, weights, bias))

        def learn(part: pa.Table) -> pa.Table:
            part = part.sort_by(order)
            ratio, weights, bias = model.value  # run before the loop goes on
            weights, total, own = weights.copy(), np.full(1 << BITS, 1.0, np.float32), np.float64(1.0)
            rows = [(float(y > 0), *shares(t)) for y, t in zip(part.column("toxic").to_pylist(), each_text(part.column("text")))]
            dealt = np.random.default_rng(11)
            for _ in range(EPOCHS):
                for i in dealt.permutation(len(rows)):
                    y, f, x = rows[i]
                    x = x * ratio[f]
                    g = 1 / (1 + np.exp(-np.clip(float(weights[f] @ x) + bias, -60, 60))) - y
                    step = g * x + 1e-4 * weights[f]
                    total[f] += step * step
                    weights[f] -= RATE * step / np.sqrt(total[f])
                    own += g * g
                    bias -= RATE * g / np.sqrt(own)
            return pa.Table.from_arrays([pa.array([len(rows)]), pa.array([float(bias)]), pa.array([weights.tobytes()])], ["n", "bias", "weights"])

        learnt = sample.applyInArrow(learn, "n bigint, bias double, weights binary").collect()
        model.destroy()
        share = np.array([r.n for r in learnt]) / sum(r.n for r in learnt)
        weights = sum(s * np.frombuffer(r.weights, np.float32) for s, r in zip(share, learnt)).astype(np.float32)
        bias = float(sum(s * r.bias for s, r in zip(share, learnt)))
    model = spark.sparkContext.broadcast((weights * ratio, bias))

    def judge(batches):
        for b in batches:
            z = logits(*model.value, each_text(b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(z), b.column(1)], ["z", "toxic"])

    judged = labelled.where(F.col("part") == PARTS).mapInArrow(judge, "z double, toxic int").toArrow()
    model.destroy()
    slope, shift = platt(judged.column("z").to_numpy(), judged.column("toxic").to_numpy() > 0)
    return weights * ratio * np.float32(slope), bias * slope + shift


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic that fits labels ``y`` to logits ``z``, by Newton steps, with a weak prior at
    slope 1 and shift 0 and Platt's softened targets."""
    n1, n0 = int(y.sum()), int((~y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([np.clip(z, -30, 30), np.ones(len(z))], axis=1)
    w, start, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.eye(2) * 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (p - t) + prior @ (w - start))
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; ``labels`` (doc_id, toxic) are those that may be learnt from."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))

    def run(batches):
        for b in batches:
            s = scores(*model.value, each_text(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))
    return rows_by_text(docs, lambda texts: scores(*model.value, texts) < threshold)
