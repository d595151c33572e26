"""Language identification by interpolated Kneser-Ney character 4-gram models, one per language.

Texts are lower-cased and reduced to letters with one gap between words: a to z are classes of their own, and other letters
share a hundred more by code point, so that neighbours in a script stay apart. Spark counts 4-grams by language; the models
are sorted hash arrays (at most 2 ^ 28 entries for each language and some hundred thousand in practice, see ``charlm``),
broadcast one by one. A text goes to the language with the lowest cross-entropy per character. The score is that language's
share in a softmax of the negative cross-entropies times length ^ 0.5 times a factor, the one of ``FACTORS`` with the least log
loss over all training rows; ``accepted`` is false below the score that all but ``reject_share`` of the rightly labelled
training rows reach, found among all of them: calibrated rejection. Cross-entropies are computed once a row and landed; of
them, sums for each factor and counts of scores in 65,536 bins at a time reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not accepted; rows without a language
teach nothing; if nothing teaches, all rows are ``und``; ties go to the first language by code point; repeated rows
count again; very long texts are read whole, in one piece; an empty table gives an empty table; columns other than
doc_id, text and lang are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.charlm import Alphabet, Model, Models, language_models
from bindery.llm.common import discard, stage

ALPHABET = Alphabet(bits=7, order=4, letters=True)
UNKNOWN = "und"
FACTORS = np.geomspace(0.05, 50, 31)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def shares(ce: np.ndarray, chars: np.ndarray, factor: float) -> np.ndarray:
    """The share of each text's best language, from cross-entropies (texts by languages) and text lengths."""
    return 1 / np.exp((ce.min(axis=1, keepdims=True) - ce) * (factor * np.sqrt(chars))[:, None]).sum(axis=1)


def classify(model: Model | Models | None, factor: float, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if model and has_letter(t)]
    if some:
        mine = [texts[i] for i in some]
        ce = model.cross_entropy(mine)
        scores[some] = shares(ce, np.array([len(t) for t in mine]), factor)
        for i, b in zip(some, ce.argmin(axis=1)):
            langs[i] = model.langs[b]
    return langs, scores


def losses(ce: np.ndarray, chars: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Log loss of the right columns under each of ``FACTORS``, summed over rows in whole 2^-20 nats, so that sums do not
    depend on their order."""
    out = np.zeros(len(FACTORS), np.int64)
    for k, factor in enumerate(FACTORS):
        z = -ce * factor * np.sqrt(chars)[:, None]
        z -= z.max(axis=1, keepdims=True)
        loss = np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]
        out[k] = np.rint(loss * (1 << 20)).astype(np.int64).sum()
    return out


def best_factor(judged: DataFrame) -> float:
    """The factor with the least log loss over the rows of ``judged`` (ce, chars, truth) whose language is known."""

    def run(batches):
        for b in batches:
            chars, truth = (b.column(k).to_numpy() for k in (1, 2))
            if len(truth):
                ce = b.column(0).flatten().to_numpy().reshape(len(truth), -1)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(FACTORS)), pa.int32()), pa.array(losses(ce, chars, truth))], ["factor", "loss"])

    known = judged.where("truth is not null").select("ce", "chars", "truth")
    sums = known.mapInArrow(run, "factor int, loss bigint").groupBy("factor").agg(F.sum(F.col("loss").cast("decimal(38,0)")).alias("loss")).collect()
    return float(FACTORS[min((r.loss, r.factor) for r in sums)[1]]) if sums else 1.0


def _ranked(bits: DataFrame, rank: int) -> tuple[int, int]:
    """(the value with ``rank`` smaller or equal ones before it, the one after it) of a bigint column, not negative: the bin of 16
    more leading bits that holds it is counted out at each step."""
    low, high, before = 0, (1 << 63) - 1, 0
    for shift in (48, 32, 16, 0):
        bins = bits.where(F.col("bits").between(low, high)).groupBy(F.shiftright("bits", shift).alias("bin")).agg(F.count("*").alias("n"))
        for r in bins.orderBy("bin").collect():
            if before + r.n > rank:
                break
            before += r.n
        low, high = r.bin << shift, ((r.bin + 1) << shift) - 1
    if before + r.n > rank + 1:
        return low, low
    after = bits.where(F.col("bits") > low).agg(F.min("bits").alias("bits")).first().bits
    return low, low if after is None else after


def quantile(bits: DataFrame, share: float) -> float:
    """What ``share`` of all numbers lie below, exactly, between neighbours as numpy has it; 0 if there are none. ``bits``
    holds the patterns of doubles that are not negative, which are in their order."""
    n = bits.count()
    if not n:
        return 0.0
    rank = math.floor((n - 1) * share)
    a, b = np.array(_ranked(bits, rank), np.int64).view(np.float64)
    return float(a + (b - a) * ((n - 1) * share - rank))


def identify(docs: DataFrame, train: Column, reject_share: float = 0.005) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each row of ``docs``; rows where ``train`` holds and lang is known teach."""
    teaches = train & F.col("lang").isNotNull() & F.col("text").isNotNull()
    models = language_models(docs.where(teaches), ALPHABET, False, lambda df: stage(df, "language-grams"))
    if not models.parts:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    langs, kind = models.langs, docs.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            some = np.array([has_letter(t) for t in texts], bool)
            mine = [t for t, x in zip(texts, some) if x]
            ce = models.cross_entropy(mine).ravel() if mine else np.zeros(0)
            ends = np.append(0, np.cumsum(some) * len(langs)).astype(np.int32)
            truth = [langs.index(y) if x and y in models.parts else None for x, y in zip(some, b.column(2).to_pylist())]
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ce)), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(truth, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ce", "chars", "truth"])

    rows = docs.select("doc_id", "text", F.when(teaches, F.col("lang")).alias("lang"))
    judged = stage(rows.mapInArrow(judge, f"doc_id {kind}, ce array<double>, chars bigint, truth int"), "language-entropies")
    factor = best_factor(judged) if len(langs) > 1 else 1.0

    def score(batches):
        for b in batches:
            some = np.flatnonzero(pc.list_value_length(b.column(1)).to_numpy())
            ce = b.column(1).flatten().to_numpy().reshape(len(some), len(langs))
            best, scores = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            if len(some):
                best[some], scores[some] = ce.argmin(axis=1), shares(ce, b.column(2).to_numpy()[some], factor)
            names = pa.array([*langs, UNKNOWN]).take(pa.array(best % (len(langs) + 1)))
            bits = pc.if_else(pc.equal(b.column(3), pa.array(best, pa.int32())), pa.array(scores.view(np.int64)), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(scores), bits], ["doc_id", "lang_pred", "score", "bits"])

    scored = stage(judged.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, bits bigint"), "language-scores")
    discard(judged)
    least = quantile(scored.where("bits is not null").select("bits"), reject_share) if len(langs) > 1 else 0.0
    return scored.select("doc_id", "lang_pred", "score", ((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).alias("accepted"))
