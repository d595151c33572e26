"""Scorers. A user's model is a function from a pandas DataFrame of texts to one of scores, made once in each task by a
factory, so that weights load once. The deterministic scorers here stand in for models in tests and have no semantic
quality; each exists as a column expression and as a factory that does the same arithmetic."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMOTIONS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")
LETTERS = {"anger": "a", "disgust": "d", "fear": "f", "joy": "e", "neutral": "n", "sadness": "s", "surprise": "u"}
CLASSES = {"Fiction": "e", "Nonfiction": "i"}
DIMENSIONS = 64
KNOWN_WORDS = 1 << 18  # whose buckets a task remembers


def letter_share(text: Column, letter: str) -> Column:
    """Share of a letter among a text's characters, 0 for the empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.replace(text, F.lit(letter)))) / n)


def letter_scorer(letters: dict[str, str]):
    """Factory of a scorer: column ``text`` to one column of letter shares for each label."""

    def make():
        def score(batch: pd.DataFrame) -> pd.DataFrame:
            text = batch["text"]
            n = text.str.len().clip(lower=1)
            return pd.DataFrame({label: text.str.count(letter) / n for label, letter in letters.items()}, index=batch.index)

        return score

    return make


def token_bucket(word: Column, dimensions: int = DIMENSIONS) -> Column:
    """The first 32 bits of the word's MD5 modulo the dimensions, of which two digits decide if they divide 256."""
    at, digits = (7, 2) if 256 % dimensions == 0 else (1, 8)
    return F.pmod(F.conv(F.substring(F.md5(word), at, digits), 16, 10).cast("long"), F.lit(dimensions))


def hash_embedder(dimensions: int = DIMENSIONS):
    """Factory of an embedder: texts to unit vectors of hashed counts of lower-cased words."""

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            bucket = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimensions
            return bucket

    def make():
        bucket_of = Buckets().__getitem__

        def embed(texts: pd.Series) -> list[np.ndarray]:
            out = []
            for t in texts:
                words = t.lower().split()
                v = np.bincount(np.fromiter(map(bucket_of, words), np.int64, len(words)), minlength=dimensions)
                out.append(v / (math.sqrt((v * v).sum()) or 1.0))
            return out

        return embed

    return make


def budgeted(scorer, tokens: int = 1 << 14, length=lambda text: text.str.split().str.len()):
    """Factory of ``scorer`` that gets its texts in batches of about one length.

    A model pads the texts of a batch to the longest, so a batch costs its longest text's length times its texts. Texts are put in order
    of length and cut where that product would pass ``tokens``; one longer text is a batch of its own. Scores come back
    in the order of the texts.
    """

    def make():
        score = scorer()

        def scored(batch: pd.DataFrame) -> pd.DataFrame:
            n = length(batch["text"].fillna("")).clip(lower=1).to_numpy()
            order = np.argsort(n, kind="stable")
            parts, start = [], 0
            for k in range(len(order) + 1):
                if k == len(order) or (k > start and n[order[k]] * (k + 1 - start) > tokens):
                    if k > start:
                        parts.append(score(batch.iloc[order[start:k]]))
                    start = k
            return pd.concat(parts).loc[batch.index] if parts else score(batch)

        return scored

    return make
