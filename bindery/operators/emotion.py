"""Emotions: scores of sentences, the most of each emotion for an item, tones to sort by."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.scorers import EMOTIONS, LETTERS, letter_scorer, letter_share
from bindery.functions.text import sentences

#: Tone to the emotion that it sorts by.
TONES = {"Happy": "joy", "Surprising": "surprise", "Angry": "anger", "Suspenseful": "fear", "Sad": "sadness"}

#: The renaming that turns three labels round; never part of the default path.
ROTATION = {"neutral": "sadness", "sadness": "surprise", "surprise": "neutral"}


def sentence_rows(df: DataFrame, key: str = "isbn13", text: str = "description") -> DataFrame:
    """(key, pos, sentence)."""
    return df.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def score_sentences(df: DataFrame, scorer: Callable | None = None, key: str = "isbn13", text: str = "description", skip_blank: bool = False) -> DataFrame:
    """(key, pos, one column for each emotion): a user's scorer run over sentences in batches across items."""
    rows = sentence_rows(df, key, text)
    if skip_blank:
        rows = rows.where(F.trim("sentence") != "")
    make = scorer or letter_scorer(LETTERS)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        score = make()
        for b in batches:
            out = score(pd.DataFrame({"text": b["sentence"]}))[list(EMOTIONS)].astype("float64")
            yield pd.concat([b[[key, "pos"]], out], axis=1)

    return rows.mapInPandas(run, f"{key} {kind}, pos int, " + ", ".join(f"{e} double" for e in EMOTIONS))


def most_of_each(scored: DataFrame, key: str = "isbn13") -> DataFrame:
    """(key, emotions): the highest sentence score of each emotion; partly summed before the shuffle."""
    return scored.groupBy(key).agg(*[F.max(e).alias(e) for e in EMOTIONS])


def letter_emotions(text: Column) -> dict[str, Column]:
    """The stand-in scores rolled up inside each row: no explode and no shuffle. The columns share one expression that
    splits the text and scores its sentences, which Spark evaluates once for a row."""
    scored = F.transform(sentences(text), lambda s: F.struct(*[letter_share(s, LETTERS[e]).alias(e) for e in EMOTIONS]))
    return {e: F.array_max(scored[e]) for e in EMOTIONS}


def relabel(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """All columns at once under new names, so that a cycle of names permutes them."""
    names = ROTATION if names is None else names
    return df.select([F.col(c).alias(names.get(c, c)) for c in df.columns])


def tone_score(tone: Column) -> Column:
    """The score that a request's tone sorts by; null for any other tone."""
    out = F.lit(None).cast("double")
    for name, emotion in TONES.items():
        out = F.when(tone == name, F.col(emotion)).otherwise(out)
    return out


def tone_sort(df: DataFrame, tone: str | None, key: str = "isbn13") -> DataFrame:
    """Rows by falling score of the tone's emotion, nulls last, ties by key; by key alone for any other tone."""
    emotion = TONES.get(tone or "")
    return df.orderBy(*([F.desc_nulls_last(emotion)] if emotion else []), key)


def sorted_predictions(predictions: Column) -> Column:
    """An array of (label, score) by label."""
    return F.array_sort(predictions)
