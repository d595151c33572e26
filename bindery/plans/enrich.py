"""The enrichment chain: clean, categorise, score emotions. Lazy: run it whole or write any step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.operators import category, clean, emotion


def with_categories(cleaned: DataFrame, scorer: Callable | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Simple categories from the map, and from the classifier where the map has none."""
    mapped = cleaned.withColumn("simple_categories", category.simple_category(F.col("categories"), mapping))
    predicted = category.classify(category.unmapped_rows(mapped), scorer)
    return category.fill_categories(mapped, predicted)


def with_emotions(df: DataFrame, scorer: Callable | None = None) -> DataFrame:
    """The highest sentence score of each emotion, joined by key."""
    scores = emotion.most_of_each(emotion.score_sentences(df, scorer))
    return df.join(scores, "isbn13", "inner")


def enrich(catalogue: DataFrame, classifier: Callable | None = None, emotions: Callable | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    return with_emotions(with_categories(clean.clean_catalogue(catalogue), classifier, mapping), emotions)
