"""Categories: map, predict where unmapped, fill, evaluate."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.scorers import CLASSES, letter_scorer, letter_share

#: Raw category to simple category.
CATEGORY_MAP = {
    "Fiction": "Fiction",
    "Juvenile Fiction": "Children's Fiction",
    "Biography & Autobiography": "Nonfiction",
    "History": "Nonfiction",
    "Literary Criticism": "Nonfiction",
    "Philosophy": "Nonfiction",
    "Religion": "Nonfiction",
    "Comics & Graphic Novels": "Fiction",
    "Drama": "Fiction",
    "Juvenile Nonfiction": "Children's Nonfiction",
    "Science": "Nonfiction",
    "Poetry": "Fiction",
}

#: Genres that a row is looked up by, lower case.
GENRES = ("romance", "science fiction", "scifi", "fantasy", "horror", "mystery", "thriller", "comedy", "crime", "historical")


def simple_category(raw: Column, mapping: dict[str, str] | None = None) -> Column:
    """The mapped category, null where there is none."""
    pairs = [F.lit(x) for kv in (CATEGORY_MAP if mapping is None else mapping).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), raw)


def category_rows(df: DataFrame, value: str, col: str = "simple_categories") -> DataFrame:
    return df.where(F.col(col) == value)


def unmapped_rows(df: DataFrame, col: str = "simple_categories") -> DataFrame:
    return df.where(F.col(col).isNull())


def genre_filter(df: DataFrame, genres: tuple[str, ...] = GENRES, col: str = "categories") -> DataFrame:
    return df.where(F.lower(col).isin(*genres))


def frequent(df: DataFrame, col: str = "categories", more_than: int = 50) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count")).where(F.col("count") > more_than)


def options(df: DataFrame, col: str) -> DataFrame:
    """(pos, option): 'All', then the distinct values in order; the values are numbered as a list that people choose from."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("option")).distinct()
    numbered = values.select((F.row_number().over(Window.orderBy("option"))).alias("pos"), "option")
    return df.sparkSession.sql("SELECT 0 AS pos, 'All' AS option").unionByName(numbered).orderBy("pos")


def argmax_label(scores: dict[str, Column]) -> Column:
    """The label with the highest score; the first of tied ones."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.coalesce(*[F.when(c == best, F.lit(label)) for label, c in scores.items()])
    return out


def letter_class(text: Column, classes: dict[str, str] | None = None) -> Column:
    """The stand-in classifier as an expression."""
    return argmax_label({label: letter_share(text, x) for label, x in (classes or CLASSES).items()})


def classify(df: DataFrame, scorer: Callable | None = None, key: str = "isbn13", text: str = "description", classes: dict[str, str] | None = None) -> DataFrame:
    """(key, predicted_categories): each row's best label by a user's scorer, in batches over the partitions."""
    classes = classes or CLASSES
    make, labels = scorer or letter_scorer(classes), list(classes)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        score = make()
        for b in batches:
            s = score(pd.DataFrame({"text": b["text"].fillna("")}))[labels]
            best = s.to_numpy().argmax(axis=1) if len(s) else []
            yield pd.DataFrame({key: b[key], "predicted_categories": [labels[i] for i in best]})

    return df.select(key, F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, predicted_categories string")


def fill_categories(df: DataFrame, predicted: DataFrame, key: str = "isbn13", col: str = "simple_categories") -> DataFrame:
    """Left join of predictions into the rows without a category."""
    joined = df.join(predicted, key, "left")
    return joined.withColumn(col, F.coalesce(col, "predicted_categories")).drop("predicted_categories")


def sample_per_class(df: DataFrame, col: str, key: str, n: int = 300) -> DataFrame:
    """The first ``n`` rows by key of each class; fewer where a class has fewer."""
    rank = F.row_number().over(Window.partitionBy(col).orderBy(key))
    return df.withColumn("rank_in_class", rank).where(F.col("rank_in_class") <= n).drop("rank_in_class")


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(rows, hits, accuracy): one row; the accuracy is null for no rows."""
    hit = F.col(actual).eqNullSafe(F.col(predicted)).cast("double")
    return df.agg(F.count("*").alias("rows"), F.sum(hit).cast("long").alias("hits"), F.round(F.avg(hit), 6).alias("accuracy"))
