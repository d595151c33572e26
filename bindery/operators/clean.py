"""Cleaning: incomplete rows, short texts, derived text columns. One narrow pass, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import text as X
from bindery.sources.files import observed

CRITICAL = ("description", "num_pages", "average_rating", "published_year")
BANDS = ((1, 4), (5, 14), (15, 24), (25, 34))


def drop_incomplete(df: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    return df.dropna("any", subset=list(critical))


def incomplete_rows(df: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    return df.where(reduce(or_, [F.col(c).isNull() for c in critical]))


def retention(df: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """(rows, incomplete, retained_share): one row; the share is null for no rows."""
    missing = F.count_if(reduce(or_, [F.col(c).isNull() for c in critical]))
    return df.agg(
        F.count("*").alias("rows"), missing.alias("incomplete"),
        F.round(1 - F.try_divide(missing, F.count("*")), 6).alias("retained_share"),
    )


def min_words(df: DataFrame, n: int = 25, col: str = "description") -> DataFrame:
    return df.where(X.word_count(F.col(col)) >= n)


def length_band_rows(df: DataFrame, low: int, high: int, col: str = "description") -> DataFrame:
    return df.where(X.word_count(F.col(col)).between(low, high))


def length_bands(df: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, col: str = "description") -> DataFrame:
    """The rows in any of the bands, with their ``band``, in one pass."""
    n, band = X.word_count(F.col(col)), F.lit(None).cast("string")
    for low, high in bands:
        band = F.when(n.between(low, high), f"{low}-{high}").otherwise(band)
    return df.withColumn("band", band).where(F.col("band").isNotNull())


def clean_catalogue(df: DataFrame, words: int = 25) -> DataFrame:
    """Complete rows with long enough descriptions, plus title_and_subtitle and description_with_id, minus subtitle."""
    kept = min_words(drop_incomplete(df), words)
    return kept.withColumns({
        "title_and_subtitle": X.title_and_subtitle(F.col("title"), F.col("subtitle")),
        "description_with_id": X.text_with_id(F.col("isbn13"), F.col("description")),
    }).drop("subtitle")


def write_cleaned(df: DataFrame, path: str, words: int = 25, critical: tuple[str, ...] = CRITICAL) -> dict[str, int]:
    """Write the cleaned catalogue under ``path`` and tell, from the same pass, how many rows were read, had no id, were
    incomplete, were complete but too short, and were written."""
    incomplete = reduce(or_, [F.col(c).isNull() for c in critical])
    short = ~incomplete & (X.word_count(F.col("description")) < words)
    rows, seen = observed(df, "cleaning", no_id=F.col("isbn13").isNull(), incomplete=incomplete, short=short)
    rows, kept = observed(clean_catalogue(rows, words), "cleaned")
    rows.write.parquet(path)
    return seen.get | {"written": kept.get["read"]}
