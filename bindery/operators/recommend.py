"""Recommendations: the nearest items, cut by category, sorted by tone; for one request or a table of them.

Order matters and is explicit. ``order="catalogue"`` takes the first items by key among the nearest, as a look-up of the
nearest ids in the catalogue does; ``order="distance"`` takes the nearest first. Tone sorts what is left after the cut
and changes no membership. A category of None or 'All' does not filter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as X
from bindery.functions.scorers import hash_embedder
from bindery.operators import cells
from bindery.operators.emotion import tone_score, tone_sort
from bindery.operators.vectors import embed, nearest, nearest_batch
from bindery.sources.scratch import landed

ALL = "All"


def semi_join_ids(catalogue: DataFrame, ids: DataFrame, key: str = "isbn13") -> DataFrame:
    """Catalogue rows whose key is among ``ids``, which Spark sends out if they are few, as those of a search are."""
    return catalogue.join(ids.select(key), key, "left_semi")


def semantic_lookup(index: DataFrame, catalogue: DataFrame, query: list[float], k: int = 50, key: str = "isbn13") -> DataFrame:
    """The catalogue rows of the ``k`` nearest items, in catalogue order."""
    near = nearest(index, query, k).withColumnRenamed("vec_id", key)
    return semi_join_ids(catalogue, near, key).orderBy(key)


def found_ids(index: DataFrame, query: list[float], k: int = 50, key: str = "isbn13") -> DataFrame:
    """(key, d) of the ``k`` nearest items, searched once: at most ``k`` rows, which go through the driver."""
    near = nearest(index, query, k).withColumnRenamed("vec_id", key)
    return index.sparkSession.createDataFrame(near.toArrow())  # a local relation: reading it again is no job


def recommend(index: DataFrame, catalogue: DataFrame, query: list[float] | None, category: str | None = None, tone: str | None = None, initial_k: int = 50, final_k: int = 10, order: str = "catalogue", key: str = "isbn13", near: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Recommendations for one vector. ``near`` are the ids found for it (see ``found_ids``), where they are known already;
    ``prepare`` makes the columns that tones need for the ``final_k`` items that are left, and for no others."""
    near = found_ids(index, query, initial_k, key) if near is None else near
    rows = catalogue.join(F.broadcast(near), key)
    by = ["d", key] if order == "distance" else [key]
    rows = rows.orderBy(*by).limit(initial_k)
    if category not in (None, ALL):
        rows = rows.where(F.col("simple_categories") == category)
    rows = rows.orderBy(*by).limit(final_k).drop("d")
    return tone_sort(prepare(rows) if prepare else rows, tone, key)


def ask(index: DataFrame, catalogue: DataFrame, text: str, embedder: Callable | None = None, **limits) -> DataFrame:
    """Recommendations for a text: embedded by the embedder that built the index, then searched. A blank text finds nothing."""
    if not text.strip():
        return catalogue.limit(0)
    vector = (embedder or hash_embedder())()(pd.Series([text]))[0]
    return recommend(index, catalogue, [float(np.float32(x)) for x in vector], **limits)


def gallery(recommended: DataFrame, *keep: str) -> DataFrame:
    """(large_thumbnail, caption) for display, after the columns in ``keep``."""
    return recommended.select(
        *keep,
        X.large_thumbnail(F.col("thumbnail")).alias("large_thumbnail"),
        X.caption(F.col("title"), F.col("authors"), F.col("description")).alias("caption"),
    )


def recommend_batch(index: DataFrame | str, catalogue: DataFrame, requests: DataFrame, initial_k: int = 50, final_k: int = 10, order: str = "catalogue", key: str = "isbn13", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, pos, catalogue columns) for a table of requests (query_id, query, embedding, category, tone).

    ``index`` is a table of vectors, or the path of one that is stored in cells. Blank queries give nothing. Ranks within a request replace
    global limits, so requests run side by side. ``prepare``
    makes the columns that recommending needs (categories, emotions) for the items that were found, and for no others.
    """
    asked = requests.where(F.length(F.trim("query")) > 0)
    vectors = asked.select("query_id", "embedding")
    found = cells.search(asked.sparkSession, index, vectors, initial_k) if isinstance(index, str) else nearest_batch(index, vectors, initial_k)
    near = landed(found.withColumnRenamed("vec_id", key), "near")
    wanted = asked.select("query_id", F.col("category").alias("wanted_category"), F.col("tone").alias("wanted_tone"))
    items = catalogue.join(near.select(key).distinct(), key, "left_semi")
    rows = (prepare(items) if prepare else items).join(near, key).join(wanted, "query_id")
    by = [F.col("d"), F.col(key)] if order == "distance" else [F.col(key)]
    request = Window.partitionBy("query_id")
    rows = rows.withColumn("pos", F.row_number().over(request.orderBy(*by))).where(F.col("pos") <= initial_k)
    open_to_all = F.col("wanted_category").isNull() | (F.col("wanted_category") == ALL)
    rows = rows.where(open_to_all | (F.col("simple_categories") == F.col("wanted_category")))
    rows = rows.withColumn("pos", F.row_number().over(request.orderBy(*by))).where(F.col("pos") <= final_k)
    rows = rows.withColumn("tone_score", tone_score(F.col("wanted_tone")))
    final = request.orderBy(F.desc_nulls_last("tone_score"), *(by if order == "distance" else [F.col(key)]))
    return rows.withColumn("pos", F.row_number().over(final)).drop("d", "wanted_category", "wanted_tone", "tone_score")


def ask_batch(index: DataFrame | str, catalogue: DataFrame, requests: DataFrame, embedder: Callable | None = None, **limits) -> DataFrame:
    """As ``recommend_batch``, for requests without vectors (query_id, query, category, tone): their texts are embedded by the
    embedder that built the index."""
    asked = requests.where(F.length(F.trim("query")) > 0)
    vectors = embed(asked.select("query_id", "query"), "query_id", "query", embedder)
    return recommend_batch(index, catalogue, asked.join(vectors, "query_id"), **limits)
