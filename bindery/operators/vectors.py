"""Embeddings and nearest neighbours by exact squared distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.scorers import DIMENSIONS, hash_embedder, token_bucket
from bindery.functions.text import words

QUERY_BLOCK = 1024
QUERY_STEP = 64  # queries of a block that meet an Arrow batch at once


def hash_embed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, value): the non-zero entries of each row's hashed unit vector, as expressions inside the row."""
    # A text's buckets as a string of a character each, which is hashed and split once and counted by native functions.
    first = ord("!")
    buckets = F.array_join(F.transform(words(F.lower(F.col(text))), lambda w: F.char(token_bucket(w) + first)), "")

    def counted(line):
        n = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda b: F.struct(b.alias("bucket"), (F.length(line) - F.length(F.replace(line, F.char(b + first), F.lit("")))).alias("n")))
        return F.filter(n, lambda c: c["n"] > 0)

    def scaled(counts):
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, c: total + c["n"] * c["n"]))
        zipped = F.arrays_zip(counts.alias("c"), F.array_repeat(norm, F.size(counts)).alias("norm"))
        return F.transform(zipped, lambda x: F.struct(x["c"]["bucket"].alias("bucket"), (x["c"]["n"] / x["norm"]).alias("value")))

    return df.select(key, F.inline(F.flatten(F.transform(F.transform(F.array(buckets), counted), scaled))))


def embed(df: DataFrame, key: str, text: str, embedder: Callable | None = None) -> DataFrame:
    """(key, embedding): a user's embedder run over the texts in batches; made once in each task."""
    make = embedder or hash_embedder()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [list(map(float, v)) for v in model(b["text"].fillna(""))]})

    return df.select(key, F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def squared_distance(vec: Column, query: list[float]) -> Column:
    """Squared distance to one vector, inside generated code."""
    at = F.array(*[F.lit(float(x)) for x in query])
    steps = F.zip_with(F.transform(vec, lambda x: x.cast("double")), at, lambda a, b: (a - b) * (a - b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def nearest(index: DataFrame, query: list[float], k: int = 50, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, d): the ``k`` rows nearest to one vector, ties by key: a top-k in each task, then over the tasks."""
    scored = index.where(F.col(vec).isNotNull()).select(key, squared_distance(F.col(vec), query).alias("d"))
    return scored.orderBy("d", key).limit(k)


def nearest_rows(keys: pa.Array, x: np.ndarray, ids: pa.Array, q: np.ndarray, k: int, names: list[str]):
    """Batches (id, key, d) of the ``k`` rows of ``x`` that are nearest to each row of ``q`` by (d, key).

    Products say which rows rounding could place among the ``k`` nearest, and those get the plain expression's distance.
    """
    norms, squares = (q * q).sum(axis=1), (x * x).sum(axis=1)
    # What product and plain expression may round differently, four times: at the k-th row and at any other.
    slack = 16 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(norms) + np.sqrt(squares.max())) ** 2
    for a in range(0, len(q), QUERY_STEP):
        part = slice(a, a + QUERY_STEP)
        near = norms[part, None] + squares[None, :] - 2 * q[part] @ x.T
        kth = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        which, at = np.nonzero(~(near > (kth + slack[part])[:, None]))  # NaN stays
        which += a
        d = np.zeros(len(which))
        for c in range(x.shape[1]):  # summed in the order of the plain expression
            step = x[at, c] - q[which, c]
            d += step * step
        rows = pa.table([pa.array(which), pa.array(np.isnan(d)), pa.array(d), keys.take(pa.array(at))], ["which", "nan", "d", "key"])
        order = pc.sort_indices(rows, [(c, "ascending") for c in rows.column_names], null_placement="at_start").to_numpy()
        which = which[order]  # the k best of each query by (d, key)
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        best = order[rank < k]
        rows = rows.take(pa.array(best)).combine_chunks()
        if len(best):
            yield pa.RecordBatch.from_arrays([ids.take(rows["which"].combine_chunks()), rows["key"].combine_chunks(), rows["d"].combine_chunks()], names)


def nearest_batch(index: DataFrame, queries: DataFrame, k: int = 50, key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, key, d): the ``k`` nearest rows for each of many query vectors. Each block of queries is a pass over the
    index; for more than a few, ``cells.search`` asks an index that is stored in cells.

    Queries come in blocks of about ``block`` vectors; a block is broadcast and the index stays where it is. Each Arrow
    batch meets the block in matrix products. Every row that rounding could place among a query's ``k`` nearest gets its
    exact distance, and the ``k`` best by (d, key) are passed on, however many rows are equally near;
    a rank over the queries merges them, so at most ``k`` rows a query and batch are shuffled.
    """
    spark = index.sparkSession
    rows = queries.select(query_key, vec).where(F.col(vec).isNotNull())
    n_blocks = max(1, -(-rows.count() // block))
    kinds = index.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    out = None
    for part in range(n_blocks):
        held = (rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64(query_key), F.lit(n_blocks)) == part)).toArrow()
        if not held.num_rows:
            continue
        matrix = np.array(held.column(1).to_pylist(), dtype=np.float64)
        shared = spark.sparkContext.broadcast((held.column(0).combine_chunks(), matrix))

        def run(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                b = b.filter(b.column(1).is_valid())
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    yield from nearest_rows(b.column(0), x, ids, q, k, [query_key, key, "d"])

        found = index.select(key, vec).mapInArrow(run, f"{query_key} {kinds[1]}, {key} {kinds[0]}, d double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{query_key} {kinds[1]}, {key} {kinds[0]}, d double")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("d", key))
    return out.withColumn("pos", rank).where(F.col("pos") <= k).drop("pos")


def build_index(df: DataFrame, path: str, key: str, text: str, embedder: Callable | None = None) -> DataFrame:
    """Embed once and keep as Parquet; readers scan it."""
    embed(df, key, text, embedder).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
