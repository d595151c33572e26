"""A stored vector index in cells: k-means by aggregations, Parquet partitioned by cell, exact search that skips cells.

``build`` fits centres on a bounded sample, gives every vector the cell of its nearest centre, and stores the cells as packs:
rows of up to ``PACK`` vectors of one cell that lie at about the same distance from its centre. Beside them lies a row a
cell with the centre, the number of vectors and the largest distance.

``search`` answers a table of queries in two steps. The cells with the nearest centres give each query a first k-th
distance. Then only cells, and in them only packs, that can hold anything nearer by the triangle inequality are looked
at. Queries travel to the cells as packs too and are joined with them by cell, so neither side is collected and Spark
chooses by size what it sends out; where that is the queries, the cells that nobody asks are pruned from the scan. A pack of
queries meets a pack of vectors in one matrix product, and no more than ``k`` rows a query leave it.

Centres are held in each task (``MOST_CENTRES`` numbers at most). A cell of any size is many packs, and rows are dealt by
ranges of (cell, distance, key), so that equal vectors do not meet in one task.

Defined cases: null vectors are in no cell; vectors with a number that is not finite are in a cell of their own that every
search looks at; a query of such a vector looks at all cells, and a null one finds nothing; equal distances go by key; with
fewer than ``k`` vectors all are found; an empty index finds nothing. Vectors must have one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.operators.vectors import nearest_rows
from bindery.sources.scratch import landed

PACK = 1024
SAMPLE = 1 << 16  # vectors that centres are fitted on
ROUNDS = 5
MOST_CENTRES = 1 << 22  # numbers in all centres
ODD = -1  # the cell of vectors that are not finite
_SLACK = 1e-6  # of the distances' rounding


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def fit_centres(vectors: DataFrame, n_cells: int, key: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``n_cells`` centres by Lloyd's rounds over the ``sample`` vectors whose keys have the smallest hashes.

    Each round, tasks add up the vectors nearest to each centre and Spark adds up their sums.
    """
    spark = vectors.sparkSession
    finite = vectors.where(F.forall(vec, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))).select(key, vec)
    some = landed(finite.orderBy(F.xxhash64(key), key).limit(sample).select(vec), "centre-sample")
    first = some.distinct().orderBy(F.xxhash64(vec)).limit(n_cells).toArrow().column(0).combine_chunks()
    if not len(first):
        return np.zeros((0, 0))
    centres = _matrix(first)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centres)

        def sums(batches, held=held):
            total, n = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
            for b in batches:
                x = _matrix(b.column(0))
                cell = _distances(x, held.value).argmin(axis=1)
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["cell", "n", "total"])

        parts = some.mapInArrow(sums, "cell bigint, n bigint, total array<double>")
        added = parts.select("cell", "n", F.posexplode("total").alias("at", "v")).groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        for r in added.collect():  # no more than the centres' numbers
            centres[r["cell"], r["at"]] = r["v"] / r["n"]
        held.unpersist()
    return centres


def _packed(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Neighbouring rows of one cell, as they lie in partitions sorted by cell, as one row of arrays."""
    kinds = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in columns)

    def run(batches):
        for b in batches:
            cell = b.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
            cuts = np.unique(np.concatenate([np.arange(a, e, size) for a, e in zip(starts, np.append(starts[1:], len(cell)))] + [[len(cell)]]).astype(np.int64))
            offsets = pa.array(cuts, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, b.column(k)) for k in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cuts[:-1])), *arrays], ["cell", *columns])

    return rows.select("cell", *columns).mapInArrow(run, f"cell int, {kinds}")


def build(vectors: DataFrame, path: str, n_cells: int | None = None, key: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE) -> None:
    """Store an index of (key, vec) rows under ``path``. By default there are about as many cells as a cell has vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")).where("vec is not null")
    if n_cells is None:
        n_cells = max(1, round(rows.count() ** 0.5))
    width = rows.select(F.size("vec")).first()
    n_cells = min(n_cells, MOST_CENTRES // max(1, width[0] if width else 1))
    centres = spark.sparkContext.broadcast(fit_centres(rows, n_cells, "key", "vec", sample))

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(1))
            cell, r = np.full(len(x), ODD, np.int32), np.zeros(len(x))
            fine = np.flatnonzero(np.isfinite(x).all(axis=1))
            if len(fine):
                d = _distances(x[fine], centres.value)
                cell[fine] = d.argmin(axis=1)
                r[fine] = np.sqrt(((x[fine] - centres.value[cell[fine]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r)], ["key", "vec", "cell", "r"])

    key_kind, vec_kind = (rows.schema[c].dataType.simpleString() for c in ("key", "vec"))
    dealt = rows.mapInArrow(assign, f"key {key_kind}, vec {vec_kind}, cell int, r double")
    dealt = dealt.repartitionByRange("cell", "r", F.xxhash64("key")).sortWithinPartitions("cell", "r")
    packs = _packed(dealt, ["key", "vec", "r"], PACK).withColumns({"r_min": F.array_min("r"), "r_max": F.array_max("r"), "n": F.size("key")})
    packs = packs.drop("r")
    packs.write.partitionBy("cell").parquet(f"{path}/packs")
    stored = spark.read.schema(packs.schema).parquet(f"{path}/packs")
    own = stored.groupBy("cell").agg(F.sum("n").alias("n"), F.max("r_max").alias("radius"), F.min(F.array_min("key")).alias("least_key"))
    at = centres.value.tolist()
    named = spark.createDataFrame([(k, c) for k, c in enumerate(at)], "cell int, centre array<double>")
    own.join(named, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")


def _asked(rows: DataFrame, cells, k: int, far: bool, probes: int | None) -> DataFrame:
    """(cell, query, vec, d, most) from (query, vec, most): the cells that each query asks, and its distance from their centres.

    The near ones are those with the nearest centres that together hold ``k`` vectors, or ``probes`` of them; the far ones
    are the others that can hold a vector nearer than ``most``. Odd cells are near.
    """

    def run(batches):
        number, n, radius, centres = cells.value
        odd = number == ODD
        for b in batches:
            q, most = _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            d = np.zeros((len(q), len(number)))
            fine = np.isfinite(q).all(axis=1)
            if len(centres) and fine.any():
                d[np.ix_(fine, ~odd)] = _distances(q[fine], centres)
            order = np.argsort(np.where(odd, -1, d), axis=1, kind="stable")
            held = np.cumsum(np.where(odd, 0, n)[order], axis=1) - n[order]
            near = np.zeros(d.shape, bool)
            rank = np.arange(len(number)) - odd.sum()
            np.put_along_axis(near, order, (rank < probes) if probes else (held < k) | odd[order], axis=1)
            near[~fine] = True
            asks = near
            if far:
                reach = np.where(np.isnan(most), np.inf, most)
                asks = ~near & (np.maximum(d - radius, 0) <= reach[:, None] * (1 + _SLACK) + _SLACK)
            which, at = np.nonzero(asks)
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(number[at]), b.column(0).take(take), b.column(1).take(take), pa.array(d[which, at]), b.column(2).take(take)], ["cell", "query", "vec", "d", "most"])

    query, vec = (rows.schema[c].dataType.simpleString() for c in ("query", "vec"))
    return rows.select("query", "vec", "most").mapInArrow(run, f"cell int, query {query}, vec {vec}, d double, most double")


def _found(packs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, d): of each pack of vectors that a pack of queries asks, what can be among a query's ``k`` nearest. Cells
    that nobody asks are not read."""
    packs = packs.where(F.col("cell").isin([r["cell"] for r in asked.select("cell").distinct().collect()]))
    kinds = asked.schema["query"].dataType, packs.schema["key"].dataType.elementType
    asked = asked.repartitionByRange("cell", F.xxhash64("query")).sortWithinPartitions("cell")
    asked = _packed(asked, ["query", "vec", "d", "most"], PACK).withColumnRenamed("vec", "q")
    met = packs.join(asked, "cell").select("key", "vec", "r_min", "r_max", "query", "q", "d", "most")

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                key, vec, query, q, d, most = (b.column(c).slice(row, 1).flatten() for c in (0, 1, 4, 5, 6, 7))
                low, high = b.column(2)[row].as_py(), b.column(3)[row].as_py()
                d, most = (x.to_numpy(zero_copy_only=False) for x in (d, most))
                reach = np.where(np.isnan(most), np.inf, most) * (1 + _SLACK) + _SLACK
                some = np.flatnonzero(np.maximum(d - high, low - d) <= reach)
                if len(some):
                    yield from nearest_rows(key, _matrix(vec), query.take(pa.array(some)), _matrix(q)[some], k, ["query", "key", "d"])

    return met.mapInArrow(run, f"query {kinds[0].simpleString()}, key {kinds[1].simpleString()}, d double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 50, key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", probes: int | None = None) -> DataFrame:
    """(query_key, key, d): the ``k`` nearest vectors of each query by squared distance.

    With ``probes`` only the cells of so many nearest centres are looked at: faster, and what lies elsewhere is missed.
    """
    stored = spark.read.parquet(f"{path}/cells")
    cells = stored.orderBy("cell").collect()  # a row a cell
    rows = queries.select(F.col(query_key).alias("query"), F.col(vec).alias("vec")).where("vec is not null").withColumn("most", F.lit(None).cast("double"))
    if not cells:
        kinds = rows.schema["query"].dataType.simpleString(), stored.schema["least_key"].dataType.simpleString()
        return spark.createDataFrame([], f"{query_key} {kinds[0]}, {key} {kinds[1]}, d double")
    number = np.array([c["cell"] for c in cells], np.int32)
    radius = np.array([np.inf if c["cell"] == ODD else c["radius"] for c in cells])
    centres = np.array([c["centre"] for c in cells if c["cell"] != ODD], np.float64)
    held = spark.sparkContext.broadcast((number, np.array([c["n"] for c in cells]), radius, centres))
    packs = spark.read.parquet(f"{path}/packs")
    best = Window.partitionBy("query").orderBy("d", "key")

    def ranked(found):
        return found.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k)

    out = ranked(_found(packs, _asked(rows, held, k, False, probes), k))
    if not probes:
        near = landed(out, "near-cells")
        kth = near.where(F.col("pos") == k).select(F.col("query").alias("of"), F.sqrt("d").alias("kth"))
        rows = rows.join(kth, F.col("query").eqNullSafe(F.col("of")), "left").select("query", "vec", F.col("kth").alias("most"))
        out = ranked(near.drop("pos").unionByName(_found(packs, _asked(rows, held, k, True, None), k)))
    return out.select(F.col("query").alias(query_key), F.col("key").alias(key), "d")
