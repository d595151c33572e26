"""Keeping a text index up to date without embedding what has not changed.

An index of texts is a folder of parts, one for each version. A part holds entries (key, h1, h2, embedding, gone): the text of
``key`` with that content hash was embedded in this version, or was no longer there. The state of the index is the newest
entry of each (key, hash). ``update`` compares a table's hashes with that state by two anti-joins, embeds what is new
only, and writes one more part; nothing that is stored is changed, so that readers of an older version go on, and an
update that fails leaves no version behind: a part counts once its writer has committed it. When ``FANOUT`` parts have
come together since the last whole one, the state is written as a whole part, from which later readers start.

Defined cases: a null text is embedded as the empty one is, but is another content; a null key is a key like others; rows of
one key and equal texts are one entry, and of different texts an entry each; an unchanged table makes no new part; an
empty table removes all entries. Contents are compared by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions.scorers import hash_embedder
from bindery.sources.scratch import discard, landed

FANOUT = 8
ENTRY = ["key", "h1", "h2"]


def _parts(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(version, whole) of the committed parts, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for f in files.listStatus(at) if files.exists(at) else []:
        kind, _, number = f.getPath().getName().partition("-")
        if kind in ("part", "whole") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found.append((int(number), kind == "whole"))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted({v for v, _ in _parts(spark, path)})


def _state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest entry of each (key, hash) that is not gone, up to a version."""
    parts = [p for p in _parts(spark, path) if version is None or p[0] <= version]
    if not parts:
        return None
    start = max((v for v, whole in parts if whole), default=None)
    read = [(v, whole) for v, whole in parts if start is None or v > start or (v == start and whole)]
    out = None
    for v, whole in read:
        part = spark.read.parquet(f"{path}/{'whole' if whole else 'part'}-{v}").withColumn("version", F.lit(v))
        out = part if out is None else out.unionByName(part)
    if len(read) > 1:
        newest = F.row_number().over(Window.partitionBy(*ENTRY).orderBy(F.desc("version")))
        out = out.withColumn("age", newest).where("age = 1").drop("age")
    return out.where("not gone").drop("gone", "version")


def read(spark: SparkSession, path: str, key: str, version: int | None = None) -> DataFrame:
    """(key, embedding) of the index as it stands, or stood at a version."""
    state = _state(spark, path, version)
    if state is None:
        raise ValueError(f"there is no version of an index at {path}")
    return state.select(F.col("key").alias(key), "embedding")


def _same(a: str, b: str):
    return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.h1") == F.col(f"{b}.h1")) & (F.col(f"{a}.h2") == F.col(f"{b}.h2"))


def _embedded(rows: DataFrame, embedder: Callable | None) -> DataFrame:
    """(key, h1, h2, embedding) from (key, h1, h2, text)."""
    make = embedder or hash_embedder()
    names = [*ENTRY, "embedding"]

    def run(batches):
        model = make()
        for b in batches:
            vectors = [list(map(float, v)) for v in model(pd.Series(b.column(3).to_pylist(), dtype=object).fillna(""))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(vectors, pa.list_(pa.float32()))], names)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ENTRY)
    return rows.select(*ENTRY, "text").mapInArrow(run, f"{kinds}, embedding array<float>")


def update(df: DataFrame, path: str, key: str, text: str, embedder: Callable | None = None) -> dict[str, int]:
    """Bring the index at ``path`` to the texts of ``df``; (version, added, gone) of what was done."""
    spark = df.sparkSession
    content = F.struct(F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(content).alias("h1"), F.xxhash64(F.lit(7), content).alias("h2"))
    rows = rows.groupBy(*ENTRY).agg(F.first("text").alias("text"))
    state, parts = _state(spark, path), _parts(spark, path)
    number = parts[-1][0] + 1 if parts else 1
    new, old = rows, None
    if state is not None:
        held = state.select(*ENTRY)
        new = rows.alias("n").join(held.alias("s"), _same("n", "s"), "left_anti")
        old = landed(held.alias("s").join(rows.alias("n"), _same("n", "s"), "left_anti"), "gone")
    new = landed(new, "changed")
    added, gone = new.count(), old.count() if old is not None else 0
    if parts and not added and not gone:
        discard(new, old)
        return {"version": parts[-1][0], "added": 0, "gone": 0}
    part = _embedded(new, embedder).withColumn("gone", F.lit(False))
    if gone:
        part = part.unionByName(old.withColumns({"embedding": F.lit(None).cast(part.schema["embedding"].dataType), "gone": F.lit(True)}))
    part.write.parquet(f"{path}/part-{number}")
    whole = max((v for v, w in parts if w), default=0)
    if number - whole >= FANOUT:
        _state(spark, path).withColumn("gone", F.lit(False)).write.parquet(f"{path}/whole-{number}")
    discard(*[x for x in (new, old) if x is not None])
    return {"version": number, "added": added, "gone": gone}
