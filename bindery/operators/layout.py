"""How tables lie so that later reads and joins do less: bloom filters on a key, buckets by a key, folders by category.

- ``land_for_lookup`` writes Parquet whose row groups carry a bloom filter of the key; ``look_up`` asks for a few keys, and row
  groups that hold none of them are skipped, however the keys are scattered over the files.
- ``bucketed`` stores a table in buckets sorted by a key. Two tables of as many buckets join on the key without a shuffle,
  which pays once a table is joined more than once; a key that holds a large share of all rows makes a large bucket.
- ``land_by_category`` writes a folder a category. A join on the category with a small filtered table reads the folders that the
  table names only, which Spark finds out while it runs.

Defined cases: null keys are looked up by nobody and join with nothing; a null category has a folder of its own and joins with
nothing; empty tables can be landed, looked up and joined.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IN_LIST = 10  # values of an IN that Parquet is asked for one by one
MOST_KEYS = 10_000


def land_for_lookup(df: DataFrame, path: str, key: str, distinct_keys: int = 1_000_000, row_group_bytes: int = 128 << 20) -> DataFrame:
    """``df`` written with a bloom filter of ``key`` for each row group, sized for ``distinct_keys`` in one."""
    writer = df.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys))
    writer.option("parquet.block.size", str(row_group_bytes)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def look_up(landed: DataFrame, key: str, keys: list) -> DataFrame:
    """The rows of the keys, at most ``MOST_KEYS``: the filters go to the scan in lists that Parquet holds against its bloom filters."""
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: join instead")
    if not wanted:
        return landed.limit(0)
    return landed.where(reduce(or_, [F.col(key).isin(wanted[a : a + IN_LIST]) for a in range(0, len(wanted), IN_LIST)]))


def bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` stored under ``path`` in buckets by ``key``, each one file sorted by it. Buckets are known to tables of the session's
    catalogue only, so the table has a name of its own there."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def land_by_category(df: DataFrame, path: str, category: str) -> DataFrame:
    """``df`` with a folder for each category. Rows are rebalanced by category, so that a large one becomes several files."""
    df.hint("rebalance", category).write.partitionBy(category).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def of_categories(landed: DataFrame, asked: DataFrame, category: str) -> DataFrame:
    """The landed rows whose category is among those of ``asked``."""
    return landed.join(asked.select(category).distinct(), category)

