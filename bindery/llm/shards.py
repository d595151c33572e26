"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records (doc_id, size and CRC of the text) are hashed into ``n_slots`` fixed virtual slots. Equal records are counted
first; a group of more bytes than an average slot is cut into pieces of about that size, whose numbers are hashed too,
so no key and no group of copies makes a slot that the map cannot balance. Bytes and rows are summed for each slot.

The map from slot to shard is a table of (version, slot, shard, first) at a path of the caller's, a folder for each version,
which later runs load and edit; without a path it lives in the shared folder as long as the driver. Version 1 deals equal ranges
of slots, before any size is known. ``rebalance`` edits the latest version into the next one by moving few slots until
the shards' bytes are near equal, after the slots' bytes are summed or to follow new sizes or another number of shards;
rows are dealt by the latest version, and older ones stay as they are. ``first_map`` makes a map from known sizes
instead. The law that holds is ``bytes``.

Groups of equal texts are not kept together: their rows hash apart by doc_id, because a group may hold a third of all
bytes and no law but the even one could then hold. Equal texts have equal ``size`` and ``text_crc32``, by which they can be found.

The driver handles only the map, whose size is ``n_slots`` whatever the input. A row's place in its shard is the start
of its slot in the shard plus its rank in the slot, so no window spans a shard.

Defined cases: a null text has 0 bytes (size 1) and the CRC of the empty text; a null doc_id is hashed as any other;
rows of one doc_id and different texts spread over slots, repeated rows share one up to an average slot's size; repeated
rows stay and get places of their own; a single text larger than a slot fills it; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, and passed columns are never looked up by other names.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import stage
from bindery.sources.scratch import new_path

N_SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, first long"


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, copies): equal records once, in the shared folder."""
    size, crc = size_of(F.col("text")), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    return stage(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "records")


def pieces(counted: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, piece, n, virtual_slot): ``records`` cut into pieces of ``n`` equal rows, of no more
    bytes than an average slot or of one row."""
    total = counted.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    most = F.greatest(F.lit(1), F.floor(F.lit(-(-total // n_slots)) / F.col("size"))).cast("long")
    cut = counted.withColumn("most", most).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("most")))))
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "piece"), F.lit(n_slots)).cast("int")
    n = F.least("most", F.col("copies") - F.col("piece") * F.col("most"))
    return cut.select("doc_id", "size", "text_crc32", "piece", n.alias("n"), slot.alias("virtual_slot"))


def slot_sizes(cut: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use, by slot: at most a row for each slot."""
    slots = cut.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")), F.sum("n"))
    return [tuple(r) for r in slots.orderBy("virtual_slot").collect()]


def first_map(sizes: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Slot to shard: slots by falling bytes, each to the shard with the fewest bytes so far."""
    load = [(0, s) for s in range(n_shards)]
    out = {}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        least, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (least + size, shard))
    return out


def even_map(n_slots: int, n_shards: int) -> dict[int, int]:
    """Slot to shard in equal ranges, for slots whose sizes are not known."""
    return {s: s * n_shards // n_slots for s in range(n_slots)}


def best_exchange(high: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> tuple[int, int | None] | None:
    """The slot to move from the fullest shard, and the one to take back if any, that leave the smallest gap; (size,
    slot) lists are sorted. None where nothing narrows it."""
    best = (gap, None)
    for size, slot in high:
        wanted = size - gap / 2  # to take back
        at = bisect.bisect_left(low, (wanted, -1))
        for back, other in [(0, None), *low[max(0, at - 1) : at + 1]]:
            left = abs(gap - 2 * (size - back))
            if left < best[0]:
                best = (left, (slot, other))
    return best[1]


def rebalance(old: dict[int, int], sizes: list[tuple[int, int, int]], n_shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The next version of a map: a slot moves from the shard with the most bytes to that with the fewest, or changes
    places with one of it, whichever leaves the smallest gap, until all are within ``tolerance`` of the mean or nothing
    helps. Slots of shards beyond ``n_shards`` and new slots are dealt out first."""
    size = {s: b for s, b, _ in sizes}
    out = {s: k for s, k in old.items() if k < n_shards and s in size}
    load, held = [0] * n_shards, [[] for _ in range(n_shards)]

    def put(s: int, k: int) -> None:
        out[s] = k
        load[k] += size[s]
        bisect.insort(held[k], (size[s], s))

    def take(s: int) -> None:
        load[out[s]] -= size[s]
        held[out[s]].remove((size[s], s))

    for s, k in list(out.items()):
        put(s, k)
    for s in sorted(size.keys() - out.keys(), key=lambda s: (-size[s], s)):
        put(s, min(range(n_shards), key=lambda k: (load[k], k)))
    mean = sum(load) / n_shards
    for _ in range(4 * len(size)):
        high, low = max(range(n_shards), key=lambda k: (load[k], -k)), min(range(n_shards), key=lambda k: (load[k], k))
        if max(load[high] - mean, mean - load[low]) <= tolerance * mean:
            break
        found = best_exchange(held[high], held[low], load[high] - load[low])
        if not found:
            break
        for s, to in zip(found, (low, high)):
            if s is not None:
                take(s)
                put(s, to)
    return out


def map_rows(slots: dict[int, int], sizes: list[tuple[int, int, int]], version: int) -> list[tuple[int, int, int, int]]:
    """(version, slot, shard, first) of the slots in use: ``first`` is the slot's first place in its shard."""
    rows, placed = [], {}
    for slot, _, n in sorted(sizes):
        shard = slots[slot]
        rows.append((version, slot, shard, placed.get(shard, 0)))
        placed[shard] = placed.get(shard, 0) + n
    return rows


def store_map(spark, versions: list[list[tuple[int, int, int, int]]], path: str | None = None) -> DataFrame:
    """Append versions, rows as ``map_rows`` makes them, to the map at ``path``, and give all that it holds: a row for each slot
    and version. A version is one folder, which is there as a whole or not at all."""
    path = path or new_path(spark, "slot-map")
    for rows in versions:
        if rows:
            spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.parquet(f"{path}/version={rows[0][0]}")
    return read_map(spark, path)


def read_map(spark, path: str) -> DataFrame:
    """All versions of the map at ``path``; no rows where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MAP_SCHEMA)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def latest(slot_map: DataFrame) -> DataFrame:
    newest = slot_map.agg(F.max("version")).first()[0]
    return slot_map.where(F.col("version") == (newest or 0))


def assign(cut: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, shard, place, virtual_slot) of the rows of ``pieces`` under a stored map, which is
    broadcast: a row for each slot at most."""
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "piece").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = ranked.join(F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard", "first")), "virtual_slot")
    rows = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") + F.col("copy")).alias("place"), "virtual_slot")


def next_versions(slot_map: DataFrame, sizes: list[tuple[int, int, int]], n_shards: int, n_slots: int, tolerance: float) -> list[list[tuple[int, int, int, int]]]:
    """The versions to add: one that edits the latest by the slots' bytes, after version 1 where there is none yet."""
    held = latest(slot_map).collect()  # a row for each slot
    if held:
        old, number, out = {r["slot"]: r["shard"] for r in held}, held[0]["version"], []
    else:
        old, number = even_map(n_slots, n_shards), 1
        out = [map_rows(old, sizes, 1)]
    return [*out, map_rows(rebalance(old, sizes, n_shards, tolerance), sizes, number + 1)]


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, tolerance: float = 0.0005, map_path: str | None = None) -> DataFrame:
    """Shards 0 to ``n_shards`` - 1 under the next version of the map at ``map_path``, or under version 2 of a new map; see ``assign``
    for the columns."""
    spark = docs.sparkSession
    cut = pieces(records(docs), n_slots)
    sizes = slot_sizes(cut)
    stored = read_map(spark, map_path) if map_path else spark.createDataFrame([], MAP_SCHEMA)
    slot_map = store_map(spark, next_versions(stored, sizes, n_shards, n_slots, tolerance), map_path)
    return assign(cut, latest(slot_map))
