"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased; keys are held as two
independent 64-bit hashes. ``LineRuns`` keeps runs of (key, number of documents), each sorted by key. A new batch is
reduced to its own sorted keys, merge-anti-joined with the keys that the runs already show to be settled, and added as a
run of level 0. When a level holds ``fanout`` runs, they are compacted into one run of the next level, so that a key is
rewritten a logarithmic number of times and few runs are read at once.

Two uses: ``drop_frequent_lines`` removes lines whose key is found in at least ``min_docs`` documents from every
document, feeding the documents to the runs in ``n_batches`` batches by the hash of their doc_id, as they would arrive;
``LineRuns.new_lines`` gives the lines of a batch that no earlier batch had.

Runs are Parquet files whose row groups hold ranges of keys. Spark does not rely on the order of files it reads, so a
merge join sorts what it reads once more; the runs' order makes that sort cheap and their files small.

A document's frequent lines travel as the positions of its lines under (doc_id, two hashes of the text), which rows with
one doc_id share only if their texts are equal too; such rows have the same lines to drop. Positions are taken out by
one set difference, in time linear in the document's lines.

Defined cases: a null or empty text is one empty line and stays (null text: hash of the empty text); keys of no code
point are never dropped; each row is a document, so repeated rows count again; a null doc_id is a document like others;
an empty table gives an empty table; columns other than ``doc_id`` and ``text`` are not read. A document of very many
frequent lines holds their positions in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import BLANKS, ascii_lower, discard, stage
from bindery.sources.scratch import new_path

KEY = ["h1", "h2"]
N_BATCHES = 5


def line_keys(text: Column) -> Column:
    """Array of key structs (h1, h2), one for each line; both null where the key is empty."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))

    def key(line):
        bare = F.btrim(line, F.lit(BLANKS))
        full = F.when(bare != "", bare)
        return F.when(full.isNotNull(), F.struct(F.xxhash64(full).alias("h1"), F.xxhash64(F.lit(7), full).alias("h2")))

    return F.transform(F.split(lowered, "\n"), key)


def _keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2): each key of each row once."""
    keys = F.explode(F.array_distinct(line_keys(F.col("text")))).alias("k")
    return docs.select("doc_id", keys).where("k is not null").select("doc_id", "k.h1", "k.h2")


class LineRuns:
    """Levelled runs of (h1, h2, docs), each sorted by key and stored in the shared folder."""

    def __init__(self, settled_at: int, fanout: int = 3):
        self.settled_at, self.fanout = settled_at, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _store(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stage(df.sortWithinPartitions(*KEY), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:  # compaction
            merged, self.levels[level] = self.levels[level], []
            self._store(_summed(merged), level + 1)
            discard(*merged)

    def add(self, batch: DataFrame) -> None:
        """Count the batch's keys, leave out those that some run has settled, and keep the rest as a run."""
        self.add_counts(_keys_of(batch).groupBy(*KEY).agg(F.count("*").alias("docs")))

    def add_counts(self, own: DataFrame) -> None:
        """As ``add``, for a batch that comes as its keys (h1, h2, docs)."""
        if self.runs():
            settled = _union([r.where(F.col("docs") >= self.settled_at).select(*KEY) for r in self.runs()])
            own = own.join(settled.hint("merge"), KEY, "left_anti")
        self._store(own, 0)

    def new_lines(self, batch: DataFrame) -> DataFrame:
        """(doc_id, h1, h2) of the batch whose key no run holds yet; to be used before the next ``add``, which may compact
        the runs that this reads."""
        lines = _keys_of(batch)
        if not self.runs():
            return lines
        return lines.join(_union([r.select(*KEY) for r in self.runs()]).distinct().hint("merge"), KEY, "left_anti")

    def frequent(self) -> DataFrame:
        """Keys found in at least ``settled_at`` documents. A settled key is in some run with that many."""
        return _summed(self.runs()).where(F.col("docs") >= self.settled_at).select(*KEY)


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _summed(runs: list[DataFrame]) -> DataFrame:
    return _union(runs).groupBy(*KEY).agg(F.sum("docs").alias("docs"))


def batch_counts(docs: DataFrame, n: int = N_BATCHES) -> list[DataFrame]:
    """(h1, h2, docs): the keys of the documents in ``n`` batches by the hash of their doc_id. One pass over the texts counts and lands the
    keys of all batches, a folder for each."""
    spark, batch = docs.sparkSession, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("batch")
    keys = docs.select(batch, F.explode(F.array_distinct(line_keys(F.col("text")))).alias("k")).where("k is not null")
    counts = keys.groupBy("batch", "k.h1", "k.h2").agg(F.count("*").alias("docs"))
    counts.write.partitionBy("batch").parquet(path := new_path(spark, "line-keys"))
    stored = spark.read.schema("h1 bigint, h2 bigint, docs bigint, batch int").parquet(path)
    return [stored.where(F.col("batch") == k).drop("batch") for k in range(n)]


def _ident() -> list[Column]:
    return [F.col("doc_id").alias("of"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(11), "text").alias("t2")]


def drop_frequent_lines(docs: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = 10, fanout: int = 3, n_batches: int = N_BATCHES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts without the lines whose key at least ``min_docs`` documents hold.

    ``batches`` are the parts of ``docs`` in the order they arrive; without them there are ``n_batches`` by doc_id, whose keys are
    made in one pass.
    """
    docs = docs.select("doc_id", "text")
    runs = LineRuns(min_docs, fanout)
    if batches:
        for batch in batches:
            runs.add(batch.select("doc_id", "text"))
    else:
        for counts in batch_counts(docs, n_batches):
            runs.add_counts(counts)
    frequent = stage(runs.frequent(), "frequent-lines")
    lines = docs.select(*_ident(), F.posexplode(line_keys(F.col("text"))).alias("at", "k")).where("k is not null")
    hits = lines.select("of", "t1", "t2", "at", "k.*").join(frequent.hint("merge"), KEY, "left_semi")
    hits = hits.groupBy("of", "t1", "t2").agg(F.collect_set("at").alias("hits"))  # once for repeated rows
    known = docs.select("doc_id", "text", *_ident()[1:]).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.of")) & (F.col("d.t1") == F.col("h.t1")) & (F.col("d.t2") == F.col("h.t2"))
    rows = known.join(hits.alias("h"), same, "left").select("d.doc_id", F.coalesce("d.text", F.lit("")).alias("text"), "h.hits")

    def without_hits(lines):  # a lambda's variable, so that the text is split once and not for each line
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("hits"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    lines, some = F.split("text", "\n"), F.col("hits").isNotNull()
    return rows.select(
        "doc_id",
        F.when(some, F.get(F.transform(F.array(lines), without_hits), F.lit(0))).otherwise(F.col("text")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(some, F.size("hits")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
