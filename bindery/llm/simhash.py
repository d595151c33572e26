"""SimHash near-duplicate groups: BK-trees over shards of fingerprints, then connected components.

Texts have A-Z lower-cased and are cut into words ``[^\\x20\\x09-\\x0D]+``. Every 3-word shingle (repeats count) is
hashed with XXH64 (seed 42); a fingerprint bit is set if it is set in over half of the hashes. Fingerprints that
differ in at most ``radius`` bits are linked, and documents are grouped by chains of links.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bands, so each band value is a shard
and every link lies inside some shard. A shard of over ``split_above`` fingerprints is cut again by bands of its other
bits, which keeps the same promise: once by Spark, so that it is dealt to many tasks, and as often as needed in the task
that gets a piece of it. Each task builds a BK-tree per shard (children keyed by integer Hamming distance
to the parent) and follows only edges within the radius, minus subtrees already in the query's component. It keeps a
star of links per component, never all pairs. Trees are built and searched where their shard was shuffled to: the trees
of all shards hold all fingerprints, and to broadcast them would send those through the driver.

Defined cases: null, empty and blank texts have fingerprint 0 and link like others; texts of fewer words than a
shingle hash as one sequence; repeated rows and equal doc_id values stay separate rows with one fingerprint each; a
null doc_id never names a component unless all of its members are null; a very long text is read whole; an empty table
gives an empty table; columns other than ``doc_id`` and ``text`` are not read, and ``keep_one_per_group`` passes all
columns on as they are.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import discard, each_text, stage, whole_row

SHINGLE = 3
RADIUS = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(octets), 16384):  # bounded memory for very long texts
        votes += np.unpackbits(octets[k : k + 16384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; ``fp`` is the fingerprint's bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in each_text(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class BKTree:
    """BK-tree of distinct integers under Hamming distance that joins near ones into components as they come."""

    def __init__(self, radius: int):
        self.radius = radius
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []
        self.up: list[int] = []  # union-find parents
        self.visits = 0
        self.whole: list[int] = []  # a member of the only component below this node; -1 if there are more

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, key: int) -> None:
        keys, children, up, radius, me = self.keys, self.children, self.up, self.radius, len(self.keys)
        up.append(me)
        todo = [0] if me else []
        while todo:  # join what is near; skip subtrees that are in this component already
            i = todo.pop()
            self.visits += 1
            if self.whole[i] >= 0 and self.find(self.whole[i]) == self.find(me):
                continue
            d = (keys[i] ^ key).bit_count()
            if d <= radius:
                up[self.find(me)] = self.find(i)
            kids = children[i]
            if kids:
                todo += [kids[e] for e in range(max(1, d - radius), d + radius + 1) if e in kids]
        at, root = 0, self.find(me)
        while me:  # insert
            if self.whole[at] >= 0 and self.find(self.whole[at]) != root:
                self.whole[at] = -1
            d = (keys[at] ^ key).bit_count()
            if d not in children[at]:
                children[at][d] = me
                break
            at = children[at][d]
        keys.append(key)
        children.append({})
        self.whole.append(me)

    def links(self) -> list[tuple[int, int]]:
        """One link from each key to its component's root."""
        return [(self.keys[i], self.keys[r]) for i in range(len(self.keys)) if (r := self.find(i)) != i]


def shard_links(keys: np.ndarray, radius: int = RADIUS, split_above: int = 2048) -> list[tuple[int, int]]:
    """Links that join the components of ``keys`` (distinct, unsigned). A tree serves a ball of near keys however large it
    is; where searches have visited over ``split_above`` nodes a key, the keys are cut by bands of the bits they differ in."""
    tree = BKTree(radius)
    for k in keys.tolist():
        tree.add(k)
        if tree.visits > split_above * (len(tree.keys) + split_above):
            break
    else:
        return tree.links()
    differ = int(np.bitwise_or.reduce(keys ^ keys[0]))
    free = np.array([b for b in range(64) if differ >> b & 1], np.uint64)
    if len(free) <= radius:  # all are near one another
        return [(int(k), int(keys[0])) for k in keys[1:]]
    out = []
    for band in np.array_split(free, radius + 1):
        own = keys & np.bitwise_or.reduce(np.uint64(1) << band)
        order = np.argsort(own, kind="stable")
        for part in np.split(keys[order], np.flatnonzero(np.diff(own[order])) + 1):
            if len(part) > 1:
                out += shard_links(part, radius, split_above)
    return out


def _band(fp: str, bands: list[tuple[int, int]]):
    """Array of (index, bits) for bands given as (shift, width)."""
    part = "struct(cast({i} as int) AS i, shiftrightunsigned({fp}, {s}) & {m}L AS v)"
    return F.expr("array(" + ", ".join(part.format(i=i, fp=fp, s=s, m=(1 << w) - 1) for i, (s, w) in enumerate(bands)) + ")")


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def near_links(distinct: DataFrame, radius: int = RADIUS, split_above: int = 2048) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that connect exactly the components at ``radius``."""
    bands = _cuts(64, radius + 1)
    first = distinct.select("fp", F.explode(_band("fp", bands)).alias("b")).select("fp", "b.i", "b.v")
    crowded = first.groupBy("i", "v").count().where(F.col("count") > split_above).select("i", "v", F.lit(True).alias("crowded"))
    marked = first.join(crowded, ["i", "v"], "left")
    rest = [(i, [(s, w) for k, b in enumerate(bands) if k != i for s, w in [b]]) for i in range(radius + 1)]
    # The other bands of a crowded shard, cut so that one of radius + 1 pieces must agree again.
    again = F.expr("CASE i " + " ".join(f"WHEN {i} THEN {_pieces(r, radius + 1)}" for i, r in rest) + " END")
    plain = F.expr("array(struct(cast(-1 as int) AS i, 0L AS v))")
    sharded = marked.select("fp", "i", "v", F.explode(F.when(F.col("crowded"), again).otherwise(plain)).alias("c"))
    sharded = sharded.select("i", "v", F.col("c.i").alias("j"), F.col("c.v").alias("w"), "fp")
    key = ["i", "v", "j", "w"]

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            if held:
                cols = [np.concatenate(p) for p in zip(held, cols)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            if not len(new):
                held = cols
                continue
            yield _linked(np.split(cols[4][: new[-1]], new[:-1]))
            held = [c[new[-1] :] for c in cols]
        if held:
            yield _linked([held[4]])

    def _linked(groups):
        out = []
        for g in groups:
            if len(g) > 1:
                out += shard_links(g.view(np.uint64), radius, split_above)
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    dealt = sharded.repartition(*key).sortWithinPartitions(*key, "fp")
    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def _pieces(bands: list[tuple[int, int]], parts: int) -> str:
    """SQL array of (j, bits) cutting the concatenation of ``bands`` into ``parts``."""
    bits = [s + k for s, w in bands for k in range(w)]
    out = []
    for j, (a, n) in enumerate(_cuts(len(bits), parts)):
        runs, terms = [], []
        for pos in bits[a : a + n]:
            if runs and pos == runs[-1][0] + runs[-1][1]:
                runs[-1][1] += 1
            else:
                runs.append([pos, 1])
        shift = 0
        for s, w in runs:
            terms.append(f"shiftleft(shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L, {shift})")
            shift += w
        out.append(f"struct(cast({j} as int) AS i, {' | '.join(terms)} AS v)")
    return "array(" + ", ".join(out) + ")"


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node: connected components by alternating large and small stars.

    Each round is a few shuffles over the links and is written to the shared folder; nothing reaches the driver but
    two numbers that tell whether anything changed.
    """
    small, big = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    edges = stage(links.where("u <> v").select(big, small).select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "links")

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = digest(edges)
    for _ in range(max_rounds if before[0] else 0):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before_edges, edges = edges, stage(small_star.where("u <> v").distinct(), "links")
        discard(before_edges)
        after = digest(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    if before[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, split_above: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id): ``component_id`` is the smallest doc_id reachable over links, its own included."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct.select("fp"), radius, split_above))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, radius: int = RADIUS, split_above: int = 2048) -> DataFrame:
    """The document of each group with the smallest (doc_id, hash of the text), null doc_id first; exact repeats of that
    row count as one. All columns of ``docs`` stay as they are."""
    ident = F.struct("doc_id", F.xxhash64("text").alias("h"))
    groups = near_duplicate_groups(docs.select(ident.alias("doc_id"), "text"), radius, SHINGLE, split_above)
    heads = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("ident")).distinct()
    # Of the heads' very type, so that one shuffle serves both the join and the dropping of repeats.
    rows = docs.select(ident.cast(heads.schema["ident"].dataType).alias("ident"), whole_row(docs).alias("row"))
    return rows.join(heads, "ident", "left_semi").dropDuplicates(["ident"]).select("row.*")
