"""Ranked lexical search with exact scores, by MaxScore with bounds for pairs of terms.

``build_index`` turns documents into shards of about 8 MB of text: a row holds a shard's documents and, for each of its
terms, the documents that hold the term and how often. Shards are made where the documents are read; nothing is shuffled.

``search`` ranks the documents for a table of queries, in blocks of bounded size that are sent out:

1. The corpus' figures and the documents of each asked term are added up over the index.
2. A query's terms are paired in the order of their weights. For each shard the lists of the asked terms with their
   impacts, the lists of documents that hold both terms of a pair, and the highest impact of each list, joint for a
   pair, are made once and landed.
3. A query's bound on a shard is the sum over its pairs of the highest of three: both terms, the one alone, the other
   alone. With the pairs in rising order, a document whose last pair in that order is p can score no more than the bounds
   before p and what p gives it. So of each pair only those of its lists (both, one, other) are looked through that can
   still reach the query's threshold, a shard whose whole bound stays below it is skipped, and a candidate is dropped as
   soon as what it has and the bounds that are left stay below.

Thresholds come from rounds: some thirty shards are searched first, then thirty times as many, and so on, each round with
the k-th best scores of those before and of the task so far. They only ever leave out documents that cannot be among the
k best, so results are those of scoring every document. Impacts and scores are 64-bit integers.

Terms are known by 64-bit hashes; two different terms of a corpus and its queries share one with a chance of about the
number of asked terms times that of all terms over 2^64.

Defined cases: null and empty texts, and texts without a term, are in no count and are not found; a query without terms, or
whose terms no document holds, finds nothing; each row is a document or a query of its own, also where ids repeat; equal
scores are ranked by doc_id, null first; very long texts are read whole and make shards of their own; empty tables give an
empty table; columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bindery.llm.common import each_text, stage
from bindery.llm.wordhash import text_hashes, word_hashes
from bindery.sources.scratch import new_path

SHARD_BYTES = 1 << 23
SHARD_DOCS = 1 << 16  # so that a document's number takes two bytes
BLOCK_BYTES = 1 << 22  # of queries that are sent out at once
FIRST_SHARDS, GROWTH = 32, 32  # of the rounds

#: Octets that are no part of a term become spaces, A-Z lower case; parts of longer characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BETWEEN = word_hashes([b"!"])[0]  # no term: stands between documents

_INDEX = "lengths binary, terms binary, starts binary, docs binary, tfs binary, n_docs bigint, n_terms bigint, deal bigint"


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' terms in order, and which text each is of."""
    hashes = text_hashes(b" ! ".join((t or "").encode().translate(_PLAIN) for t in texts))
    between = hashes == _BETWEEN
    return hashes[~between], np.cumsum(between)[~between]


def _shard(texts: list[str | None]) -> list:
    terms, doc = terms_of(texts)
    lengths = np.bincount(doc, minlength=len(texts))
    order = np.argsort(terms, kind="stable")
    terms, doc = terms[order], doc[order]
    first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1]))[: len(terms)])
    tfs = np.diff(np.append(first, len(terms)))
    terms, docs = terms[first], doc[first]
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
    deal = int(np.bitwise_xor.reduce(terms, initial=np.uint64(len(texts))) >> np.uint64(33))
    arrays = lengths.astype(np.int64), terms[starts], np.append(starts, len(terms)).astype(np.int64), docs.astype(np.uint16), tfs.astype(np.uint32)
    return [a.tobytes() for a in arrays] + [int((lengths > 0).sum()), int(lengths.sum()), deal]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of ``docs``; see the module. ``deal`` deals shards to rounds."""
    kind = docs.schema[key].dataType
    names = ["ids", *[c.split()[0] for c in _INDEX.split(", ")]]
    kinds = [pa.list_(to_arrow_type(kind)), *[pa.binary()] * 5, *[pa.int64()] * 3]

    def run(batches):
        ids, texts, size = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([ids, *_shard(texts)], kinds)], names)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), each_text(b.column(1))):
                ids.append(k)
                texts.append(t)
                size += len(t or "")
                if size >= shard_bytes or len(ids) == SHARD_DOCS:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return docs.select(key, text).mapInArrow(run, f"ids array<{kind.simpleString()}>, {_INDEX}")


@dataclass
class Block:
    """Some queries: ids, and the terms of each with how often it asks for them, as numbers in ``vocabulary``."""

    ids: list
    vocabulary: np.ndarray
    asked: list[dict[int, int]]
    weights: list[int] | None = None
    units: list[list[tuple[int, int, int, int, int]]] | None = None  # (term, weight, other term or -1, its weight, pair)
    pairs: list[tuple[int, int, int, int]] | None = None

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        """Weights from the corpus' figures, and each query's terms paired from the heaviest down."""
        self.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) if df.get(k) else 0 for k in range(len(self.vocabulary))]
        numbers: dict[tuple[int, int, int, int], int] = {}
        self.units = []
        for asked in self.asked:
            heavy = sorted(((n * self.weights[k], k) for k, n in asked.items() if self.weights[k]), reverse=True)
            units = []
            for (a, s), (b, t) in zip(heavy[::2], heavy[1::2]):
                units.append((s, a, t, b, numbers.setdefault((s, a, t, b), len(numbers))))
            if len(heavy) % 2:
                units.append((heavy[-1][1], heavy[-1][0], -1, 0, -1))
            self.units.append(units)
        self.pairs = list(numbers)


def _blocks(queries: DataFrame, key: str, text: str, block_bytes: int):
    """The queries in blocks of about ``block_bytes`` of text, by hash."""
    rows = queries.select(F.col(key).alias("id"), F.col(text).alias("text"))
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for k in range(n):
        found = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        terms, of = terms_of([r["text"] for r in found])
        vocabulary, at = np.unique(terms, return_inverse=True)
        asked = [Counter() for _ in found]
        for i, j in zip(of.tolist(), at.tolist()):
            asked[i][j] += 1
        yield Block([r["id"] for r in found], vocabulary, asked)


def _places(all_terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms there are, and where."""
    if not len(all_terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(all_terms, wanted), len(all_terms) - 1)
    some = np.flatnonzero(all_terms[at] == wanted)
    return some, at[some]


def _numbers(batch: pa.RecordBatch, row: int, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(batch.schema.get_field_index(c))[row].as_py(), kind) for c, kind in kinds.items()]


def document_counts(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the terms, at most a number for each."""
    wanted = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                terms, starts = _numbers(b, k, terms=np.uint64, starts=np.int64)
                some, at = _places(terms, wanted.value)
                total[some] += starts[at + 1] - starts[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    found = index.select("terms", "starts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}


_LISTS = "terms binary, starts binary, docs binary, impacts binary, highest binary, pairs binary, pair_starts binary, pair_docs binary, joint binary"


def impact_lists(index: DataFrame, block, n_docs: int, n_terms: int) -> DataFrame:
    """(ids, deal, lists): for each shard the asked terms' lists with impacts, the pairs' lists, and the highest of each."""
    names = ["ids", "deal", *[c.split()[0] for c in _LISTS.split(", ")]]

    def of_shard(lengths, terms, starts, docs, tfs) -> list[np.ndarray]:
        some, at = _places(terms, block.value.vocabulary)
        m = 75 + 25 * lengths * n_docs // max(n_terms, 1)
        lists, impacts = {}, []
        for k, a, b in zip(some.tolist(), starts[at].tolist(), starts[at + 1].tolist()):
            if block.value.weights[k]:
                tf = tfs[a:b].astype(np.int64)
                lists[k] = docs[a:b], (1_000_000_000 * tf // (1000 * tf + 12 * m[docs[a:b]])).astype(np.int32)
        both, joint = [], []
        for number, (s, a, t, b) in enumerate(block.value.pairs):
            if s in lists and t in lists:
                (few, own), (many, theirs) = sorted((lists[s], lists[t]), key=lambda x: len(x[0]))
                where = np.minimum(np.searchsorted(many, few), len(many) - 1)
                hit = many[where] == few
                if hit.any():
                    a, b = (a, b) if few is lists[s][0] else (b, a)
                    both.append((number, few[hit]))
                    joint.append((a * own[hit].astype(np.int64) + b * theirs[where[hit]].astype(np.int64)).max())
        impacts = [x for _, x in lists.values()]
        return [
            np.array(list(lists), np.int32), np.cumsum([0, *map(len, impacts)]), np.concatenate([np.zeros(0, np.uint16), *[d for d, _ in lists.values()]]),
            np.concatenate([np.zeros(0, np.int32), *impacts]), np.array([x.max() for x in impacts], np.int32),
            np.array([k for k, _ in both], np.int32), np.cumsum([0, *[len(d) for _, d in both]]), np.concatenate([np.zeros(0, np.uint16), *[d for _, d in both]]),
            np.array(joint, np.int64),
        ]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                own = of_shard(*_numbers(b, k, lengths=np.int64, terms=np.uint64, starts=np.int64, docs=np.uint16, tfs=np.uint32))
                columns = [b.column(c).slice(k, 1) for c in (0, 1)] + [pa.array([x.tobytes()], pa.binary()) for x in own]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = index.schema["ids"].dataType.simpleString()
    return index.select("ids", "deal", "lengths", "terms", "starts", "docs", "tfs").mapInArrow(run, f"ids {kind}, deal bigint, {_LISTS}")


class _Shard:
    """A shard's lists, by term and by pair."""

    def __init__(self, n_docs: int, terms, starts, docs, impacts, highest, pairs, pair_starts, pair_docs, joint):
        self.n_docs = n_docs
        self.lists = {k: (docs[a:b], impacts[a:b], int(h)) for k, a, b, h in zip(terms.tolist(), starts.tolist(), starts[1:].tolist(), highest)}
        self.pairs = {k: (pair_docs[a:b], int(j)) for k, a, b, j in zip(pairs.tolist(), pair_starts.tolist(), pair_starts[1:].tolist(), joint)}

    def found(self, units: list[tuple[int, int, int, int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that score ``least`` or more (at least 1), and their scores."""
        none = (None, None, 0)
        bounded = []
        for s, a, t, b, pair in units:
            one, other, (both, joint) = self.lists.get(s, none), self.lists.get(t, none), self.pairs.get(pair, (None, 0))
            if most := max(a * one[2], b * other[2], joint):
                bounded.append((most, a, one, b, other, both, joint))
        bounded.sort(key=lambda u: u[0])
        before, looked_through = 0, []
        for most, a, one, b, other, both, joint in bounded:
            looked_through += [x[0] for w, x in ((a, one), (b, other)) if x[2] and before + w * x[2] >= least]
            if both is not None and before + joint >= least:
                looked_through.append(both)
            before += most
        if not looked_through:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        is_candidate = np.zeros(self.n_docs, bool)
        for docs in looked_through:
            is_candidate[docs] = True
        candidates, left = np.flatnonzero(is_candidate), before
        scores = np.zeros(len(candidates), np.int64)
        for most, a, one, b, other, _, _ in reversed(bounded):
            can = scores + left >= least
            if not can.all():
                candidates, scores = candidates[can], scores[can]
            left -= most
            for weight, (docs, impacts, _) in ((a, one), (b, other)):
                if docs is not None and len(candidates):
                    at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                    scores += np.where(docs[at] == candidates, weight * impacts[at].astype(np.int64), 0)
        best = scores >= least
        return candidates[best], scores[best]


def _order(row: tuple) -> tuple:
    score, key = row
    return -score, key is not None, key


def search_lists(lists: DataFrame, block, thresholds, k: int, item_kind) -> DataFrame:
    """(item, item_id, doc_id, score): what each task finds among its shards that can be of a query's ``k`` best."""
    doc_kind = lists.schema["ids"].dataType.elementType
    kinds = [pa.int64(), to_arrow_type(item_kind), to_arrow_type(doc_kind), pa.int64()]
    formats = dict(terms=np.int32, starts=np.int64, docs=np.uint16, impacts=np.int32, highest=np.int32, pairs=np.int32, pair_starts=np.int64, pair_docs=np.uint16, joint=np.int64)

    def run(batches):
        best: dict[int, list[tuple]] = defaultdict(list)
        least = list(thresholds.value)
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column(0).slice(row, 1).flatten()
                shard = _Shard(len(ids), *_numbers(b, row, **formats))
                for item, units in enumerate(block.value.units):
                    docs, scores = shard.found(units, least[item])
                    if len(docs) > k:
                        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        docs, scores = docs[some], scores[some]
                    if len(docs):
                        best[item] = sorted(best[item] + list(zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())), key=_order)[:k]
                        if len(best[item]) == k:
                            least[item] = max(least[item], best[item][-1][0])
        rows = [(item, block.value.ids[item], key, score) for item, found in best.items() for score, key in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["item", "item_id", "doc_id", "score"])

    schema = f"item bigint, item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score bigint"
    return lists.select("ids", *formats).mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, first_shards: int = FIRST_SHARDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with a score above 0. ``index`` is a landed index."""
    spark = index.sparkSession
    figures = index.agg(F.count("*"), F.sum("n_docs"), F.sum("n_terms")).first()
    n_shards, n_docs, n_terms = (x or 0 for x in figures)
    item_kind, out = queries.schema[key].dataType, None
    doc_kind = index.schema["ids"].dataType.elementType
    for block in _blocks(queries, key, text, block_bytes):
        block.weigh(n_docs, document_counts(index, block.vocabulary))
        shared = spark.sparkContext.broadcast(SimpleNamespace(**vars(block)))  # plain data: executors may lack this module
        cuts = [first_shards]  # shards of the rounds so far
        while cuts[-1] < n_shards:
            cuts.append(cuts[-1] * GROWTH)
        number = F.lit(0)
        for c in cuts[:-1]:
            number += (F.col("deal") >= int((1 << 31) * c / n_shards)).cast("int")
        lists = impact_lists(index, shared, n_docs, n_terms).withColumn("round", number)
        lists.write.partitionBy("round").parquet(path := new_path(spark, "impact-lists"))
        lists = spark.read.schema(lists.schema).parquet(path)
        found, least = None, [1] * len(block.ids)
        for r in range(len(cuts)):
            new = search_lists(lists.where(F.col("round") == r), shared, spark.sparkContext.broadcast(least), k, item_kind)
            found = stage(_ranked(new if found is None else found.unionByName(new), k).drop("rank"), "found")
            if r + 1 < len(cuts):
                for row in found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect():
                    least[row["item"]] = row["least"]
        found = _ranked(found, k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{key} {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score bigint")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over an index that is built and landed for it."""
    return search(stage(build_index(docs), "lexical-index"), queries, k)
