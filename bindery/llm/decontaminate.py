"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased and cut into words of letters, digits and underscores, then into 5-word shingles (a text of
fewer words is one shingle). A document holds a test item if it has at least ``threshold`` of the item's distinct
shingles, however long the document is.

Items are partitioned by their number of shingles. In each partition an item is sketched by the shingles with its
smallest MinHash values: with q shingles of which m must be found, q - m may be missing, so of a sketch of q - m + 2
at least 2 are in any document that holds the item (1, if the item has no more). Documents too short for a partition
skip it; the others look up their shingle hashes in its sorted sketch values. Candidates are verified on the shingles
themselves, so neither the sketch nor the hashes lose or add a match.

Items come in blocks of about ``block_bytes``; each block is broadcast and meets all documents, whose words never move.

A document is read in pieces of about ``PIECE`` characters that overlap by a shingle less one word, and only shingles
whose hash a candidate item has are made, so a very long text takes little more memory than itself.

Defined cases: null, empty and wordless texts match nothing; repeated documents and items give a row each; null ids are
kept, and ids of any type; no documents or no items give no rows; a very long text is searched whole; columns other than
the id and the text are not read, and ``without_contaminated`` passes all columns on as they are.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bindery.llm.common import each_text, rows_by_text
from bindery.llm.wordhash import ngram_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20

_WORD = re.compile(r"\w+")
_BETWEEN = re.compile(r"\W")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    if len(words) <= n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


def pieces(text: str | None, n: int = SHINGLE):
    """Lists of words that hold every shingle of the text: stretches of the text, each after the last words of the one before."""
    text, a, words, some = (text or "").lower(), 0, [], False
    while a < len(text):
        end = _BETWEEN.search(text, a + PIECE) if a + PIECE < len(text) else None
        b = end.start() if end else len(text)
        words += _WORD.findall(text, a, b)
        a = b
        if len(words) >= n:
            yield words
            words, some = words[len(words) - n + 1 :], True
    if words and not some:  # a text of fewer words than a shingle
        yield words


def _hashes(words: list[str], n: int) -> np.ndarray:
    return ngram_hashes(word_hashes([w.encode("utf-8", "surrogatepass") for w in words]), n)


class ItemIndex:
    """Sketches of some items, partitioned by size, and the items' texts for verification."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float = THRESHOLD, n: int = SHINGLE):
        self.n, self.items = n, []
        parts = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            q = len(shingles(words, n))
            if not q:
                continue
            wanted = max(1, math.ceil(threshold * q - 1e-9))
            k = min(q, q - wanted + 2)
            sketch = np.sort(np.unique(_hashes(words, n)))[:k]
            parts[q.bit_length()].append((wanted, k - (q - wanted), len(self.items), sketch))
            self.items.append((item_id, text, wanted))
        self.parts = []
        for _, members in sorted(parts.items()):
            values = np.concatenate([m[3] for m in members])
            owners = np.concatenate([np.full(len(m[3]), i) for i, m in enumerate(members)])
            order = np.argsort(values, kind="stable")
            needs = np.array([m[1] for m in members])
            self.parts.append((min(m[0] for m in members), values[order], owners[order], needs, np.array([m[2] for m in members])))

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item_id, shared, shingles of the item) for each item that the text holds."""
        if not self.parts:
            return []
        hits, n_shingles = [[] for _ in self.parts], 0
        for words in pieces(text, self.n):
            found = _hashes(words, self.n)
            n_shingles += len(found)
            for values_hit, (_, values, *_) in zip(hits, self.parts):
                hit = found[values[np.minimum(np.searchsorted(values, found), len(values) - 1)] == found]
                if len(hit):
                    values_hit.append(np.unique(hit))
        candidates = []
        for values_hit, (least, values, owners, needs, numbers) in zip(hits, self.parts):
            if values_hit and n_shingles >= least:
                hit = np.unique(np.concatenate(values_hit))
                a, b = np.searchsorted(values, hit), np.searchsorted(values, hit, side="right")
                score = np.bincount(np.concatenate([owners[i:j] for i, j in zip(a, b)]), minlength=len(needs))
                candidates += numbers[score >= needs].tolist()
        return self.verified(text, candidates) if candidates else []

    def verified(self, text: str | None, candidates: list[int]) -> list[tuple[object, int, int]]:
        """Those of the candidate items whose shingles the text has in fact."""
        item_words = [words_of(self.items[c][1]) for c in candidates]
        theirs = [shingles(w, self.n) for w in item_words]
        wanted = np.unique(np.concatenate([_hashes(w, self.n) for w in item_words]))
        own = set()
        for words in pieces(text, self.n):
            found = _hashes(words, self.n)
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found)
            own.update(tuple(words[i : i + self.n]) for i in at.tolist())
        out = []
        for c, item in zip(candidates, theirs):
            item_id, _, least = self.items[c]
            if len(item & own) >= least:
                out.append((item_id, len(item & own), len(item)))
        return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes``, split by hash."""
    rows = items.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _indexes(items: DataFrame, threshold: float, block_bytes: int):
    for block in item_blocks(items, block_bytes):
        index = ItemIndex([(r.item_id, r.text) for r in block.collect()], threshold)
        yield items.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): each document and each item that it holds."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared bigint, n_item bigint"
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    out = None
    for index in _indexes(items, threshold, block_bytes):

        def run(batches, index=index):
            for b in batches:
                rows = [(k, *m) for k, t in enumerate(each_text(b.column(1))) for m in index.value.matches(t)]
                if rows:
                    at, item, shared, size = zip(*rows)
                    ids = b.column(0).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_kind), pa.array(shared, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for index in _indexes(items, threshold, block_bytes):
        docs = rows_by_text(docs, lambda texts, index=index: [not index.value.matches(t) for t in texts])
    return docs
