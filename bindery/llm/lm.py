"""Stupid-backoff scores of documents from n-gram counts of the other documents, computed relationally.

Texts are cut into words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased). With c(g) the number of times that an n-gram g
occurs in the training documents other than the one being scored, a word w after the context v (the ``order`` - 1 words
before it, fewer at the start of a document) scores c(v w) / c(v) if c(v w) > 0; else ``alpha`` times its score after
the context less its first word; without a context, max(c(w), 0.5) / N, where N counts the others' words. A document's
score is the mean log10 of its words' scores. Leaving out a document's own counts lets backoff work on the corpus that
was counted; with ``train`` given, all counts are of that corpus and nothing is left out.

The plan is an aggregation and two joins on keys:

1. Documents are dealt by hash into groups of about ``group_bytes`` of text. Each group explodes its n-grams of all
   orders (the empty one, whose count is N, included) and adds equal ones up before anything is shuffled, so an n-gram
   leaves a group once however hot it is: no key, pair or passage makes a large partition.
2. The count table is partitioned by the n-grams' hash into buckets of about ``bucket_grams``. A bucket sums the groups'
   counts of each n-gram and joins the sums to the groups that hold it.
3. The counts come back to the groups, are joined to their documents' n-grams, less the document's own occurrences, and
   summed for each document.

An exploded n-gram is an entry of a packed column and not a row of its own: a group sends a bucket one row with its
sorted hashes as differences and its counts. Nothing is collected or broadcast but the corpus's size in bytes. An n-gram
is its hash of 48 to 64 bits, as many as keep the share of n-grams that have another one's hash below one in a million;
two n-grams of one hash add their counts.

Defined cases: null, empty and blank texts have 0 words and a null score; repeated rows are documents of their own, each
counted for the others; null and repeated doc_id values are passed on; without training documents every word is unseen
and scores as such; a very long text is read whole and is a group of its own, whose memory its length bounds; an empty
table gives an empty table; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.wordhash import mixed, word_hashes

ORDER = 3
ALPHA = 0.4
GROUP_BYTES = 8 << 20
BUCKET_GRAMS = 1 << 17
SPARE_BITS = 20
EMPTY = np.uint64(0)  # the empty n-gram

_REQUESTS = "bucket bigint, g bigint, first bigint, steps binary, n binary, large binary"
_ANSWERS = "bucket bigint, g bigint, c binary, large binary"


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8").lower().split())


def hash_bits(n_grams: int) -> int:
    """Bits of an n-gram's hash: SPARE_BITS more than their number has, so that one in a million or fewer share a hash."""
    return min(64, max(48, int(n_grams).bit_length() + SPARE_BITS))


def document_grams(words: np.ndarray, lengths: np.ndarray, order: int, bits: int = 64) -> list[np.ndarray]:
    """For each order from 1, the hash of the n-gram that ends at each word; EMPTY where the document begins later."""
    before = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, last = [], words
    for k in range(1, order + 1):
        if k > 1:  # the n-gram that ends one word before, and this word
            last = mixed(np.append(EMPTY, last[:-1]) * np.uint64(0xD6E8FEB86659FD93) + words)
        out.append(np.where(before >= k - 1, np.maximum(last >> np.uint64(64 - bits), np.uint64(1)), EMPTY))
    return out


def _distinct(grams: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, place of each n-gram in them, occurrences); the empty one occurs at each word."""
    found, at, n = np.unique(np.concatenate([*grams, [EMPTY]]), return_inverse=True, return_counts=True)
    n[0] = n_words
    return found, at[:-1].astype(np.int32), n


def small_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes; those of 255 and more follow as longs, in order."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes(), values[large].astype(np.int64).tobytes()


def numbers(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def steps_of(grams: np.ndarray) -> bytes:
    """Differences of sorted n-grams in as many bytes as the largest needs."""
    d = np.diff(grams)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def grams_of(first: int, steps: bytes, n: int) -> np.ndarray:
    d = np.zeros((n, 8), np.uint8)
    if n > 1:
        d[1:, : len(steps) // (n - 1)] = np.frombuffer(steps, np.uint8).reshape(n - 1, -1)
    d = d.view("<u8").ravel()
    d[0] = first
    return np.cumsum(d, dtype=np.uint64)


def _hashed(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    parts = [_words(t.as_py()) for t in texts]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array([len(p) for p in parts], np.int64)


def _requests(order: int, bits: int, n_buckets: int):
    def run(group: pa.Table) -> pa.Table:
        words, lengths = _hashed(group.column("text"))
        counted = group.column("counted")[0].as_py()
        found, _, n = _distinct(document_grams(words, lengths, order, bits), len(words))
        n = n if counted else np.zeros(len(n), np.int64)
        bucket = ((found >> np.uint64(bits - 32)) * np.uint64(n_buckets)) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(found))
        g, rows = group.column("g")[0].as_py(), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows.append((int(bucket[a]), g, int(found[a]), steps_of(found[a:b]), *small_numbers(n[a:b])))
        kinds = [pa.int64()] * 3 + [pa.binary()] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "g", "first", "steps", "n", "large"])

    return run


def _answers(bucket: pa.Table) -> pa.Table:
    """The bucket's count table, joined to the groups that asked."""
    rows = bucket.to_pylist()
    asked = [grams_of(r["first"], r["steps"], len(r["n"])) for r in rows]
    found, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(found), np.int64)
    np.add.at(counts, at, np.concatenate([numbers(r["n"], r["large"]) for r in rows]))
    ends = np.cumsum([len(a) for a in asked])
    packed = [small_numbers(counts[at[b - len(a) : b]]) for a, b in zip(asked, ends)]
    columns = [[r["bucket"] for r in rows], [r["g"] for r in rows], [p[0] for p in packed], [p[1] for p in packed]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 2)], ["bucket", "g", "c", "large"])


def word_scores(grams: list[np.ndarray], at: np.ndarray, totals: np.ndarray, n: np.ndarray, lengths: np.ndarray, alpha: float, own_out: bool) -> np.ndarray:
    """Log10 score of each word. ``totals`` are the corpus's counts of the distinct n-grams and ``n`` this group's; the
    document's own occurrences are taken off if ``own_out``."""
    size = int(lengths.sum())
    doc = np.repeat(np.arange(len(lengths)), lengths)
    counts = []
    for k, gram in enumerate(grams):
        place = at[k * size : (k + 1) * size]
        c = totals[place]
        if own_out:
            own = np.ones(size, np.int64)
            again = np.flatnonzero(n[place] > 1)
            _, back, times = np.unique(doc[again] * len(totals) + place[again], return_inverse=True, return_counts=True)
            own[again] = times[back]
            c = c - own
        counts.append(np.where(gram == EMPTY, 0, c))
    order, step = len(grams), math.log10(alpha)
    before = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    has = np.minimum(before + 1, order)
    others = np.maximum(totals[0] - (np.repeat(lengths, lengths) if own_out else 0), 1)
    out = np.log10(np.maximum(counts[0], 0.5) / others) + (has - 1) * step
    for k in range(2, order + 1):  # a longer n-gram that was seen goes first
        seen = np.flatnonzero(counts[k - 1] > 0)
        out[seen] = np.log10(counts[k - 1][seen] / counts[k - 2][seen - 1]) + (has[seen] - k) * step
    return out


def _scores(order: int, bits: int, alpha: float, own_out: bool):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        words, lengths = _hashed(group.column("text"))
        grams = document_grams(words, lengths, order, bits)
        found, at, n = _distinct(grams, len(words))
        totals = np.concatenate([np.zeros(0, np.int64), *(numbers(c.as_py(), x.as_py()) for c, x in zip(answers.column("c"), answers.column("large")))])
        scored = group.num_rows and group.column("scored")[0].as_py()
        if scored and len(totals) != len(found):
            raise RuntimeError(f"a group of documents asked for {len(found)} counts and got {len(totals)}")
        ids = group.column("doc_id")
        if not scored:
            return pa.Table.from_arrays([ids.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], ["doc_id", "n_words", "score"])
        value = word_scores(grams, at, totals, n, lengths, alpha, own_out)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        sums = np.bincount(doc, weights=value, minlength=len(lengths))
        mean = np.divide(sums, lengths, out=np.full(len(lengths), np.nan), where=lengths > 0)
        return pa.Table.from_arrays([ids, pa.array(lengths), pa.array(mean, from_pandas=True)], ["doc_id", "n_words", "score"])

    return run


def _grouped(docs: DataFrame, kind: int, group_bytes: int, scored: bool, counted: bool) -> tuple[DataFrame, int]:
    """(g, doc_id, text, scored, counted) and the bytes of all texts. The partition's number takes part in the hash, so that
    repeats of one row do not meet in one group."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = size // group_bytes + 1
    g = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)) * 2 + kind
    return docs.select(g.alias("g"), "doc_id", "text", F.lit(scored).alias("scored"), F.lit(counted).alias("counted")), size


def stupid_backoff(docs: DataFrame, train: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA,
                   group_bytes: int = GROUP_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """(doc_id, n_words, score) for each row of ``docs``; counts come from ``train``, or from the other rows of ``docs``."""
    kind = docs.schema["doc_id"].dataType
    dealt, size = _grouped(docs, 0, group_bytes, True, train is None)
    if train is not None:
        more, its_size = _grouped(train.select(F.col("doc_id").cast(kind).alias("doc_id"), "text"), 1, group_bytes, False, True)
        dealt, size = dealt.unionByName(more), size + its_size
    n_grams = size // 6 * order  # a word has some six bytes
    bits, n_buckets = hash_bits(n_grams), n_grams // bucket_grams + 1
    requests = dealt.groupBy("g").applyInArrow(_requests(order, bits, n_buckets), _REQUESTS)
    answers = requests.groupBy("bucket").applyInArrow(_answers, _ANSWERS)
    joined = dealt.groupBy("g").cogroup(answers.groupBy("g"))
    return joined.applyInArrow(_scores(order, bits, alpha, train is None), f"doc_id {kind.simpleString()}, n_words bigint, score double")
