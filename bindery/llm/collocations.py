"""Phrase collocations, mined by marginalising the longest windows.

At each word of a piece of text stands a window of lead columns: the word and the ``longest`` - 1 that follow it, padded
with empty words beyond the piece's end. Only these windows are counted. ROLLUP over (lang, w0, w1, ...) then sums the
counts over successively shorter prefixes, which gives the counts of all shorter phrases, of single words and of all
words of a language; no shorter n-grams are ever made from the texts.

Most windows are unlike all others, so a window is cut short, by more padding, where what follows cannot matter: a phrase
found less than ``least`` times is part of no candidate. Which words, then which pairs of those, and so on, are found that
often is first counted by hash slots, one level after the other. The count of a slot is that of all phrases that fall into
it, so no phrase found often enough is ever cut, and all counts that are used are exact. A level has 2^``slot_bits`` slots at
every size, of which one bit each is sent out (16 MB); the more phrases of a corpus there are to a slot, the fewer windows
are cut, and results are the same.

Tasks send the slots of their texts in order, as distances of about a byte each, and no slot more than ``least`` times, which
is all that tells whether it is full. Windows are added up in each task before they are shuffled, so a hot phrase or language
is some rows of a partial sum; those of one bucket and count are sent as one string. Scores are whole numbers: the products
are decimals of 38 digits, right for counts under 10^15.

Defined cases: null and empty texts have no words; a null language counts as ``und`` and is one with a language of that name;
repeated rows count again; equal scores are ranked by count, then by the phrase's bytes; phrases with equal bytes are one;
very long texts are cut between pieces into parts of a batch; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import each_text, stage
from bindery.llm.wordhash import mixed, text_hashes, word_hashes

SLOT_BITS = 27
PART = 1 << 21  # bytes of text whose words are held at once
HOLD_SLOTS, HOLD_WINDOWS = 1 << 22, 1 << 26  # slots, and bytes of windows, that a task holds before it sends them

#: A-Z in lower case, tabs as spaces, and the contract's ends of pieces as full stops, which are then in no word.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_STOP = word_hashes([b"."])[0]


def _parts(batch: pa.RecordBatch):
    """(lang, bytes) of a batch's texts, joined by language and cut at ends of pieces into parts of about ``PART`` bytes."""
    held: dict[str | None, list[bytes]] = {}
    size: dict[str | None, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
        raw, a = (text or "").encode().translate(_PLAIN), 0
        while a < len(raw):
            b = raw.find(b".", a + PART)
            b = len(raw) if b < 0 else b
            held.setdefault(lang, []).append(raw[a:b])
            size[lang] = size.get(lang, 0) + b - a
            a = b
            if size[lang] >= PART:
                yield lang, b".".join(held.pop(lang))
                del size[lang]
    for lang, some in held.items():
        yield lang, b".".join(some)


def _spaced(raw: bytes) -> bytes:
    return raw.replace(b".", b" . ")


def _levels(hashes: np.ndarray, lang: str, full: list[np.ndarray], bits: int, levels: int):
    """For each level m in turn: which words begin a phrase of m words whose parts all are in full slots, and its slot. Past
    the levels of ``full`` the phrase's own slot is not asked."""
    keys = mixed(hashes ^ word_hashes([lang.encode()])[0])
    goes = hashes != _STOP
    for m in range(1, levels + 1):
        if m > 1:
            keys = mixed(keys[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[m - 1 :])
            goes = goes[:-1] & goes[1:]
        slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
        if m <= len(full):
            goes = goes & ((full[m - 1][slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1)
        yield goes, slots


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def packed_slots(slots: np.ndarray, least: int, bits: int) -> pa.RecordBatch:
    """(bucket, gaps): slots in order, a repeated one ``least`` times at most, as distances within their bucket; a byte of 255
    stands for a distance that goes on in the next."""
    slots, low, least = np.sort(slots), bits - _bucket_bits(bits), max(1, least)
    again = np.zeros(len(slots), bool)
    again[least:] = slots[least:] == slots[:-least]
    slots = slots[~again]
    buckets, first = np.unique(slots >> low, return_index=True)
    gaps = np.diff(slots, prepend=slots[:1])
    gaps[first] = slots[first] & ((1 << low) - 1)
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    starts = np.append(np.append(0, ends)[first], len(out)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.BinaryArray.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer(starts), pa.py_buffer(out)])], ["bucket", "gaps"])


def _bucket_bits(bits: int) -> int:
    return min(10, bits - 3)


def full_slots(texts: DataFrame, below: list[np.ndarray], least: int, bits: int) -> np.ndarray:
    """A bit for each slot of the level above ``below``, set where at least ``least`` phrases fall into it."""
    held, level = texts.sparkSession.sparkContext.broadcast(below), len(below) + 1
    size = 1 << bits - _bucket_bits(bits)

    def run(batches):
        some, n = [], 0
        for b in batches:
            for lang, raw in _parts(b):
                hashes = text_hashes(_spaced(raw))
                if len(hashes) >= level:
                    *_, (goes, slots) = _levels(hashes, lang, held.value, bits, level)
                    some.append(slots[goes].astype(np.int32))
                    n += len(some[-1])
                if n >= HOLD_SLOTS:
                    yield packed_slots(np.concatenate(some), least, bits)
                    some, n = [], 0
        if n:
            yield packed_slots(np.concatenate(some), least, bits)

    def add(rows: pa.Table) -> pa.Table:
        n, places = np.zeros(size, np.int64), []
        for k, own in enumerate(each_text(rows.column("gaps")), 1):
            gaps = np.frombuffer(own, np.uint8)
            places.append(np.cumsum(gaps, dtype=np.int32)[gaps != 255])
            if k % 256 == 0 or k == rows.num_rows:
                n += np.bincount(np.concatenate(places), minlength=size)
                places = []
        return pa.table([rows.column("bucket")[:1], pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    maps = texts.mapInArrow(run, "bucket int, gaps binary").groupBy("bucket").applyInArrow(add, "bucket int, bits binary")
    out = np.zeros((1 << _bucket_bits(bits), size >> 3), np.uint8)
    for r in maps.toArrow().to_batches():  # together no more than the bits of all slots
        for at, own in zip(r.column(0).to_pylist(), each_text(r.column(1))):
            out[at] = np.frombuffer(own, np.uint8)
    return out.ravel()


def windows(texts: DataFrame, full: list[np.ndarray], longest: int, bits: int) -> DataFrame:
    """(lang, window, n): how often each window stands in the texts. Its words are joined by spaces, which no word holds, and
    its pads left out; a window whose first word is found too seldom is empty. Tasks add windows up and send those of one
    bucket and count in order as one string, by line feeds, which no word holds either."""
    held = texts.sparkSession.sparkContext.broadcast(full)
    n_buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of_part(lang: str, raw: bytes):
        words = _spaced(raw).split()
        hashes = word_hashes(words)
        length, key = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
        for goes, _ in _levels(hashes, lang, held.value, bits, longest if len(words) >= longest else len(words)):
            at = np.flatnonzero(goes)
            key[at] = mixed(key[at] * np.uint64(0xD6E8FEB86659FD93) + hashes[at + length[at]] + np.uint64(1))
            length[at] += 1
        some = np.flatnonzero(hashes != _STOP)
        keys, first, n = np.unique(key[some], return_index=True, return_counts=True)
        first, own = some[first], pa.array(words, pa.binary())
        columns = []
        for k in range(longest):
            column = own.take(pa.array(np.minimum(first + k, max(len(words) - 1, 0)))).cast(pa.string())
            columns.append(pc.if_else(pa.array(length[first] > k), column, pa.scalar(None if k else "", pa.string())))
        return keys, pc.binary_join_element_wise(*columns, " ", null_handling="skip"), n

    def packed(lang: str, parts: list) -> pa.RecordBatch:
        keys, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
        some = pa.chunked_array([p[1] for p in parts]).combine_chunks().take(pa.array(first))
        order = pc.sort_indices(some).to_numpy()
        bucket = (mixed(keys) % np.uint64(n_buckets)).astype(np.int32)
        order = order[np.lexsort((n[order], bucket[order]))]
        bucket, n = bucket[order], n[order]
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (n[1:] != n[:-1]))[: len(n)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(n)).astype(np.int32)), some.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([lang] * len(starts), pa.string()), pa.array(n[starts]), pc.binary_join(lists, "\n")], ["bucket", "lang", "n", "windows"])

    def run(batches):
        some: dict[str, list] = {}
        size = 0
        for b in batches:
            for lang, raw in _parts(b):
                some.setdefault(lang, []).append(of_part(lang, raw))
                size += sum(x.nbytes for x in some[lang][-1])
                if size >= HOLD_WINDOWS:
                    yield from (packed(*x) for x in some.items())
                    some, size = {}, 0
        yield from (packed(*x) for x in some.items())

    sent = texts.mapInArrow(run, "bucket int, lang string, n bigint, windows string").repartition("bucket")
    each = sent.select("bucket", "lang", "n", F.explode(F.split("windows", "\n")).alias("window"))
    return each.groupBy("bucket", "lang", "window").agg(F.sum("n").alias("n")).drop("bucket")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text", slot_bits: int = SLOT_BITS) -> DataFrame:
    """(lang, words, f): the occurrences of each phrase of up to ``longest`` words that is found ``least`` times or more, and,
    with no words, of all words of each language."""
    texts = _texts(docs, lang, text)
    full: list[np.ndarray] = []
    for _ in range(longest):
        full.append(full_slots(texts, full, least, slot_bits))
    columns = [f"w{k}" for k in range(longest)]
    top = stage(windows(texts, full, longest, slot_bits), "windows")
    words = F.split("window", " ")
    top = top.select("lang", "n", *[F.coalesce(F.get(words, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)])
    sums = top.rollup("lang", *columns[:-1]).agg(F.sum("n").alias("f")).where("lang is not null")
    sums = sums.select("lang", F.filter(F.array(*columns[:-1]), lambda w: w.isNotNull()).alias("words"), "f")  # nulls are summed over
    sums = top.select("lang", F.array(*columns).alias("words"), F.col("n").alias("f")).unionByName(sums)
    return sums.where((F.size("words") == 0) | ((F.col("f") >= least) & ~F.array_contains("words", "")))


def _decimal(c: str, digits: int) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50, lang: str = "lang", text: str = "text", slot_bits: int = SLOT_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase found a times, cut after k words into parts found l and r times, scores floor(1000000 * a * a / (l * r)); the
    cut with the lowest score counts, and the first of several. A phrase is left out if a longer one that holds it has ``share``
    hundredths of its occurrences or more. Each candidate's parts are looked up by one join, and what it scores and what
    holds it come together in one grouping.
    """
    counts = stage(phrase_counts(docs, longest, least, lang, text, slot_bits), "phrase-counts")
    found = counts.where(F.size("words") > 0).select("lang", F.array_join("words", " ").alias("part"), "f")
    phrases = counts.where(F.size("words") > 1).select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("f").alias("a"))

    def cut(k):
        return F.array(
            F.struct(k.alias("k"), F.lit("l").alias("side"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("part")),
            F.struct(k.alias("k"), F.lit("r").alias("side"), F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("part")),
        )

    def inside(m):  # the phrases of m words inside a longer one
        return F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))

    parts = phrases.select("lang", "phrase", "a", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))))
    parts = parts.join(found, ["lang", "part"]).select("lang", "phrase", "a", "k", "side", "f", F.lit(None).cast("long").alias("longer"))
    held = phrases.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), inside))).alias("phrase"))
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    rows = parts.unionByName(held, allowMissingColumns=True).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *sides)
    cuts = []
    for k in range(1, longest):
        square = F.lit(1_000_000).cast("decimal(7,0)") * _decimal("a", 15) * _decimal("a", 15)
        score = F.call_function("div", square, _decimal(f"l{k}", 18) * _decimal(f"r{k}", 18))
        some = F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        cuts.append(F.when(F.col(f"l{k}").isNotNull() & F.col(f"r{k}").isNotNull(), some))
    lowest = F.array_min(F.array(*cuts))
    rows = rows.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).withColumn("cut", lowest)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    all_words = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return rows.join(all_words, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
