"""Character n-gram language models with Kneser-Ney smoothing, counted by Spark and kept in sorted hash arrays.

Characters fall into a small number of classes, so an n-gram packs into ``order * bits`` bits: its hash is that packed
value, without collisions, and a model has at most 2 ^ (order * bits) entries however large the corpus is. A model is a
few sorted arrays of such hashes with probabilities and backoff weights beside them; look-ups are binary searches.

Counting runs over all documents: each task counts its n-grams for each language and Spark adds the counts up.
Lower orders use continuation counts (how many different characters come before), as Kneser-Ney smoothing wants.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 1 << 19  # characters handled at once
HOLD = 1 << 22  # distinct n-grams a task holds before it emits


@dataclass(frozen=True)
class Alphabet:
    """Classes of code points. ``letters`` alone (lower-cased, all else one gap class 0, runs of gaps as one), or every
    printable ASCII character by itself (digits as one)."""

    bits: int
    order: int
    letters: bool

    def table(self) -> np.ndarray:
        size = 1 << self.bits
        out = np.zeros(0x10000, np.uint8)
        points = np.arange(0x10000)
        alpha = np.array([chr(c).isalpha() for c in points])
        if self.letters:
            out[97:123] = np.arange(1, 27)
            out[65:91] = np.arange(1, 27)
        else:
            out[:] = size - 1
            out[:128] = 1
            out[32:127] = np.arange(1, 96)
            out[48:58] = out[48]
            out[10] = 0
        high = alpha & (points >= 128)
        out[high] = self.letter_class(points[high])
        return out

    def letter_class(self, points: np.ndarray) -> np.ndarray:
        """Classes of letters outside ASCII: hashed into those that ASCII leaves free."""
        first = 27 if self.letters else 96
        return (first + points % ((1 << self.bits) - 1 - first + self.letters)).astype(np.uint8)

    def codes(self, text: str) -> np.ndarray:
        """Classes of a text between two gaps."""
        points = np.frombuffer((text.lower() if self.letters else text).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _table(self)[np.minimum(points, 0xFFFF)]
        high = np.flatnonzero(points > 0xFFFF)
        if len(high):  # letters above the table are classed as those in it
            distinct, back = np.unique(points[high], return_inverse=True)
            alpha = np.array([chr(x).isalpha() for x in distinct])
            c[high] = np.where(alpha, self.letter_class(distinct), 0 if self.letters else (1 << self.bits) - 1)[back]
        c = np.concatenate([[0], c, [0]]).astype(np.uint8)
        if self.letters:
            c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
        return c

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(packed n-grams of all texts, number of n-grams of each): one for each character after the first gap."""
        n = self.order
        parts = [self.codes(t) for t in texts]
        lengths = np.array([len(p) - 1 for p in parts])
        lead = np.zeros(n - 2, np.uint8)
        line = np.concatenate([x for p in parts for x in (lead, p)]).astype(np.uint32)
        packed = np.zeros(len(line) - n + 1, np.uint32)
        for k in range(n):
            packed = (packed << np.uint32(self.bits)) | line[k : len(line) - n + 1 + k]
        starts = np.cumsum(np.append(0, lengths[:-1] + n - 1))
        keep = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        return packed[keep], lengths


_tables: dict[Alphabet, np.ndarray] = {}


def _table(alphabet: Alphabet) -> np.ndarray:
    if alphabet not in _tables:
        _tables[alphabet] = alphabet.table()
    return _tables[alphabet]


def runs_of(texts: list[str]):
    """(start, end) of stretches of texts of about RUN characters."""
    a = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= RUN:
            yield a, k + 1
            a, chars = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def count_grams(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text): map-side sums, then one shuffle of distinct n-grams."""

    def emit(held):
        for lang, parts in held.items():
            grams, counts = added(parts)
            for k in range(0, len(grams), 1 << 16):
                g, c = grams[k : k + (1 << 16)], counts[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list] = defaultdict(list)
        size = 0
        for b in batches:
            by_lang = defaultdict(list)
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang[lang].append(t or "")
            for lang, texts in by_lang.items():
                for i, j in runs_of(texts):
                    grams, counts = np.unique(alphabet.grams(texts[i:j])[0], return_counts=True)
                    held[lang].append((grams, counts))
                    size += len(grams)
                    if size > HOLD:
                        held = defaultdict(list, {k: [added(v)] for k, v in held.items()})
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HOLD // 2:
                            yield from emit(held)
                            held, size = defaultdict(list), 0
        yield from emit(held)

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, by the usual estimates from counts of counts."""
    n1, n2, n3, n4 = (max(1, int((counts == k).sum())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    if not modified:
        return np.array([0, y, y, y])
    raw = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(raw, [0, 0.1, 0.1, 0.1], [0, 0.95, 1.9, 2.8])


def _level(grams: np.ndarray, counts: np.ndarray, bits: int, modified: bool):
    """(discounted probability of each gram, contexts, backoff weight of each context, context number of each gram)."""
    d = _discounts(counts, modified)[np.minimum(counts, 3)]
    contexts, back = np.unique(grams >> np.uint32(bits), return_inverse=True)
    total = np.bincount(back, weights=counts)
    return (counts - d) / total[back], contexts, np.bincount(back, weights=d) / total, back


@dataclass
class Model:
    """Log probabilities of several languages at once: for each order, sorted n-grams with a row of values per language,
    and sorted contexts with a row of backoff weights."""

    alphabet: Alphabet
    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)

    def rows(self, grams: np.ndarray, k: int | None = None) -> np.ndarray:
        """Natural log probability of the last character of each n-gram given the others, by language."""
        k = self.alphabet.order if k is None else k
        if k == 0:
            return np.full((len(grams), len(self.langs)), -self.alphabet.bits * np.log(2), np.float32)
        known, at = self.grams[k - 1], np.searchsorted(self.grams[k - 1], grams)
        at = np.minimum(at, len(known) - 1)
        found = known[at] == grams
        out = self.logp[k - 1][at]
        if not found.all():
            rest = grams[~found]
            lower = self.rows(rest & np.uint32((1 << (k - 1) * self.alphabet.bits) - 1), k - 1)
            context = rest >> np.uint32(self.alphabet.bits)
            c = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
            lower += np.where((self.contexts[k - 1][c] == context)[:, None], self.backoff[k - 1][c], 0)
            out[~found] = lower
        return out

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each text (rows) under each language (columns). A text without n-grams has that of
        characters of equal chance under every language."""
        return cross_entropies([self], texts)


def cross_entropies(models: list[Model], texts: list[str]) -> np.ndarray:
    """The models' cross-entropies side by side; n-grams are made once for all of them."""
    alphabet = models[0].alphabet
    out = np.full((len(texts), sum(len(m.langs) for m in models)), alphabet.bits * np.log(2))
    for i, j in runs_of(texts):
        grams, lengths = alphabet.grams(texts[i:j])
        some = np.flatnonzero(lengths)
        if not len(some):
            continue
        distinct, back = np.unique(grams, return_inverse=True)
        starts = (np.cumsum(lengths) - lengths)[some]  # reduceat takes no empty stretch
        values = (column for m in models for column in m.rows(distinct).astype(np.float64).T)
        for c, column in enumerate(values):
            out[i + some, c] = -np.add.reduceat(column[back], starts) / lengths[some]
    return out


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: Alphabet, modified: bool) -> Model:
    """Interpolated Kneser-Ney (one discount an order) or its modified form (three) for each language's n-gram counts."""
    model, bits = Model(alphabet, sorted(counts)), alphabet.bits
    levels = {lang: [None] * alphabet.order for lang in counts}
    for lang, (grams, n) in counts.items():
        order = np.argsort(grams)
        grams, n = grams[order].astype(np.uint32), n[order]
        for k in range(alphabet.order, 0, -1):
            levels[lang][k - 1] = (grams, *_level(grams, n, bits, modified))
            grams, n = np.unique(grams & np.uint32((1 << (k - 1) * bits) - 1), return_counts=True)
    for k in range(1, alphabet.order + 1):
        union = np.unique(np.concatenate([levels[x][k - 1][0] for x in model.langs]))
        contexts = np.unique(union >> np.uint32(bits))
        lower = np.exp(model.rows(union & np.uint32((1 << (k - 1) * bits) - 1), k - 1))
        p, weight = np.zeros((len(union), len(model.langs))), np.ones((len(contexts), len(model.langs)))
        for c, lang in enumerate(model.langs):
            grams, direct, own, backoff, _ = levels[lang][k - 1]
            weight[np.searchsorted(contexts, own), c] = backoff
            p[np.searchsorted(union, grams), c] = direct
        p += weight[np.searchsorted(contexts, union >> np.uint32(bits))] * lower
        model.grams.append(union)
        model.contexts.append(contexts)
        model.logp.append(np.log(np.maximum(p, 1e-30)).astype(np.float32))
        model.backoff.append(np.log(np.maximum(weight, 1e-30)).astype(np.float32))
    return model


@dataclass
class Models:
    """One model a language, each broadcast by itself: a worker loads those of the languages that it meets. With a
    ``pooled`` model of all languages' text, a language's probabilities are mixed with that model's, its own with the
    share ``own`` of the language."""

    parts: dict[str, Broadcast]
    pooled: Broadcast | None = None
    own: dict[str, float] = field(default_factory=dict)

    @property
    def langs(self) -> list[str]:
        return sorted(self.parts)

    def cross_entropy(self, texts: list[str], lang: str | None = None) -> np.ndarray:
        """Nats per character of each text (rows) under each language, or the one that is asked for (columns)."""
        asked = self.langs if lang is None else [lang]
        if self.pooled is None:
            return cross_entropies([self.parts[x].value for x in asked], texts)
        mixed = [_Mixed(self.parts[x].value, self.pooled.value, self.own[x]) for x in asked]
        return cross_entropies(mixed, texts)


class _Mixed:
    """Two models of one language each, the first with the given share."""

    def __init__(self, one: Model, other: Model, share: float):
        self.alphabet, self.langs, self.models, self.share = one.alphabet, one.langs, (one, other), share

    def rows(self, grams: np.ndarray) -> np.ndarray:
        own, all_text = (np.exp(m.rows(grams).astype(np.float64)) for m in self.models)
        return np.log(self.share * own + (1 - self.share) * all_text)


def _counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    held = table.select("gram", "n").toArrow()
    return held.column("gram").to_numpy(), held.column("n").to_numpy()


def language_models(docs: DataFrame, alphabet: Alphabet, modified: bool, stored, pooled_chars: int = 0) -> Models:
    """A model of each language in the rows of ``docs`` (lang, text). With ``pooled_chars``, a language of n n-grams has the share
    n / (n + pooled_chars) in its mixture with a model of all languages' text, at every size. ``stored`` writes the count table. A
    language at a time, of at most 2 ^ (order * bits) counts, passes the driver."""
    spark, table = docs.sparkSession, stored(count_grams(docs, alphabet))
    sizes = {r.lang: r.size for r in table.groupBy("lang").agg(F.sum("n").alias("size")).collect()}
    send = lambda counts: spark.sparkContext.broadcast(estimate({"": counts}, alphabet, modified))
    parts = {lang: send(_counts(table.where(F.col("lang") == lang))) for lang in sorted(sizes)}
    if not pooled_chars or not parts:
        return Models(parts)
    pooled = send(_counts(table.groupBy("gram").agg(F.sum("n").alias("n"))))
    return Models(parts, pooled, {lang: n / (n + pooled_chars) for lang, n in sizes.items()})
