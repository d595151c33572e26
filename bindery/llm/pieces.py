"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as its model says and cut into single characters. An agenda, ordered by score and then by place,
holds the pairs of neighbours that the vocabulary can merge; the best pair is merged and the pairs that the new symbol
makes with its neighbours are added, until the agenda is empty. Symbols that are no pieces fall back to their bytes, or, with
a vocabulary without bytes, to one unknown id a run.

A merge can only cross the line between two characters that stand side by side in some piece. Where no piece has anything
but the space mark before a space mark, or a line feed beside anything, a text falls into words that are merged one by one,
with the same result, and a task remembers the pieces of words that it has met. Otherwise the whole text is one word.
Long words have an agenda of their own, a heap. The new short words of an Arrow batch share one that is kept as an array:
each round takes the best pair of every word at once.

The new words of each batch are also encoded by the sentencepiece library, and ``agrees`` says for each text whether all of
its words came out alike (whole texts are compared where they are one word). Decoding is the library's. The model is read
by the driver from the path that it is given and sent out (a vocabulary is some MB at most). Nothing is shuffled.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows of equal texts are rows like others; an
empty table gives an empty table; very long texts and words are encoded whole; all columns but the text pass, whatever
their names, before the new ones.
"""

from __future__ import annotations

import heapq
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from bindery.llm.common import each_text

SPACE = "▁"  # the mark that stands for a space in pieces
SHORT = 32  # characters of words that share an agenda
KNOWN_WORDS = 1 << 18  # that a task remembers from batch to batch, of
KNOWN_CHARS = 1 << 22  # characters in all
CHECKED = 256  # words that the library gets at once
SLICE = 1 << 22  # bytes of text whose ids are held at once

_FREE = np.int64(1 << 62)  # no merge; above every place in an agenda
_OTHER = 1 << 24  # from here on, characters of no piece by their code points


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class PieceModel:
    """A merge-type vocabulary, from the bytes of a model file."""

    def __init__(self, model: bytes):
        spec, kind = proto.ModelProto(), proto.ModelProto.SentencePiece
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if any(p.type == kind.USER_DEFINED for p in spec.pieces):
            raise ValueError("pieces defined by the user are not read")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score, self.unused, self.id_of, byte_id, unknown = {}, set(), {}, {}, 0
        for k, p in enumerate(spec.pieces):
            if p.type == kind.UNKNOWN:
                unknown = k
            elif p.type == kind.BYTE:
                byte_id[int(p.piece[1:-1], 16)] = k
            elif p.type in (kind.NORMAL, kind.UNUSED):
                self.score[p.piece], self.id_of[p.piece] = p.score, k
                if p.type == kind.UNUSED:
                    self.unused.add(p.piece)
        fallback = spec.trainer_spec.byte_fallback
        self.unknown = None if fallback else unknown
        self.spelt = lambda c: [byte_id[b] for b in c.encode()] if fallback else [unknown]
        beside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.apart = fallback and not any((b == SPACE != a) or "\n" in (a, b) for a, b in beside)
        self.words = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.apart else r"(?s:.+)").findall
        self._pairs(len(spec.pieces))
        self._forget()

    def _pairs(self, n: int) -> None:
        """The merges as sorted arrays: two symbols in one number, the rank of their score, the symbol they make."""
        chars = sorted({c for p in self.score for c in p})
        self.chars = [c for c in chars if c not in self.id_of]
        symbol = self.id_of | {c: n + k for k, c in enumerate(self.chars)}
        self.n = n
        rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        merges = sorted(
            (symbol[a] << 32 | symbol[b], rank[s], symbol[p])
            for p, s in self.score.items()
            for k in range(1, len(p))
            for a, b in [(p[:k], p[k:])]
            if a in symbol and b in symbol
        )
        self.merges = tuple(np.array(x, np.int64) for x in zip(*merges)) if merges else (np.array([-1]), np.array([0]), np.array([0]))
        self.points = np.array([ord(c) for c in chars] or [0])
        self.symbols = np.array([symbol[c] for c in chars] or [_OTHER])

    def _forget(self) -> None:
        self.known, self.held = _Numbers(), 0
        self.values, self.ends, self.differ = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    # --- merging ---

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of a word's characters when its agenda is empty."""
        symbols, n, score = list(word), len(word), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda, made_of = [], {}

        def suggest(left: int, right: int) -> None:
            if left >= 0 and right < n:
                piece = symbols[left] + symbols[right]
                if piece in score:
                    heapq.heappush(agenda, (-score[piece], left, right, len(piece)))
                    if piece in self.unused:
                        made_of[piece] = (symbols[left], symbols[right])

        for k in range(n - 1):
            suggest(k, k + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two was merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            suggest(before[left], left)
            suggest(left, after[left])
        out, rest = [], [s for s in reversed(symbols) if s]
        while rest:  # unused pieces fall apart again
            s = rest.pop()
            if s in made_of:
                rest += reversed(made_of[s])
            else:
                out.append(s)
        return out

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the merges of pairs stand, -1 where there is none."""
        keys = self.merges[0]
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, at, -1)

    def merged_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols, as numbers, of many words that are not empty, one word's after the other's, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.symbols[at], _OTHER + points)
        sizes, names, done = np.array([len(w) for w in words], np.int64), np.arange(len(words)), []
        found = np.append(self._places(symbols[:-1], symbols[1:]), -1)  # the merge of each symbol with the next
        found[np.cumsum(sizes) - 1] = -1
        while len(names):
            agenda = np.where(found < 0, _FREE, self.merges[1][found] << 32 | np.arange(len(found)))
            best = np.minimum.reduceat(agenda, np.cumsum(sizes) - sizes)
            more = best != _FREE
            stay = np.repeat(more, sizes)
            done.append((symbols[~stay], names[~more], sizes[~more]))
            left = best[more] & 0xFFFFFFFF
            symbols[left] = self.merges[2][found[left]]
            stay[left + 1] = False
            left = np.cumsum(stay)[left] - 1
            symbols, found, names, sizes = symbols[stay], found[stay], names[more], sizes[more] - 1
            first, last = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
            first[np.cumsum(sizes) - sizes] = True
            last[np.cumsum(sizes) - 1] = True
            found[left] = np.where(last[left], -1, self._places(symbols[left], symbols[np.minimum(left + 1, len(symbols) - 1)]))
            left = left[~first[left]]
            found[left - 1] = self._places(symbols[left - 1], symbols[left])
        symbols, names, sizes = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(names)
        return symbols[_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    # --- words and texts ---

    def _spelt_out(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces replaced by the ids of their bytes."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols, sizes
        ids = [self.spelt(self.chars[s - self.n] if s < _OTHER else chr(s - _OTHER)) for s in symbols[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in ids]
        ends = np.append(0, np.cumsum(width))
        out = np.repeat(symbols, width)
        out[_ranges(ends[odd], width[odd])] = np.concatenate(ids)
        of_word = np.append(0, np.cumsum(sizes))
        return out, np.diff(ends[of_word])

    def _learn(self, words: list[str]) -> None:
        """The ids of new words, and whether the library's differ."""
        short = np.array([len(w) <= SHORT and not self.unused for w in words])
        sizes, parts = np.zeros(len(words), np.int64), []
        if short.any():
            ids, sizes[short] = self._spelt_out(*self.merged_together([w for w, s in zip(words, short) if s]))
            parts.append((short, ids))
        if not short.all():
            long = [[i for s in self.merged(words[k]) for i in ([self.id_of[s]] if s in self.id_of else self.spelt(s))] for k in np.flatnonzero(~short)]
            sizes[~short] = [len(x) for x in long]
            parts.append((~short, np.concatenate(long)))
        ids, starts = np.zeros(sizes.sum(), np.int64), np.cumsum(sizes) - sizes
        for these, own in parts:
            ids[_ranges(starts[these], sizes[these])] = own
        if self.apart:
            self.differ = np.append(self.differ, self._differing(words, ids, sizes))
        self.values = np.append(self.values, ids.astype(np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))
        self.held += sum(map(len, words))

    def _differing(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words the library encodes otherwise. Line feeds part the words that it gets at once."""
        feed = self.library.encode("\n")
        out, ends = np.zeros(len(words), bool), np.append(0, np.cumsum(sizes))
        for a in range(0, len(words), CHECKED):
            some = words[a : a + CHECKED]
            theirs = self.library.encode("".join("\n" + w.replace(SPACE, " ") for w in some))
            at = ends[a : a + len(some)] - ends[a]
            ours = np.insert(ids[ends[a] : ends[a + len(some)]], at, feed[-1])
            if theirs != feed[:-1] + ours.tolist():
                for k, w in enumerate(some, a):
                    out[k] = self.library.encode("\n" + w.replace(SPACE, " "))[len(feed) :] != ids[ends[k] : ends[k + 1]].tolist()
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they are the library's."""
        if len(self.known) > KNOWN_WORDS or self.held > KNOWN_CHARS:
            self._forget()
        old, asked = len(self.known), []
        for t in texts:
            words = self.words(self.library.normalize(t)) if t else []
            asked.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        if len(self.known) > old:
            self._learn(list(self.known)[old:])
        out = []
        for words in asked:
            ids = self.values[_ranges(self.ends[words], self.ends[words + 1] - self.ends[words])]
            if self.unknown is not None:  # a run of unknown symbols is one
                ids = ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))[: len(ids)]]
            out.append(ids)
        if self.apart:
            return out, [not self.differ[words].any() for words in asked]
        return out, [self.library.encode(t or "") == ids.tolist() for t, ids in zip(texts, out)]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


def _slices(batch: pa.RecordBatch, at: int):
    """The batch in slices of texts of about ``SLICE`` bytes."""
    start = total = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if total + n > SLICE and k > start:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def tokenise(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``agrees`` (the library gives the same ids) instead of ``text``, and with
    ``decoded`` (string) unless it is not wanted."""
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    at, plain = docs.columns.index(text), docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kept = [k for k in range(len(docs.columns)) if k != at]
    new = ["ids", "agrees", "decoded"][: 2 + decoded]
    schema = plain.select(*[f"c{k}" for k in kept], *[F.lit(None).cast(t).alias(c) for c, t in zip(new, ("array<int>", "boolean", "string"))]).schema

    def run(batches):
        pieces = PieceModel(model.value)
        for b in batches:
            for rows in _slices(b, at):
                found, agrees = pieces.encode(list(each_text(rows.column(at))))
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                out = [ids, pa.array(agrees, pa.bool_()), *[pa.array(map(pieces.decode, found), pa.string())] * decoded]
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in kept] + out, [f"c{k}" for k in kept] + new)

    return plain.mapInArrow(run, schema).toDF(*[docs.columns[k] for k in kept], *new)
