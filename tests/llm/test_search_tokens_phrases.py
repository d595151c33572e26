import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from bindery.llm import collocations, maxscore, pieces, queries
from test_dedup_shard_mix import docs_of
from test_filters import awkward_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- ranked search ---


def ranked_by_hand(docs, items, k):
    """{item row: [(doc_id, score)]} by the definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    tfs = [Counter(term.findall((t or "").translate(LOWER))) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in tfs), sum(sum(c.values()) for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for text in items:
        scores = []
        for (doc_id, _), tf in zip(docs, tfs):
            score = 0
            for t in term.findall((text or "").translate(LOWER)):
                if tf[t]:
                    m = 75 + 25 * sum(tf.values()) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id))
        out.append([(d, -s) for s, _, d in sorted(scores)[:k]])
    return out


def some_texts(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(12)] * 9 + [f"rare{k}" for k in range(150)] + ["Émile", "ÉMILE", "x_y", "7", "漢字", "A", "a"]
    texts = [None, "", "!?", "\x00\x7f", "one " * 30_000]
    texts += [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 30, 200]))) for _ in range(n)]
    return texts + r.choices(texts[5:], k=n // 4)  # copies, so that scores tie


@pytest.mark.parametrize("shard_bytes, block_bytes, first", [(1 << 23, 1 << 22, 32), (2000, 4000, 1)])
def test_search_matches_brute_force(spark, shard_bytes, block_bytes, first):
    texts = some_texts(1, 120)
    docs = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    items = [None, "", "unknown", "one", "a A É", *random.Random(2).choices(texts[6:60], k=12), "w1 w1 w1 w2 rare1"]
    index = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = maxscore.build_index(index, shard_bytes=shard_bytes).cache()
    asked = spark.createDataFrame([(f"i{k}", t, k) for k, t in enumerate(items)], "item_id string, text string, rank long")
    found = maxscore.search(index, asked, 5, block_bytes=block_bytes, first_shards=first).collect()
    want = ranked_by_hand(docs, items, 5)
    for k in range(len(items)):
        own = sorted((x for x in found if x.item_id == f"i{k}"), key=lambda x: x.rank)
        assert [x.rank for x in own] == list(range(1, len(own) + 1))
        assert [(x.doc_id, x.score) for x in own] == want[k]


def test_pair_bounds_skip_more_than_single_bounds():
    """Two documents hold one heavy term each: the pair's bound is one term's, not two."""
    none = np.zeros(0, np.int64)
    shard = maxscore._Shard(2, np.array([0, 1]), np.array([0, 1, 2]), np.array([0, 1], np.uint16), np.array([100, 100], np.int32), np.array([100, 100]), none, np.zeros(1, np.int64), none, none)
    units = [(0, 7, 1, 7, 0)]
    assert shard.found(units, 700)[0].tolist() == [0, 1]
    assert not len(shard.found(units, 701)[0])  # 1400 by single maxima
    assert shard.found([(0, 7, -1, 0, -1)], 1)[1].tolist() == [700]


def test_rounds_pass_thresholds_on(spark, monkeypatch):
    seen = []
    plain = maxscore.search_lists

    def spy(lists, block, thresholds, *rest):
        seen.append((lists.count(), list(thresholds.value)))
        return plain(lists, block, thresholds, *rest)

    monkeypatch.setattr(maxscore, "search_lists", spy)
    texts = [f"common word{k % 7} x{k}" for k in range(400)]
    index = maxscore.build_index(docs_of(spark, texts).coalesce(1), shard_bytes=600).cache()
    asked = spark.createDataFrame([("i", "common word3")], "item_id string, text string")
    assert maxscore.search(index, asked, 3, first_shards=2).count() == 3
    assert sum(n for n, _ in seen) == index.count() and len(seen) > 1
    assert seen[0][1] == [1] and seen[-1][1][0] > 1


def test_search_of_nothing(spark):
    none = docs_of(spark, [])
    asked = spark.createDataFrame([("i", "word")], "item_id string, text string")
    assert maxscore.ranked(none, asked).count() == 0
    assert maxscore.ranked(docs_of(spark, ["word"]), asked.limit(0)).count() == 0
    assert maxscore.ranked(docs_of(spark, [None, "", "?"]), asked).count() == 0
    assert maxscore.ranked(awkward_documents(spark), asked).count() == 2  # a repeated row


# --- sentence pieces ---


def model_bytes(**changes) -> bytes:
    """The installed vocabulary, with some pieces renamed or of another kind."""
    raw = Path(queries.vocabulary_path()).read_bytes()
    if not changes:
        return raw
    spec = proto.ModelProto()
    spec.ParseFromString(raw)
    for p in spec.pieces:
        if p.piece in changes.get("unused", ()):
            p.type = proto.ModelProto.SentencePiece.UNUSED
        if p.type == proto.ModelProto.SentencePiece.BYTE and not changes.get("fallback", True):
            p.type = proto.ModelProto.SentencePiece.CONTROL
        p.piece = changes.get("renamed", {}).get(p.piece, p.piece)
    spec.trainer_spec.byte_fallback = changes.get("fallback", True)
    return spec.SerializeToString()


def odd_texts(seed=1, n=1500):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "e", "▁", "\n", "\t", "\0", ".", "12", "é", "ß", "漢", "🙂", "　", "ﬁ", "<0x0A>", "</s>", "the", "ing", " of", "́"]
    return [None, "", " ", "\n", "the" * 4000, "a" * 9000, *("".join(r.choice(parts) for _ in range(r.choice([1, 3, 20, 150]))) for _ in range(n))]


@pytest.mark.parametrize(
    "changes", [{}, {"unused": ("▁the", "ing", "▁t", "er")}, {"renamed": {"▁of": "a▁b", "▁to": "e\n"}}, {"fallback": False}], ids=["plain", "unused", "across", "unknown"])
def test_pieces_are_the_library_s(changes):
    model, texts = pieces.PieceModel(model_bytes(**changes)), odd_texts()
    assert model.apart == (not changes or "unused" in changes)
    for a in range(0, len(texts), 400):
        ids, agrees = model.encode(texts[a : a + 400])
        assert all(agrees)
        for t, found in zip(texts[a : a + 400], ids):
            want = model.library.encode(t or "")
            assert found.tolist() == want
            assert model.decode(found) == (model.library.decode(want) if want else "")


def test_short_and_long_agendas_agree():
    model = pieces.PieceModel(model_bytes())
    words = [w for t in odd_texts(5) if t for w in model.words(model.library.normalize(t))]
    ids, sizes = model._spelt_out(*model.merged_together(words))
    ends = np.cumsum(sizes)
    for w, a, b in zip(words, ends - sizes, ends):
        want = [k for s in model.merged(w) for k in ([model.id_of[s]] if s in model.id_of else model.spelt(s))]
        assert ids[a:b].tolist() == want


def test_a_word_that_differs_is_told(monkeypatch):
    model = pieces.PieceModel(model_bytes())
    monkeypatch.setattr(model, "merged_together", lambda words: (np.full(len(words), 5), np.ones(len(words), np.int64)))
    _, agrees = model.encode(["some words", "", None])
    assert agrees == [False, True, True]


def test_forgetting_words_changes_nothing(monkeypatch):
    model, texts = pieces.PieceModel(model_bytes()), odd_texts(7, 300)
    want = [x.tolist() for x in model.encode(texts)[0]]
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 10)
    assert [model.encode([t])[0][0].tolist() for t in texts] == want


def test_tokenise_keeps_rows_and_columns(spark):
    docs = awkward_documents(spark)
    out = pieces.tokenise(docs, queries.vocabulary_path())
    assert out.columns == [c for c in docs.columns if c != "text"] + ["ids", "agrees", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.agrees for r in rows)
    texts = {t or "" for (t,) in docs.select("text").collect()}
    assert {r.decoded for r in rows} == texts  # nothing is lost by this vocabulary
    assert pieces.tokenise(docs.limit(0), queries.vocabulary_path(), decoded=False).count() == 0


# --- collocations ---


def phrases_by_hand(rows, longest, least, top, share):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[a : a + m])) for m in range(1, longest + 1) for a in range(len(words) - m + 1))
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, words), a in some.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                held[lang, words[i : i + m]] = max(held[lang, words[i : i + m]], a)
    out = []
    for lang in n:
        found = []
        for (own, words), a in some.items():
            if own == lang and 100 * held[lang, words] < share * a:
                score, k = min((10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
                found.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest, slot_bits, part", [(3, 27, 1 << 21), (3, 15, 200), (2, 15, 50), (4, 20, 1000)])
def test_phrases_match_brute_force(spark, monkeypatch, longest, slot_bits, part):
    monkeypatch.setattr(collocations, "PART", part)
    r = random.Random(longest)
    common = ["the", "The", "of", "New", "York", "é", "É", "\x1c", "state of the art"]
    texts = [None, "", ".", "no end", "new york " * 5000] + [
        "".join(r.choice(common + [f"u{r.randrange(3000)}"]) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.choice([3, 40, 200]))) for _ in range(120)]
    rows = [(r.choice(["en", "fr", None, "und", ""]), t) for t in texts]
    rows += rows[:20]
    docs = spark.createDataFrame([(*x, 1, "x") for x in rows], "lang string, text string, n long, w0 string")
    found = collocations.collocations(docs, longest, 6, 40, 50, slot_bits=slot_bits)
    assert sorted(tuple(x) for x in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases_by_hand(rows, longest, 6, 40, 50)


def unpacked(batch, bits):
    low = bits - collocations._bucket_bits(bits)
    for at, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        gaps = np.frombuffer(own, np.uint8)
        yield from ((at << low) + np.cumsum(gaps, dtype=np.int64)[gaps != 255]).tolist()


def test_packed_slots_come_back():
    r = np.random.default_rng(5)
    some = [0, 255, 510, 509, 765, 1 << 14, (1 << 15) - 1, (1 << 15) - 1, *[77] * 30]
    for slots in (some, [], [3], r.integers(0, 1 << 15, 3000), np.repeat(r.integers(0, 1 << 15, 9), 50)):
        slots = np.array(slots, np.int32)
        want = sorted(x for x, n in Counter(slots.tolist()).items() for _ in range(min(n, 4)))
        assert list(unpacked(collocations.packed_slots(slots, 4, 15), 15)) == want
    dense = collocations.packed_slots(np.sort(r.integers(0, 1 << 27, 2_000_000)).astype(np.int32), 10, 27)
    assert dense.column(1).nbytes < 1.5 * 2_000_000


def test_full_slots_match_counts(spark, monkeypatch):
    """Texts that a task sends in several runs count together."""
    monkeypatch.setattr(collocations, "HOLD_SLOTS", 1)
    r = random.Random(8)
    texts = [" ".join(f"u{r.randrange(12)}" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    full, words = [], [w.encode() for t in texts for w in [*t.split(), "."]]
    for _ in range(2):
        *_, (goes, slots) = collocations._levels(collocations.word_hashes(words), "en", full, 13, len(full) + 1)
        n = np.bincount(slots[goes], minlength=1 << 13)
        full.append(collocations.full_slots(docs, full, 7, 13))
        assert np.array_equal(np.unpackbits(full[-1], bitorder="little"), (n >= 7).astype(np.uint8)) and (n >= 7).any()


@pytest.mark.parametrize("hold", [1, 5000])
def test_windows_of_several_sendings_add_up(spark, monkeypatch, hold):
    monkeypatch.setattr(collocations, "HOLD_WINDOWS", hold)
    r = random.Random(9)
    rows = [(r.choice(["en", None]), " ".join(r.choice(["a", "b", "c", "d", f"u{r.randrange(50)}"]) for _ in range(30))) for _ in range(90)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(docs, 3, 6, 40, 50, slot_bits=20)
    assert sorted(tuple(x) for x in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases_by_hand(rows, 3, 6, 40, 50)


def shuffled_bytes(spark):
    jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_phrase_counts_shuffle_little(spark):
    """Unlike windows and their slots leave tasks in a few bytes a word."""
    r = random.Random(10)
    words = [f"{chr(97 + k % 26)}{k * 7919 % 9973}" for k in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(5000)) for _ in range(40)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(2)
    before = shuffled_bytes(spark)
    assert collocations.phrase_counts(docs).count()
    sent = sum(n for k, n in shuffled_bytes(spark).items() if k not in before)
    assert 0 < sent < 5 * 200_000, sent


def test_phrases_of_awkward_documents(spark):
    docs = awkward_documents(spark)
    found = collocations.collocations(docs)
    assert "en" in {x.lang for x in found.collect()} <= {"en", "und"}
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    """a * a * 1000000 passes 64 bits."""
    a = 3_000_000_000
    counts = spark.createDataFrame([("en", ["x", "y"], a), ("en", ["x"], a + 1), ("en", ["y"], a + 7), ("en", [], 3 * a)], "lang string, words array<string>, f long")
    from unittest.mock import patch

    with patch.object(collocations, "phrase_counts", lambda *args: counts):
        (row,) = collocations.collocations(docs_of(spark, [])).collect()
    assert row.score == 10**6 * a * a // ((a + 1) * (a + 7)) and (row.l, row.r, row.n) == (a + 1, a + 7, 3 * a)
