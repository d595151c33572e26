import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bindery.llm import lines, mixing, queries, shards, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, m double"


def docs_of(spark, texts, source="a"):
    """Documents with extra columns that clash with names used inside the operators."""
    rows = [(i, t, "en", source if isinstance(source, str) or source is None else source[i], 1, "x", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- line deduplication ---


def dropped_by_hand(texts, min_docs):
    strip, key = " \t\n\x0b\x0c\r", lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    assert strip
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if found[key(x)] < min_docs) for t in texts]


@pytest.mark.parametrize("n_batches", [1, 5])
def test_lines_match_brute_force(spark, n_batches):
    r = random.Random(3)
    pool = ["A line", "a LINE\t", "É", "é", "", " ", "x" * 50_000, "l\x0b", "L"]
    texts = [None, "", "\n\n", *("\n".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(60))]
    docs = docs_of(spark, texts)
    batches = [docs.where(F.col("doc_id") % n_batches == k) for k in range(n_batches)]
    out = {x.doc_id: x for x in lines.drop_frequent_lines(docs, batches, min_docs=12, fanout=2).collect()}
    want = dropped_by_hand(texts, 12)
    for i, t in enumerate(texts):
        assert out[i].text == want[i] and out[i].n_lines == len((t or "").split("\n"))
        assert out[i].n_lines - out[i].n_dropped == (len(want[i].split("\n")) if out[i].n_dropped < out[i].n_lines else 0)


def test_lines_of_shared_ids_and_long_documents(spark):
    """A third of the rows with a null id, ids that are repeated with other texts, and a document of many frequent lines."""
    texts = ["hot\n" + f"own {k}" for k in range(40)] + [None] * 3 + ["a\nhot\n" + "\n".join(["hot", "HOT "] * 30_000) + "\nend"]
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 5))
    docs = docs.union(docs.where("text like 'hot%'"))
    out = lines.drop_frequent_lines(docs, min_docs=10)
    every = [x.text for x in docs.collect()]
    got = sorted(x.text for x in out.collect())
    assert got == sorted(dropped_by_hand(every, 10)) and "a\nend" in got
    assert sorted(x.n_dropped for x in out.collect())[-1] == 60_001


def test_registered_query_goes_through_the_runs(spark, sf, monkeypatch):
    """One file makes five runs and a compaction, and later batches are anti-joined with settled keys."""
    stored, store = [], lines.LineRuns._store

    def seen(self, df, level):
        stored.append((level, bool(self.runs())))
        return store(self, df, level)

    monkeypatch.setattr(lines.LineRuns, "_store", seen)
    out = {x.doc_id: x.n_dropped for x in queries.op1_line_dedup(spark, sf).collect()}
    assert [x[0] for x in stored].count(0) == 5 and (1, False) in stored and stored[1] == (0, True)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dropped_by_hand([x.text for x in docs], 10)
    assert out == {x.doc_id: len(x.text.split("\n")) - (len(w.split("\n")) if w else 0) for x, w in zip(docs, want)}


def test_runs_are_compacted_and_new_lines_are_new(spark):
    runs = lines.LineRuns(settled_at=2, fanout=2)
    for k in range(5):
        runs.add(docs_of(spark, [f"only {k}", "same"]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 1
    assert runs.new_lines(docs_of(spark, ["only 3", "never seen"])).count() == 1


def test_lines_of_no_documents(spark):
    assert lines.drop_frequent_lines(docs_of(spark, []).limit(0)).count() == 0


# --- SimHash ---


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_hand(fps, radius=3):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def near_fingerprints(r, groups=40):
    keys = set()
    for _ in range(groups):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 25])):
            keys.add(x)
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
    return list(keys)


def test_simhash_groups_match_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn op".split()) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(12)]
    texts = [None, "", " \n", "one", "ONE", "two words", "É x y z", *base, *(t.replace("9", "8", 1) for t in base), *base[:3], "w " * 40_000]
    got = {x.doc_id: x for x in simhash.near_duplicate_groups(docs_of(spark, texts)).collect()}
    fps = [fingerprint_by_hand(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == components_by_hand(fps)
    assert got[0].fp == 0 and got[2].component_id == 0


@pytest.mark.parametrize("split_above", [10_000, 2])
def test_shards_lose_no_link(spark, split_above):
    keys = near_fingerprints(random.Random(7))
    signed = [(k - 2**64 if k >= 2**63 else k,) for k in keys]
    roots = simhash.components(simhash.near_links(spark.createDataFrame(signed, "fp long"), split_above=split_above)).collect()
    label = {x.node: x.root for x in roots}
    got = [label.get(k[0], k[0]) for k in signed]
    want = components_by_hand(keys)
    pairs = lambda x: {frozenset(i for i, v in enumerate(x) if v == w) for w in set(x)}
    assert pairs(got) == pairs(want)


@pytest.mark.parametrize("shared_bits, split_above", [(0, 1), (28, 1), (28, 3), (52, 2)])
def test_crowded_shards_are_cut_again(shared_bits, split_above):
    """Keys that agree in many bits, apart and in balls, with few visits allowed: no link is lost and none invented."""
    r = random.Random(shared_bits)
    keys = {r.getrandbits(64 - shared_bits) for _ in range(300)} | {x >> shared_bits for x in near_fingerprints(r, 15)}
    keys = np.array(sorted(keys), np.uint64)
    links = simhash.shard_links(keys, 3, split_above)
    label = {int(k): int(k) for k in keys}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[root(a)] = root(b)
    want = components_by_hand([int(k) for k in keys])
    got = [root(int(k)) for k in keys]
    groups = lambda x: {frozenset(i for i, v in enumerate(x) if v == w) for w in set(x)}
    assert groups(got) == groups(want)


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "u long, v long")
    got = {x.node: x.root for x in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[901] == 900 and len(got) == 201


def test_one_document_of_each_group_stays(spark):
    docs = docs_of(spark, ["a b c d", "A B C D", "x y z", None, None]).union(docs_of(spark, ["a b c d"]))
    docs = docs.withColumn("doc_id", F.when(F.col("text").isNotNull(), F.col("doc_id")))
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.text or "") for x in kept.collect()) == [(-1, ""), (0, "a b c d"), (2, "x y z")]
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0


# --- sharding ---


def test_shards_are_even_and_places_have_no_gaps(spark, sf):
    out = queries.op8_sharding(spark, sf).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.02 * load.mean() + out["size"].min()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shard_edge_cases(spark):
    docs = docs_of(spark, [None, "", "é", "é"]).union(docs_of(spark, [None])).withColumn("doc_id", F.nullif("doc_id", F.lit(3)))
    out = shards.shard_documents(docs, 3).collect()
    assert len(out) == 5 and sorted(x.size for x in out) == [1, 1, 1, 3, 3]
    assert {x.text_crc32 for x in out if x.size == 1} == {0}
    assert shards.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shared, same_text", [(5, False), (None, False), (5, True), (None, True)])
def test_shards_are_even_if_a_third_shares_one_id(spark, shared, same_text):
    n = 6000
    texts = ["x" * 60 if same_text and k % 3 == 0 else f"{k} " + "y" * (k % 90) for k in range(n)]
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(shared)).otherwise(F.col("doc_id")))
    out = shards.shard_documents(docs, 8, n_slots=256).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(out) == n and len(load) == 8 and load.max() - load.min() <= 0.02 * load.mean()
    assert sorted(out["size"]) == sorted(len(t) + 1 for t in texts)
    assert out.groupby("virtual_slot").size().max() < n / 30
    for _, part in out.groupby("shard"):
        assert sorted(part["place"]) == list(range(len(part)))


def test_rebalance_moves_few_slots():
    r = random.Random(1)
    sizes = [(s, r.randint(1, 1000), 3) for s in range(4096)]
    old = shards.first_map(sizes, 8)
    new = shards.rebalance(old, sizes, 9)
    moved = [s for s in old if old[s] != new[s]]
    load = Counter()
    for s, b, _ in sizes:
        load[new[s]] += b
    assert max(load.values()) <= 1.02 * sum(load.values()) / 9
    assert {new[s] for s in moved} == {8} and len(moved) < 4096 / 6
    assert set(shards.rebalance(new, sizes, 5).values()) == set(range(5))


def test_query_edits_the_map(spark, sf, monkeypatch):
    """Rows go by version 2: slots, sums and places from the definition; most slots stay where version 1 has them."""
    stored, store = [], shards.store_map
    monkeypatch.setattr(shards, "store_map", lambda spark, versions, path: stored.append(versions) or store(spark, versions, path))
    out = queries.op8_sharding(spark, sf).collect()
    first, second = stored[0]
    assert {r[0] for r in first} == {1} and {r[0] for r in second} == {2}
    assert all(s * 8 // shards.N_SLOTS == k for _, s, k, _ in first)
    slot_shard = {s: k for _, s, k, _ in second}
    size, rows = Counter(), defaultdict(list)
    for x in out:
        size[x.virtual_slot] += x["size"]
        rows[x.virtual_slot].append(x)
    assert set(size) == set(slot_shard) and all(x.shard == slot_shard[x.virtual_slot] for x in out)
    moved = sum(a[2] != b[2] for a, b in zip(first, second))
    assert 0 < moved < len(first) / 2
    assert shards.rebalance({s: k for _, s, k, _ in first}, [(s, b, len(rows[s])) for s, b in size.items()], 8, 0.0005) == slot_shard
    placed = Counter()
    for s in sorted(slot_shard):  # a slot's rows stand together, slot after slot
        at = sorted(x.slot for x in rows[s])
        assert at == list(range(placed[slot_shard[s]], placed[slot_shard[s]] + len(at)))
        placed[slot_shard[s]] += len(at)


def test_a_later_run_edits_the_stored_map(spark, tmp_path):
    """Over a grown table the next version moves few slots; versions before it stay readable as they were."""
    path = str(tmp_path / "map")
    r = random.Random(5)
    texts = ["x" * r.randint(1, 400) for _ in range(3000)]
    found = []
    for n, n_shards in ((2000, 4), (2400, 4), (3000, 5)):
        out = shards.shard_documents(docs_of(spark, texts[:n]), n_shards, 512, 0.01, path).toPandas()
        load = out.groupby("shard")["size"].sum()
        assert len(out) == n and len(load) == n_shards and load.max() <= 1.02 * load.mean()
        for _, part in out.groupby("shard"):
            assert sorted(part["place"]) == list(range(len(part)))
        found.append({x.version: {} for x in shards.read_map(spark, path).select("version").distinct().collect()})
        for x in shards.read_map(spark, path).collect():
            found[-1][x.version][x.slot] = (x.shard, x.first)
        newest = found[-1][max(found[-1])]
        assert all(newest[s][0] == k for s, k in zip(out["virtual_slot"], out["shard"]))
    assert [sorted(f) for f in found] == [[1, 2], [1, 2, 3], [1, 2, 3, 4]]
    assert all(found[2][v] == found[k][v] for k in (0, 1) for v in found[k])
    moved = lambda a, b: sum(a[s][0] != b[s][0] for s in a if s in b)
    assert moved(found[2][2], found[2][3]) < 512 / 10 and moved(found[2][3], found[2][4]) < 512 / 3


def test_sizes_and_sums_of_all_texts(spark, sf):
    import zlib

    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op8_sharding(spark, sf).collect()
    assert len(out) == len(texts)
    for x in out:
        raw = texts[x.doc_id].encode()
        assert (x["size"], x.text_crc32, x.law, x.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_best_exchange_is_the_best(n):
    r = random.Random(n)
    for _ in range(50):
        high, low = (sorted((r.randint(1, 60), s) for s in range(k, k + n)) for k in (0, 100))
        gap = r.randint(0, 80)
        found = shards.best_exchange(high, low, gap)
        left = lambda a, b: abs(gap - 2 * (a - b))
        best = min([gap, *(left(a, 0) for a, _ in high), *(left(a, b) for a, _ in high for b, _ in low)])
        sizes = {s: b for b, s in high + low} | {None: 0}
        assert (gap if found is None else left(sizes[found[0]], sizes[found[1]])) == best


# --- mixing ---


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, todo, out = sum(sizes.values()), set(names), {}
    while todo:
        share = {s: left * w[s] / sum(w[x] for x in todo) for s in todo}
        over = {s for s in todo if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        todo -= over
    return out


def test_mix_meets_targets(spark):
    r = random.Random(2)
    source = [r.choice(["b", "b", "b", "b", "a", None, "z"]) for _ in range(900)] + ["empty"]
    texts = ["w " * r.choice([1, 3, 3, 10, 200]) for _ in range(898)] + [None, "", " "]
    docs = docs_of(spark, texts, source).repartition(7)
    out = mixing.mix(docs, piece=16).collect()
    size = defaultdict(int)
    for s, t in zip(source, texts):
        size[s] += len((t or "").split())
    want = targets_by_hand(size)
    assert len(out) == len(texts)
    for s in size:
        mine = [x for x in out if x.source == s]
        assert all(math.isclose(x.target, want[s], rel_tol=1e-9) and x.source_size == size[s] for x in mine)
        assert abs(sum(x["copies"] * x["size"] for x in mine) - want[s]) <= 100
        assert all(0 <= x["copies"] <= 3 for x in mine)
    again = mixing.mix(docs.repartition(3), piece=16).collect()
    assert {x.doc_id: x["copies"] for x in out} == {x.doc_id: x["copies"] for x in again}


def test_mixed_documents_repeat_rows(spark):
    texts = ["w " * k for k in range(1, 60)]
    docs = docs_of(spark, texts, ["a" if i % 4 else "b" for i in range(59)])
    docs = docs.union(docs.where("doc_id < 20"))
    copies = defaultdict(int)
    ident = docs.select("doc_id", "source", "text")
    for x in mixing.mix(ident).collect():
        copies[x.doc_id] += x["copies"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    tokens = lambda rows: sum(len(x.text.split()) for x in rows)
    assert abs(tokens(mixed.collect()) - tokens(docs.collect())) <= 120
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def rates_by_hand(cells, target, most=3):
    """Rates of the entropy balance of one source, its dual solved by bisection."""
    total, docs = sum(s * n for s, n in cells.items()), sum(cells.values())
    mean, low, high = total / docs, -1e4, 1e4
    rate = lambda m, s: 1.0 if s == 0 else min(most, math.exp(min(60, m * s / mean)))
    for _ in range(200):
        m = (low + high) / 2
        low, high = (low, m) if sum(s * n * rate(m, s) for s, n in cells.items()) > target else (m, high)
    return {s: most if target >= most * total and s else rate(low, s) for s in cells}


def test_rates_match_a_solver(spark):
    r = random.Random(41)
    cells = {x: Counter(r.choice([0, 1, 5, 40, 41, 300, r.randint(1, 9000)]) for _ in range(n)) for x, n in (("a", 500), ("b", 60), (None, 900), ("c", 7), ("empty", 0))}
    cells["empty"] = Counter({0: 5})
    table = spark.createDataFrame([(x, s, n) for x, c in cells.items() for s, n in c.items()], "source string, size long, n long")
    targets = mixing.source_targets(table)
    want = targets_by_hand({x: sum(s * n for s, n in c.items()) for x, c in cells.items()})
    found = {t.source: t.target for t in targets.collect()}
    assert set(found) == set(want) and all(math.isclose(found[x], want[x], rel_tol=1e-9) for x in want)
    got = mixing.tilted_rates(table, targets).collect()
    for x, c in cells.items():
        by_hand = rates_by_hand(c, want[x])
        for row in (g for g in got if g.source == x):
            assert abs(row.rate / mixing.UNIT - by_hand[row["size"]]) < 1e-4
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.tilted_rates(table, targets, max_steps=0)


def test_targets_of_many_sources(spark):
    """Running sums go over ranges: hundreds of sources, ties and empty ones included."""
    r = random.Random(42)
    sizes = {f"s{k:04}": r.choice([0, 10, 10, 1000, r.randint(1, 10**6)]) for k in range(400)} | {None: 77}
    cells = spark.createDataFrame([(x, s, 1) for x, s in sizes.items()], "source string, size long, n long").repartition(9)
    want = targets_by_hand(sizes)
    got = {t.source: t.target for t in mixing.source_targets(cells).collect()}
    assert set(got) == set(want) and all(math.isclose(got[x], want[x], rel_tol=1e-9, abs_tol=1e-9) for x in want)


def test_mix_if_half_share_one_id_or_row(spark):
    texts = ["same text of six words here" if k % 2 else "w " * (1 + k % 50) for k in range(600)]
    docs = docs_of(spark, texts, ["a" if k % 3 else "b" for k in range(600)])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    found = mixing.mix(docs, piece=16)
    out = found.collect()
    assert len(out) == 600 and all(abs(x.error) < 0.02 for x in mixing.mix_report(found).collect())
    again = mixing.mix(docs.repartition(5), piece=16).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    mixed = mixing.mixed_documents(docs, piece=16).collect()  # 200 equal rows and more are dealt out in lots
    assert len(mixed) == sum(x.copies for x in out)
    assert Counter(x.source for x in mixed) == sum((Counter({x.source: x.copies}) for x in out), Counter())
