import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import charlm, decontaminate, html, langid, lines, lm, mixing, quality, queries, shards, simhash, toxicity, wordhash
from test_dedup_shard_mix import docs_of

# --- word hashes ---


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    words = [b"a", "é".encode(), b"xyz" * 50, b"a", b"b"] * 300
    plain = wordhash.word_hashes(words)
    monkeypatch.setattr(wordhash, "RUN", 500)
    assert (wordhash.word_hashes(words) == plain).all()
    assert len(set(plain.tolist())) == 4 and plain[0] == plain[3]
    assert len(wordhash.word_hashes([])) == 0
    grams = wordhash.ngram_hashes(plain, 3)
    assert len(grams) == len(words) - 2 and grams[0] == grams[5] and len(set(grams.tolist())) == 5


# --- decontamination ---


def held_by_hand(texts, items, threshold=0.8):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    out = set()
    for i, t in enumerate(texts):
        own = shingles(t)
        for j, x in enumerate(items):
            theirs = shingles(x)
            if theirs and len(own & theirs) >= threshold * len(theirs):
                out.add((i, j, len(own & theirs), len(theirs)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_matches_brute_force(spark, block_bytes):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 20, 50]))) for _ in range(25)] + [None, "", "!?", "É one-two"]
    items.append(items[0])
    texts = [None, "", "w1", items[0], "é ONE two"]
    for k in range(80):
        words = [r.choice(vocabulary) for _ in range(r.choice([2, 10, 300]))]
        item = (items[r.randrange(25)]).split()
        for _ in range(r.choice([0, 0, 1, 2, 9])):
            item[r.randrange(len(item))] = "changed"
        at = r.randrange(len(words) + 1)
        texts.append(", ".join([*words[:at], *item, *words[at:]]).upper())
    docs = docs_of(spark, texts).repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark, block_bytes=block_bytes)
    want = held_by_hand(texts, items)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 20
    clean = decontaminate.without_contaminated(docs, benchmark, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_pieces_hold_every_shingle(monkeypatch):
    r = random.Random(3)
    for size in (1, 7, 30, 400):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        for n_words in (0, 1, 3, 5, 6, 60):
            text = "".join(r.choice(["Abc", "é", "x_1", "long" * 9]) + r.choice([" ", ", ", "-\n"]) for _ in range(n_words))
            words = decontaminate.words_of(text)
            got = [tuple(p[k : k + 5]) for p in decontaminate.pieces(text) for k in range(max(1, len(p) - 4))]
            assert sorted(got) == sorted(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)) if words)
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    item = " ".join(f"w{k}" for k in range(40))
    index = decontaminate.ItemIndex([(1, item), (2, "just two"), (3, "a b c d e f")])
    assert index.matches("x " * 300 + item + " y" * 300) == [(1, 36, 36)] and index.matches("so just two here") == []
    assert index.matches("Just two") == [(2, 1, 1)]


@pytest.mark.parametrize("kind", ["int", "string", "long", "date"])
def test_item_ids_of_any_type(spark, kind):
    text = "one two three four five six seven"
    items = spark.createDataFrame([(1, text), (2, text), (None, text)], "item_id long, text string")
    items = items.withColumn("item_id", F.date_add(F.lit("2020-01-01"), F.col("item_id").cast("int")) if kind == "date" else F.col("item_id").cast(kind))
    docs = docs_of(spark, [text, None]).withColumn("doc_id", F.col("doc_id").cast("int"))
    found = decontaminate.contaminated(docs, items)
    assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert {x.item_id for x in found.collect()} == {x.item_id for x in items.collect()}


# --- HTML ---

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id=wrap><aside class=sidebar><p>Side</p></aside>
<article><h1>Title &amp; more</h1><p>First   paragraph of some length, with <b>bold</b> and <a href=#>a link</a>.<p>Second&nbsp;paragraph&#33; It is long enough.
<div class="ad">Buy</div><ul><li>Point one<li>Point two</ul><p>Short.</p><p>Line<br>break and <em>much</em> more text to be read here.</p>
<form><input value=x>Subscribe</form><section class="comments"><article class=comment><p>First!</p></article></section></article></div>
<footer><p>&copy; Site</p></footer></body></html>"""
TEXT = """Title & more
First paragraph of some length, with bold and a link.
Second paragraph! It is long enough.
Point one
Point two
Short.
Line break and much more text to be read here."""


def test_main_text():
    assert html.main_text(PAGE) == TEXT
    assert html.main_text(PAGE.replace("<article>", "<div class=content>", 1).replace("</article></div>", "</div></div>")) == TEXT
    assert html.main_text('<div class="post-header"><h1>T</h1></div><div class=site-header>S</div><p>Some longer text here.</p>') == "T\nSome longer text here."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("<p>Only this") == "Only this"
    cut = html.main_text(PAGE[: PAGE.index("Point two")])
    assert TEXT.startswith(cut) and "Point one" in cut
    assert len(html.main_text("<article>" + "<p>word " * 20_000)) == 5 * 20_000 - 1


@pytest.mark.parametrize(
    "opened, closed",
    [
        ("<div class='layout with-sidebar'>", "</div>"), ("<main class='no-sidebar'>", "</main>"), ("<article class='post has-comments'>", "</article>"),
        ("<div class='col social'>", "</div>"), ("<form action=/>", "</form>"), ("<form><div id=widget><main class=social>", "</main></div></form>"),
        ("<article><div class='entry share'>", "</div></article>"), ("<span class=related><div>", "</div></span>"),
    ],
)
def test_layout_names_keep_the_article(opened, closed):
    body = "".join(f"<p>Paragraph {k} of an article that has some length.</p>" for k in range(8))
    want = "\n".join(f"Paragraph {k} of an article that has some length." for k in range(8))
    rest = "<div class=cookie-notice>We use cookies here.</div><div class='box sidebar'>Side</div><section id=comments><p>First!</p></section>"
    assert html.main_text(f"<body>{rest}{opened}{body}{closed}</body>") == want
    assert html.main_text(f"<body>{opened}{body}{rest}{closed}<footer>Foot</footer></body>") == want
    assert html.main_text("<article><p>Short text.</p></article><section class=comments>" + "<p>A long comment on this.</p>" * 50 + "</section>") == "Short text."


@pytest.mark.parametrize("tag", ["div", "section", "article"])
def test_split_article_is_whole(tag):
    part = lambda a, b: f"<{tag}>" + "".join(f"<p>Paragraph {k} of an article that has some length.</p>" for k in range(a, b)) + f"</{tag}>"
    want = "\n".join(f"Paragraph {k} of an article that has some length." for k in range(10))
    assert html.main_text(f"<body><nav>Home</nav><div>{part(0, 7)}{part(7, 10)}</div><footer>Foot</footer></body>") == want


STORY = "".join(f"<p>Paragraph {k} of a story that runs on for a good while and then says something more.</p>" for k in range(6))
TOLD = "\n".join(f"Paragraph {k} of a story that runs on for a good while and then says something more." for k in range(6))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><main><article>{}</article></main></div>", "<article class='post no-comments has-share'>{}</article>",
        "<main class='site-main has-sidebar'>{}</main>", "<div>{}</div><div class='related-posts ad-slot-3'>Buy</div>",
        "<div><a href=/>Home</a></div><div><a href=/n>News</a></div><div><a href=/s>Sport today</a></div>{}<div><a href=/>Up</a></div><div><a>Top</a></div>",
        "<div><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><div>{}</div>", "<article>{}<section class=alert>Sign in</section><div id=comments>Hi</div></article>",
        "<article>{}<div class='post-comments'><p>Nice.</p></div></article><table><tr><td><a>x</a><td><a>y</a></table>",
    ],
)
def test_names_and_unnamed_menus(page):
    assert html.main_text(f"<body>{page.format(STORY)}</body>") == TOLD


@pytest.mark.parametrize(
    "page, before, after",
    [
        ("<div class=top><h1>Title</h1><p>Lead of the story, which is about as long as a paragraph.</p></div><div class=story>{}{}</div>", ["Title", "Lead of the story, which is about as long as a paragraph."], []),
        ("<div><h1>Title</h1></div><div>By A. Writer</div><div class=text>{}{}</div><div>The end of the story, which comes in a box of its own.</div>", ["Title", "By A. Writer"], ["The end of the story, which comes in a box of its own."]),
        ("<div><a href=/>Home</a></div><div><a href=/n>News</a></div><div class=text>{}{}</div><div>Imprint</div>", [], []),
        ("<div class=text>{}{}</div><div class=kommentare>" + "<p>A reader has this to say.</p>" * 4 + "</div>", [], []),
        ("<p>Kurz.</p><div aria-hidden=true><h2>Shown</h2></div><div>{}{}</div>", ["Shown"], []),
    ],
)
def test_parts_beside_the_story_s_element(page, before, after):
    told = TOLD + "\n" + TOLD
    got = html.main_text(f"<body>{page.format(STORY, STORY)}</body>").removeprefix("Kurz.\n")
    assert got == "\n".join([*before, told, *after])


@pytest.mark.parametrize(
    "page", ["<nav>Home</nav><div class=sidebar><p>Most read</p><p>Sign up for our letter, it comes every day of the week</p></div>", "<div class=cookie>We use cookies.</div>",
             "<header><h1>Site</h1></header><footer>End</footer>", "<form><input>Search</form>", "<script>x</script><p hidden>no</p>"])
def test_a_page_of_boilerplate_is_empty(page):
    assert html.main_text(f"<body>{page}</body>") == ""


def test_pages_of_no_rows_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x", 2), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((x.page_id or 0, x.url, x.text) for x in html.extract(rows).collect()) == [(0, None, ""), (1, "u", TEXT)]
    assert html.extract(rows.limit(0)).count() == 0


def test_anchors_and_links_of_an_article_stay():
    page = "<article>{}<h2 id='related-work'>Related</h2><section id=alerts><h3 id=share>Alerts</h3>{}</section><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></article>"
    assert html.main_text(page.format(STORY, STORY)) == "\n".join([TOLD, "Related", "Alerts", TOLD, "One", "Two"])
    one = STORY + "<div><a href=/s>Source</a></div>"  # a single line of links is no menu
    assert html.main_text(f"<body>{one}</body>") == TOLD + "\nSource"


@pytest.mark.parametrize("part", ["<div>x ", "<div class=ad>x ", "<article>x ", "<b>x </i><div>", "<p><i>x</p></b>", "<div>x</section>", "<table><tr><td>x", "<li>x"])
def test_deep_pages_take_linear_time_and_memory(part):
    def cost(n):
        tracemalloc.start()
        start = time.process_time()
        html.main_text("<i>" + part * n)
        took, peak = time.process_time() - start, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return took, peak

    cost(500)
    (t1, m1), (t8, m8) = cost(4000), cost(32_000)
    assert m8 < 12 * m1 and m8 < 100e6 and t8 < 20 * t1 + 1


def test_extract_keeps_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.page_id or 0, x.text) for x in got) == [(0, ""), (1, TEXT), (1, TEXT), (3, "")]


def test_pages_of_the_tables(spark, sf):
    for r in queries.op5_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r.html, re.S)[1]
        import html as h

        parts = h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)[^>]*>", "\n", body))).split("\n")
        assert r.text == "\n".join(x for x in (" ".join(p.split()) for p in parts) if x) and r.n_chars == len(r.text)


# --- toxicity ---


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Some Text é with words " * 40
    plain = np.sort(np.concatenate(list(toxicity.features(text))))
    monkeypatch.setattr(toxicity, "RUN", 64)
    assert (np.sort(np.concatenate(list(toxicity.features(text)))) == plain).all()


def test_toxicity_held_out(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    texts, toxic = [], []
    for k in range(900):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        toxic.append(int(k % 4 == 0))
        if toxic[-1]:
            for _ in range(max(3, len(words) // 12)):
                words[r.randrange(len(words))] = r.choice(["zorgle", "zorgling", "vexum"])
        texts.append(" ".join(words))
    texts += [None, "", "word " * 100_000]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    held_out = [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(900)]
    learn = labels.where("doc_id is null").union(labels.where(F.col("doc_id").isin([k for k in range(900) if not held_out[k]])))
    got = {x.doc_id: x.score for x in toxicity.score(docs, learn).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    right = [(got[k] >= 0.7) == bool(toxic[k]) for k in range(900) if held_out[k]]
    assert sum(right) >= 0.97 * len(right)
    kept = toxicity.without_toxic(docs, learn)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {k for k, s in got.items() if s < 0.7}
    none = toxicity.score(docs, learn.where("toxic = 1")).agg(F.max("score")).first()[0]
    assert none == 0 and toxicity.score(docs.limit(0), learn).count() == 0


def test_toxicity_sample_is_bounded(spark):
    docs = docs_of(spark, ["a"] * 3000)
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)], "doc_id long, toxic int")
    assert 350 < toxicity._labelled(docs, labels, 500).count() < 650


def test_repeated_ids_do_not_outgrow_the_sample(spark):
    docs = docs_of(spark, [f"text {k}" for k in range(3000)]).withColumn("doc_id", F.when(F.col("doc_id") < 2500, 7).otherwise(F.col("doc_id")))
    docs = docs.union(docs.where("doc_id = 7"))
    labels = spark.createDataFrame([(k, k % 2) for k in [7, 7, *range(2500, 2700)]], "doc_id long, toxic int")
    rows = toxicity._labelled(docs, labels, 300).collect()
    assert 200 < len(rows) < 420 and len({(x.toxic, x.text) for x in rows}) == len(rows)
    assert max(sum(x.part == k for x in rows) for k in range(5)) < len(rows) / 3


def trained_by_hand(parts, bits, judged):
    """The classifier from its definition, one n-gram after the other, over the given parts of the sample."""
    space = 1 << bits

    def feature(gram):
        h = 0
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
            h ^= h >> 29
        return h * 0xBF58476D1CE4E5B9 % (1 << 64) >> 64 - bits

    def shared(text):
        line = " " + " ".join((text or "").lower().split()) + " "
        grams = [feature(line[k : k + n]) for n in (4, 5, 6) for k in range(len(line) - n + 1)]
        return {f: n * toxicity.SCALE / max(toxicity.LEAST, len(grams)) for f, n in Counter(grams).items()}

    rows = [[(y, shared(t)) for y, t in part] for part in parts]
    n = [sum(y == label for part in rows for y, _ in part) for label in (0, 1)]
    counts = np.full((2, space), toxicity.PRIOR)
    for part in rows:
        for y, x in part:
            for f, v in x.items():
                counts[y, f] += v * min(n) / n[y]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    weights, bias = np.full(space, 0.1), math.log(n[1] / n[0])
    for _ in range(toxicity.ROUNDS):
        learnt = []
        for part in rows:
            w, total, b, own = weights.copy(), np.ones(space), bias, 1.0
            order = np.random.default_rng(11)
            for _ in range(toxicity.EPOCHS):
                for i in order.permutation(len(part)):
                    y, x = part[i]
                    g = 1 / (1 + math.exp(-(sum(w[f] * v * ratio[f] for f, v in x.items()) + b))) - y
                    for f, v in x.items():
                        step = g * v * ratio[f] + 1e-4 * w[f]
                        total[f] += step * step
                        w[f] -= toxicity.RATE * step / math.sqrt(total[f])
                    own += g * g
                    b -= toxicity.RATE * g / math.sqrt(own)
            learnt.append((len(part), w, b))
        size = sum(x[0] for x in learnt)
        weights, bias = sum(x[0] * x[1] for x in learnt) / size, sum(x[0] * x[2] for x in learnt) / size
    z = np.array([sum(weights[f] * v * ratio[f] for f, v in shared(t).items()) + bias for _, t in judged])
    slope, shift = toxicity.platt(z, np.array([y > 0 for y, _ in judged]))
    return lambda t: 1 / (1 + math.exp(-(slope * (sum(weights[f] * v * ratio[f] for f, v in shared(t).items()) + bias) + shift)))


def test_toxicity_matches_the_definition(spark):
    r = random.Random(21)
    word = lambda bad: r.choice(["vile", "scum", "rot"]) if bad and r.random() < 0.3 else r.choice(["calm", "sea", "Sun", "é", "tree"])
    texts = [" ".join(word(k % 3 == 0) for _ in range(r.randint(5, 30))) for k in range(120)] + [None, "", "vile vile"]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    sample = toxicity._labelled(docs, labels, 1000).collect()
    parts = [sorted((x.toxic, x.text) for x in sample if x.part == k) for k in range(toxicity.PARTS + 1)]
    by_hand = trained_by_hand([p for p in parts[:-1] if p], toxicity.BITS, parts[-1])
    for x in toxicity.score(docs, labels).collect():
        assert math.isclose(x.score, by_hand(texts[x.doc_id]), abs_tol=2e-3)


# --- character language models ---

TINY = charlm.Alphabet(bits=6, order=3, letters=True)


def kneser_ney_by_hand(texts, alphabet, modified=False):
    """Interpolated Kneser-Ney over class sequences, plain or modified, from the definition."""
    n, size = alphabet.order, 1 << alphabet.bits
    grams = Counter()
    for t in texts:
        c = (0,) * (n - 2) + tuple(alphabet.codes(t).tolist())
        grams.update(c[k : k + n] for k in range(len(c) - n + 1))
    levels = {n: grams}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(g):
        if not g:
            return 1 / size
        level = levels[len(g)]
        n1, n2, n3, n4 = (max(1, sum(v == x for v in level.values())) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = {1: y, 2: y, 3: y}
        if modified:
            d = {1: min(max(1 - 2 * y * n2 / n1, 0.1), 0.95), 2: min(max(2 - 3 * y * n3 / n2, 0.1), 1.9), 3: min(max(3 - 4 * y * n4 / n3, 0.1), 2.8)}
        after = {x: v for x, v in level.items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total, own = sum(after.values()), level.get(g, 0)
        left = sum(d[min(v, 3)] for v in after.values())
        return (own - d[min(own, 3)] if own else 0) / total + left / total * p(g[1:])

    return p


def test_model_matches_the_definition():
    texts = ["abra kadabra", "abba", "a b", ""]
    grams, _ = TINY.grams(texts)
    for modified in (False, True):
        model = charlm.estimate({"x": np.unique(grams, return_counts=True)}, TINY, modified)
        p = kneser_ney_by_hand(texts, TINY, modified)
        for text in ("abra", "zebra", "q", "ab ba"):
            codes, _ = TINY.grams([text])
            for g in codes:
                parts = tuple(int(g) >> 6 * k & 63 for k in (2, 1, 0))
                assert math.isclose(math.exp(model.rows(np.array([g], np.uint32))[0, 0]), p(parts), rel_tol=1e-4)
    for modified in (False, True):
        model = charlm.estimate({"x": np.unique(grams, return_counts=True)}, TINY, modified)
        for context in ((0, 1), (1, 2), (9, 9)):
            every = np.array([context[0] << 12 | context[1] << 6 | k for k in range(64)], np.uint32)
            assert math.isclose(np.exp(model.rows(every)).sum(), 1, rel_tol=1e-4)


def test_counts_match_by_hand(spark, monkeypatch):
    texts = ["Abra kadabra é", None, "", "x" * 3000, "a b c"]
    docs = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") > 2, "b").otherwise("a"))
    got = {(x.lang, x.gram): x.n for x in charlm.count_grams(docs, TINY).collect()}
    want = Counter()
    for k, t in enumerate(texts):
        want.update(("b" if k > 2 else "a", int(g)) for g in TINY.grams([t or ""])[0])
    assert got == want


def test_language_id(spark, sf):
    got = queries.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert sum(x.lang == x.lang_pred for x in held) >= 0.98 * len(held)


def test_language_edge_cases(spark):
    texts = ["the cat and the dog", "der hund und die katze", None, "", "12 !?", "the dog", "x" * 100_000]
    docs = docs_of(spark, texts).withColumn("lang", F.get(F.array(F.lit("en"), F.lit("de")), F.col("doc_id").cast("int")))
    got = {x.doc_id: x for x in langid.identify(docs, F.lit(True)).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert got[2].score == 0 and not got[2].accepted and 0.5 <= got[5].score <= 1
    nothing = langid.identify(docs, F.lit(False)).collect()
    assert {x.lang_pred for x in nothing} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def entropy_by_hand(text, alphabet, p):
    """Nats per character of a text."""
    c = (0,) * (alphabet.order - 2) + tuple(alphabet.codes(text).tolist())
    logs = [-math.log(p(c[k : k + alphabet.order])) for k in range(len(c) - alphabet.order + 1)]
    return sum(logs) / len(logs)


def test_language_scores_and_rejection_match_the_definition(spark):
    r = random.Random(31)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    one, two = ["the", "and", "in", "er", "o"], ["der", "und", "ein", "sch", "o"]
    texts = [make(one, 12) for _ in range(8)] + [make(two, 12) for _ in range(8)] + [make(one + two, 2) for _ in range(12)]
    lang = ["en"] * 8 + ["de"] * 8 + ["en", "de"] * 6
    docs = docs_of(spark, texts).withColumn("lang", F.get(F.array(*[F.lit(x) for x in lang]), F.col("doc_id").cast("int")))
    got = {x.doc_id: x for x in langid.identify(docs, F.lit(True), reject_share=0.2).collect()}
    ps = [kneser_ney_by_hand([t for t, x in zip(texts, lang) if x == y], langid.ALPHABET) for y in ("de", "en")]
    ce = np.array([[entropy_by_hand(t, langid.ALPHABET, p) for p in ps] for t in texts])
    truth, chars = np.array([("de", "en").index(x) for x in lang]), np.array([len(t) for t in texts])

    def share(factor):
        z = np.exp(-ce * factor * np.sqrt(chars)[:, None])
        return z / z.sum(axis=1, keepdims=True)

    factor = min(np.geomspace(0.05, 50, 31), key=lambda f: -np.log(np.maximum(share(f)[np.arange(len(truth)), truth], 1e-300)).mean())
    best = share(factor).max(axis=1)
    least = np.quantile(best[ce.argmin(axis=1) == truth], 0.2)
    for k in range(len(texts)):
        assert got[k].lang_pred == ("de", "en")[ce[k].argmin()] and math.isclose(got[k].score, best[k], abs_tol=1e-3)
        assert got[k].accepted == (got[k].score >= least) or abs(best[k] - least) < 1e-3
    assert 0 < sum(not x.accepted for x in got.values()) < len(texts)


def test_language_calibration_reads_every_row(spark):
    """More training rows than any former sample held: the factor and the lowest accepted score are those of all of them."""
    r = random.Random(17)
    pools = {"en": ["the", "and", "in", "er", "o"], "de": ["der", "und", "ein", "sch", "o"]}
    names = [r.choice(["en", "de"]) for _ in range(6000)]
    texts = [" ".join(r.choice(pools[x] if r.random() < 0.8 else ["o", "er", "ein"]) for _ in range(r.randint(1, 9))) for x in names]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, names))], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(docs, F.lit(True), reject_share=0.1).collect()}
    models = charlm.language_models(docs, langid.ALPHABET, False, lambda df: df)
    ce, length, truth = models.cross_entropy(texts), np.sqrt([len(t) for t in texts])[:, None], np.array([models.langs.index(x) for x in names])
    shares = []
    for factor in np.geomspace(0.05, 50, 31):
        z = np.exp((ce.min(axis=1, keepdims=True) - ce) * factor * length)
        shares.append(z / z.sum(axis=1, keepdims=True))
    share = min(shares, key=lambda p: -np.log(p[np.arange(len(truth)), truth] + 1e-300).mean())
    least = np.quantile(share.max(axis=1)[ce.argmin(axis=1) == truth], 0.1)
    assert all(math.isclose(got[k].score, p, rel_tol=1e-9) for k, p in enumerate(share.max(axis=1)))
    assert [got[k].accepted for k in range(len(texts))] == (share.max(axis=1) >= least - 1e-12).tolist()


def test_quantile_is_exact(spark):
    r = np.random.default_rng(3)
    for values in (r.random(700), np.repeat([0.25, 1.0, 0.5], [3, 9, 2]), np.array([0.7])):
        bits = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "bits long")
        for share in (0.0, 0.005, 0.37, 1.0):
            assert math.isclose(langid.quantile(bits, share), np.quantile(values, share), rel_tol=1e-14)
    assert langid.quantile(bits.limit(0), 0.5) == 0.0


def test_languages_of_one_script(spark):
    """Two languages in Cyrillic letters and two in Han, told apart on texts that taught nothing."""
    r = random.Random(13)
    pools = {"ru": "что это как был ые ств ого ени", "uk": "що це як був ії ств ого ння", "zh": "的 是 不 我 一 有 大 在 人 了", "ja": "日 本 国 会 社 時 間 語 学 生"}
    text = lambda x: " ".join("".join(r.choice(pools[x].split()) for _ in range(r.randint(1, 4))) for _ in range(25))
    names = [x for x in pools for _ in range(40)]
    docs = docs_of(spark, [text(x) for x in names]).withColumn("lang", F.get(F.array(*[F.lit(x) for x in names]), F.col("doc_id").cast("int")))
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, F.col("doc_id") % 4 != 2).collect()}
    held = [k for k in range(len(names)) if k % 4 == 2]
    assert sum(got[k] == names[k] for k in held) >= 0.97 * len(held)


def test_letters_above_the_table():
    adlam = "".join(chr(0x1E922 + k % 34) for k in range(40))
    letters = [adlam, "\U00020000\U00020001", "\U0001d400\U0001d401 \U0001d402"]
    for alphabet in (langid.ALPHABET, quality.ALPHABET):
        kinds = [set(alphabet.codes(t)[1:-1].tolist()) for t in letters]
        assert all(len(k) > 1 for k in kinds) and len(kinds[0]) > 20
        assert (1 << alphabet.bits) - 1 in alphabet.codes("\U0001f600") or alphabet.letters
    assert len(langid.ALPHABET.codes("\U0001f600 \U0001f600")) == 1  # no letters: one gap
    texts = {"ff": [adlam], "en": ["the cat and the dog"]}
    counts = {k: np.unique(langid.ALPHABET.grams(v)[0], return_counts=True) for k, v in texts.items()}
    model = charlm.estimate(counts, langid.ALPHABET, modified=False)
    for rows in ([adlam], ["the dog", adlam], ["the cat", adlam, "the dog"], [*letters, "the dog"]):
        langs, scores = langid.classify(model, 5.0, rows)
        assert np.isfinite(scores).all() and [x for t, x in zip(rows, langs) if t == adlam] == ["ff"]
        assert {x for t, x in zip(rows, langs) if t.startswith("the")} <= {"en"}
    uniform = langid.ALPHABET.bits * math.log(2)
    for rows in ([""], ["the dog", ""], ["the dog", "1", "the cat"]):
        ce = model.cross_entropy(rows)
        for t, row in zip(rows, ce):
            assert np.isfinite(row).all() and (t.startswith("the") or np.allclose(row, uniform))


def test_language_of_letters_above_the_table(spark):
    adlam = "\U0001e922\U0001e923\U0001e924 \U0001e925\U0001e926"
    docs = docs_of(spark, ["the cat and the dog", adlam, "der hund und die katze", adlam]).coalesce(1)
    docs = docs.withColumn("lang", F.get(F.array(F.lit("en"), F.lit(None), F.lit("de")), F.col("doc_id").cast("int")))
    got = {x.doc_id: x for x in langid.identify(docs, F.lit(True)).collect()}
    assert len(got) == 4 and got[0].lang_pred == "en" and got[2].lang_pred == "de"
    assert all(0 < x.score <= 1 for x in got.values()) and got[1].score == got[3].score


# --- quality ---


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


def test_base_counts_match_by_hand():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "c ", "é\n", "\n", "#", " ", "\t|", "a b c a b c\n", " "]) for _ in range(r.randint(0, 40)))
        assert quality.base_counts(text) == base_by_hand(text)
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_quality_keeps_clean_and_drops_junk(spark):
    r = random.Random(9)
    syllables = ["ta", "re", "mi", "lo", "sen", "ter", "po"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(120)) + "." for _ in range(120)]
    junk = [" ".join(word() + r.choice(["###", "$$$", "%%%"]) for _ in range(120)) for _ in range(10)]
    shout = [" ".join(word().upper() + "!!" for _ in range(120)) for _ in range(5)]
    bad = [None, "", "too short", "one two three " * 30]
    docs = docs_of(spark, texts + junk + shout + bad)
    got = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert all(got[k].kept for k in range(120)) and not any(got[k].kept for k in range(120, 139))
    assert [got[k].base_failed for k in range(119, 139)] == [False] * 16 + [True] * 4
    rare = docs.withColumn("lang", F.when(F.col("doc_id") == 125, None).otherwise("en"))
    assert {x.doc_id: x.kept for x in quality.assess(rare).collect()}[125]
    assert quality.assess(docs.limit(0)).count() == 0


def test_bands_match_the_definition(spark):
    r = random.Random(17)
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    pools = {"en": ["ta", "re", "mi", "lo"], "": ["ku", "hy", "nen"], None: ["sch", "ein", "und"]}
    texts, langs = [], []
    for x, n in (("en", 30), ("", 25), (None, 6)):
        texts += [" ".join(word(pools[x]) for _ in range(r.randint(50, 90))) for _ in range(n)] + [" ".join(word(pools[x]) + "##" for _ in range(70)) for _ in range(3)]
        langs += [x] * (n + 3)
    texts, langs = texts + ["few words", None], langs + ["en", "xx"]
    docs = docs_of(spark, texts).withColumn("lang", F.get(F.array(*[F.lit(x) for x in langs]), F.col("doc_id").cast("int")))
    got = {x.doc_id: x for x in quality.assess(docs, width=3.0, pooled_chars=2000).collect()}
    assert all(got[k].lang == x for k, x in enumerate(langs))
    base = [base_by_hand(t) for t in texts]
    failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base]
    teach = [k for k, b in enumerate(base) if not failed[k] and b[2] <= 0.02 * b[1] and sum("A" <= c <= "Z" for c in texts[k]) <= 0.3 * b[1]]
    taught = {x: [texts[k] for k in teach if langs[k] == x] for x in ("en", "", None)}
    pooled = kneser_ney_by_hand([texts[k] for k in teach], quality.ALPHABET, True)
    ps = {}
    for x, own in taught.items():
        n = sum(len(quality.ALPHABET.grams([t])[0]) for t in own)
        ps[x] = lambda g, p=kneser_ney_by_hand(own, quality.ALPHABET, True), w=n / (n + 2000): w * p(g) + (1 - w) * pooled(g)
    ppl = {k: entropy_by_hand(t, quality.ALPHABET, ps[langs[k]]) for k, t in enumerate(texts) if base[k][0] and langs[k] in ps}
    middle = lambda values: sorted(values)[(len(values) - 1) // 2]
    mids = {x: middle([ppl[k] for k in teach if langs[k] == x]) for x in ps}
    off = {k: abs(ppl[k] - mids[langs[k]]) for k in teach}
    for k, x in enumerate(langs):
        if k not in ppl:
            assert not got[k].kept and got[k].low is None
            continue
        own = [v for i, v in off.items() if langs[i] == x]
        w = min(1, len(own) / 20)
        reach = 3.0 * max(0.05, 1.4826 * (w * middle(own) + (1 - w) * middle(list(off.values()))))
        assert math.isclose(got[k].log_ppl, ppl[k], rel_tol=1e-4)
        assert math.isclose(got[k].low, mids[x] - reach, rel_tol=1e-3) and math.isclose(got[k].high, mids[x] + reach, rel_tol=1e-3)
        assert got[k].base_failed == failed[k] and got[k].kept == (not failed[k] and mids[x] - reach <= ppl[k] <= mids[x] + reach)
    assert not any(got[k].kept for k, t in enumerate(texts) if t and "##" in t)


def test_counts_of_a_long_text_take_little_memory():
    text = "alpha beta gamma delta " * 400_000  # 9 MB
    tracemalloc.start()
    assert quality.base_counts(text) == (1_600_000, 7_600_000, 0, 0, 1_600_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)


@pytest.mark.parametrize("n_good", [1, 5, 19])
def test_quality_judges_small_languages(spark, n_good):
    r = random.Random(12)
    word = lambda syllables: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    text = lambda syllables, tail="": " ".join(word(syllables) + tail for _ in range(120))
    common, own = ["ta", "re", "mi", "lo", "sen", "ter", "po"], ["ku", "vä", "hy", "jok", "nen", "lla"]
    texts = [text(common) for _ in range(60)] + [text(own) for _ in range(n_good)] + [text(own, r.choice(["###", "$$$"])) for _ in range(30)]
    docs = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 60, "en").otherwise("fi"))
    got = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert all(got[k].kept for k in range(60 + n_good)) and got[60].low is not None
    assert not any(got[k].base_failed or got[k].kept for k in range(60 + n_good, len(texts)))


def test_verdicts_do_not_jump_as_a_language_grows(spark):
    """The same documents, good and junk, with a little less and a little more than 2^16 characters of their language."""
    r = random.Random(21)
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    text = lambda parts, tail="": " ".join(word(parts) + tail for _ in range(150))
    common, own = ["ta", "re", "mi", "lo", "sen", "ter", "po"], ["ku", "vä", "hy", "jok", "nen", "lla"]
    en, fi = [text(common) for _ in range(200)], [text(own) for _ in range(90)]
    probes = [text(own) for _ in range(3)] + [text(own, r.choice(["#", "$$"])) for _ in range(3)] + [text(common)]
    found, chars = [], []
    for least in (62_000, 65_000, 66_500, 70_000):
        n = next(n for n in range(len(fi)) if sum(map(len, fi[:n])) >= least)
        texts = probes + en + fi[:n]
        docs = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id").between(len(probes), len(probes) + len(en) - 1), "en").otherwise("fi"))
        found.append({x.doc_id: x for x in quality.assess(docs).where(F.col("doc_id") < len(probes)).collect()})
        chars.append(sum(len(t) + 1 for t in fi[:n]))
    assert chars[0] < 1 << 16 < chars[-1]
    for a, b in zip(found, found[1:]):
        assert all(abs(a[k].log_ppl - b[k].log_ppl) < 0.02 and a[k].kept == b[k].kept for k in a)
    assert [found[0][k].kept for k in range(6)] == [True] * 3 + [False] * 3


# --- stupid backoff ---


def scores_by_hand(texts, train=None, order=3):
    """Stupid backoff from the definition; without ``train``, each text's own n-grams are left out."""
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def counted(w):
        return Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)) + Counter({(): len(w)})

    every, out = Counter(), []
    for t in texts if train is None else train:
        every.update(counted(cut(t)))
    for t in texts:
        w = cut(t)
        own = counted(w) if train is None else Counter()
        c = lambda g: every[g] - own[g]

        def s(context, x):
            if not context:
                return max(c((x,)), 0.5) / max(c(()), 1)
            return c((*context, x)) / c(context) if c((*context, x)) > 0 else 0.4 * s(context[1:], x)

        logs = [math.log10(s(tuple(w[max(0, k - order + 1) : k]), x)) for k, x in enumerate(w)]
        out.append((len(w), sum(logs) / len(logs) if logs else None))
    return out


@pytest.mark.parametrize("order, group_bytes, bucket_grams", [(3, 8 << 20, 1 << 19), (3, 700, 100), (2, 5000, 300), (4, 3000, 64), (1, 2000, 64)])
def test_backoff_matches_brute_force(spark, order, group_bytes, bucket_grams):
    r = random.Random(10)
    make = lambda n: " ".join(r.choice(["the", "The", "of", "é", *(f"w{k}" for k in range(30))]) for _ in range(n))
    texts = [None, "", " \n", "single", "unseen words here", *(make(r.randint(1, 80)) for _ in range(60)), "the " * 5000]
    texts += [texts[-2], texts[-3]]
    train = [None, *(make(50) for _ in range(40))]
    docs = docs_of(spark, texts).repartition(3)
    for given, counted in ((None, None), (docs_of(spark, train), train), (docs_of(spark, train).limit(0), [])):
        got = lm.stupid_backoff(docs, given, order=order, group_bytes=group_bytes, bucket_grams=bucket_grams)
        got = {x.doc_id: (x.n_words, x.score) for x in got.collect()}
        assert len(got) == len(texts)
        for k, (n, s) in enumerate(scores_by_hand(texts, counted, order)):
            assert got[k][0] == n and (got[k][1] is None if s is None else math.isclose(got[k][1], s, rel_tol=1e-9))
    assert lm.stupid_backoff(docs.limit(0)).count() == 0


def test_backoff_of_repeats_and_null_ids(spark):
    docs = docs_of(spark, ["a b c d e", "x y z", None]).withColumn("doc_id", F.lit(None).cast("long"))
    got = lm.stupid_backoff(docs.union(docs).union(docs.where("text like 'a%'"))).collect()
    assert len(got) == 7 and {x.n_words for x in got} == {5, 3, 0} and len({x.score for x in got if x.n_words == 5}) == 1


def test_a_hot_passage_makes_no_large_bucket(spark):
    """A passage that half of all documents share is added up in each group: no bucket has more rows than groups."""
    passage = " ".join(f"p{k}" for k in range(20))
    docs = docs_of(spark, [passage if k % 2 else f"own{k} text{k} of{k} it{k}" for k in range(3000)])
    dealt, size = lm._grouped(docs, 0, 20_000, True, True)
    sent = dealt.groupBy("g").applyInArrow(lm._requests(3, 48, 8), lm._REQUESTS)
    groups = dealt.select("g").distinct().count()
    assert groups > 4 and sent.groupBy("bucket").count().agg(F.max("count")).first()[0] <= groups
    entries = sent.select("bucket", F.length("n").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    assert entries.n.max() < 2 * entries.n.mean()


def test_packed_columns_are_exact():
    r = random.Random(2)
    for bits in (8, 30, 56):
        grams = np.unique(np.array([r.getrandbits(bits) for _ in range(200)], np.uint64))
        assert (lm.grams_of(int(grams[0]), lm.steps_of(grams), len(grams)) == grams).all()
    one = np.array([7], np.uint64)
    assert (lm.grams_of(7, lm.steps_of(one), 1) == one).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lm.numbers(*lm.small_numbers(counts)) == counts).all()


# --- the pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline
    from bindery.llm import simhash
    from bindery.llm.common import stage

    source = docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf), name)
        kept.append(docs)
        if name != "sharding":
            assert docs.columns == source.columns
    scores = {x.doc_id: x.score for x in queries.op4_toxicity(spark, sf).collect()}
    assert {x.doc_id for x in kept[0].collect()} == {k for k, s in scores.items() if s < 0.7}
    rows = kept[0].collect()
    fps = [simhash.fingerprint(x.text) for x in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            break
        label = new
    groups = defaultdict(list)
    for x, g in zip(rows, label):
        groups[g].append(x.doc_id)
    assert sorted(x.doc_id for x in kept[1].collect()) == sorted(min(g) for g in groups.values())
    rows = kept[1].collect()
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {w[0] for w in held_by_hand([x.text for x in rows], items)}
    assert dirty and {x.doc_id for x in kept[2].collect()} == {x.doc_id for k, x in enumerate(rows) if k not in dirty}
    clean, mixed = kept[2].collect(), kept[3].collect()
    size = {x.doc_id: len(x.text.split()) for x in clean}
    times = Counter(x.doc_id for x in mixed)
    assert max(times.values()) <= 3 and set(times) <= set(size)
    assert abs(sum(size[k] * n for k, n in times.items()) - sum(size.values())) <= 0.2 * sum(size.values())
    assert docs.count() == len(mixed)
    assert spark.read.parquet(f"{sf}/documents.parquet").count() == source.count()


def awkward_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    names = "ident row all h of copies rows piece size target source_size part bucket g shard component_id fp root".split()
    texts = [None, "", " \n ", "one", "same words here again", "same words here again", "word " * 60_000, "x\x00y \U0001e922"]
    texts += [f"clean text number {k} with words w{k} v{k * 7} u{k * 13} and an ending" for k in range(40)]
    rows = [(None if k % 7 == 3 else k // 2, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:12], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = F.create_map(F.lit("k"), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")))
    docs = docs.select("*", *[F.lit(None if k % 2 else "x").cast("string").alias(c) for k, c in enumerate(names)], pairs.alias("m"), F.lit(1).alias("a.b"))
    return docs.select("m", *[f"`{c}`" for c in docs.columns if c != "m"])


def test_pipeline_of_awkward_documents(spark, sf):
    import corpus_pipeline
    from bindery.llm.common import stage

    source = stage(awkward_documents(spark), "awkward")
    docs = source
    for name, function in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(function(spark, docs, sf), name)
        if name != "sharding":
            assert docs.schema == source.schema and docs.count() > 0
        if name in ("toxicity", "decontamination"):
            assert docs.count() == before  # all are clean
    assert sorted(x.slot for x in docs.where("shard = 0").collect()) == list(range(docs.where("shard = 0").count()))


def test_pipeline_of_no_documents(spark, sf):
    import corpus_pipeline
    from bindery.llm.common import stage

    docs = source = stage(awkward_documents(spark).limit(0), "none")
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf), name)
        assert docs.count() == 0 and (name == "sharding" or docs.schema == source.schema)


def test_operators_on_awkward_documents(spark):
    """Each operator gives a row for each document, or its own pairs, whatever the columns hold and are called."""
    docs = awkward_documents(spark)
    n = docs.count()
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)] * 3 + [(None, 1), (4, None)], "doc_id long, toxic int")
    for out in (
        lines.drop_frequent_lines(docs), lm.stupid_backoff(docs), toxicity.score(docs, labels), quality.assess(docs), simhash.near_duplicate_groups(docs),
        shards.shard_documents(docs), mixing.mix(docs), langid.identify(docs, F.lit(True)),
    ):
        assert out.count() == n
    items = spark.createDataFrame([(None, None), ("i", ""), ("j", "same words here again")], "item_id string, text string")
    assert {x.item_id for x in decontaminate.contaminated(docs, items).collect()} == {"j"}
