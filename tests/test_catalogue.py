import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from bindery.functions import scorers
from bindery.functions import text as X
from bindery.operators import category, cells, clean, emotion, layout, profile, recommend, upkeep, vectors
from bindery.plans import enrich
from bindery.sources import files


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(col.alias("out")).first().out


@pytest.mark.parametrize("text", ["", " ", "a", "  a b ", "a b", "a　b", "a\x1cb", "a\x85b", "a​b", "a\n\tb c"])
def test_words_split_as_python_does(spark, text):
    assert one(spark, X.words(F.col("t")), t=text) == text.split()
    assert one(spark, X.word_count(F.col("t")), t=text) == len(text.split())


def test_text_columns(spark):
    none = F.lit(None).cast("string")
    assert spark.range(1).select(X.word_count(none).alias("x")).first().x is None
    assert one(spark, X.title_and_subtitle(F.col("a"), none), a="T") == "T"
    assert one(spark, X.title_and_subtitle(F.col("a"), F.col("b")), a="T", b="S") == "T: S"
    assert one(spark, X.truncated(F.col("t")), t=" ".join(map(str, range(40)))) == " ".join(map(str, range(30))) + "..."
    assert one(spark, X.truncated(F.col("t")), t="a") == "a..."
    for given, want in (("A", "A"), ("A;B", "A and B"), ("A;B;C", "A, B, and C")):
        assert one(spark, X.author_list(F.col("a")), a=given) == want
    assert one(spark, X.caption(F.col("t"), none, F.col("d")), t="T", d="x y") == "T: x y..."
    assert one(spark, X.caption(F.col("t"), F.col("a"), none), t="T", a="A;B") == "T by A and B"
    for line, want in (('"978 x', 978), ("978", 978), ("foo bar", None), ("", None), ("12x y", None)):
        assert one(spark, X.item_id(F.col("l")), l=line) == want
    assert one(spark, X.sentences(F.col("t")), t="a.b..") == ["a", "b", "", ""]
    assert one(spark, X.large_thumbnail(F.col("u")), u="u") == "u&fife=w800"
    assert spark.range(1).select(X.large_thumbnail(none).alias("x")).first().x == "cover-not-found.jpg"


@pytest.mark.parametrize("text", ["", " ", "\n\n", "\r\n"])
def test_captions_leave_out_a_blank_text(spark, text):
    none = F.lit(None).cast("string")
    assert one(spark, X.caption(F.col("t"), F.col("a"), F.col("d")), t="T", a="A;B", d=text) == "T by A and B"
    assert one(spark, X.caption(F.col("t"), none, F.col("d")), t="", d=text) == ""


def books(spark, rows):
    return spark.createDataFrame(rows, files.CATALOGUE)


def book(i, **more):
    given = dict(isbn13=i, title=f"T{i}", subtitle=None, authors="A", categories="Fiction", thumbnail=None, description="word " * 30, published_year=2000, num_pages=10, average_rating=4.0)
    return tuple((given | more).values())


def test_cleaning_partitions_the_table(spark):
    rows = [book(1), book(2, description=None), book(3, average_rating=None), book(4, description="short"), book(5, subtitle="S")]
    df = books(spark, rows)
    kept, lost = clean.drop_incomplete(df), clean.incomplete_rows(df)
    assert kept.count() + lost.count() == 5 and kept.intersect(lost).count() == 0
    cleaned = {r.isbn13: r for r in clean.clean_catalogue(df).collect()}
    assert set(cleaned) == {1, 5} and cleaned[5].title_and_subtitle == "T5: S" and cleaned[1].description_with_id.startswith("1 word")
    assert clean.retention(df).first().retained_share == 0.6
    assert clean.retention(df.limit(0)).first().retained_share is None


def test_csv_fields(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('isbn13,title,subtitle,authors,categories,thumbnail,description,published_year,num_pages,average_rating\n'
                    '1,"a ""quoted"" b",NA,none,n/a,null,"two\nlines",2001.0,7,3.5\n2,T,,None,c,u,"",x,,nan\n')
    got = files.read_csv(spark, str(path)).orderBy("isbn13").collect()
    assert got[0].title == 'a "quoted" b' and got[0].description == "two\nlines" and got[0].published_year == 2001
    assert got[0].subtitle is None and got[0].authors == "none" and got[0].categories is None and got[0].thumbnail is None
    assert got[1].authors is None and got[1].published_year is None and got[1].average_rating is None


def test_corpus_keeps_one_line_an_item(spark, tmp_path):
    df = books(spark, [book(7, description="a\nb\r\nc"), book(8, description="x")])
    files.write_corpus(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_corpus(spark, str(tmp_path / "c")).collect())) == [(7, "7 a b c"), (8, "8 x")]


def test_correlations(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 1.0, 5.0, 1.0), (2.0, 4.0, 5.0, None), (None, 9.0, 5.0, 2.0), (7.0, 8.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r.r for r in profile.spearman(df, ["a", "b", "c"]).collect()}
    want = df.select("a", "b").toPandas().corr(method="spearman").loc["a", "b"]
    assert math.isclose(got["a", "b"], want, abs_tol=1e-6) and got["a", "c"] is None and got["a", "a"] == 1
    flags = {(r.col_a, r.col_b): r.r for r in profile.missing_corr(df, ["a", "b", "d"]).collect()}
    assert set(flags) == {("a", "a"), ("a", "d"), ("d", "d")}
    assert profile.missing_corr(df, ["b", "c"]).count() == 0


def test_ranks_do_not_depend_on_the_cuts(spark):
    df = spark.createDataFrame([(float(x % 37),) for x in range(500)], "v double")
    plain = sorted(map(tuple, profile.average_ranks(df, "v", []).collect()))
    assert plain == sorted(map(tuple, profile.average_ranks(df, "v", [3.0, 9.5, 30.0]).collect()))
    pdf = df.toPandas()
    assert dict(plain) == dict(zip(pdf.v, pdf.v.rank()))


def test_categories(spark):
    df = books(spark, [book(1), book(2, categories="Odd", description="eee"), book(3, categories=None, description="iii e"), book(4, categories="Poetry")])
    filled = {r.isbn13: r.simple_categories for r in enrich.with_categories(df).collect()}
    assert filled == {1: "Fiction", 2: "Fiction", 3: "Nonfiction", 4: "Fiction"}
    assert [r.option for r in category.options(df, "categories").collect()] == ["All", "Fiction", "Odd", "Poetry"]
    assert category.genre_filter(books(spark, [book(1, categories="FANTASY"), book(2, categories=None)])).count() == 1
    sample = category.sample_per_class(df, "categories", "isbn13", 1)
    assert sample.count() == 4
    assert category.accuracy(df.limit(0), "title", "authors").first().accuracy is None


def test_fill_fans_out_on_repeated_keys(spark):
    left = spark.createDataFrame([(1, None), (1, "x")], "isbn13 long, simple_categories string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "isbn13 long, predicted_categories string")
    assert category.fill_categories(left, right).count() == 4


def test_emotions(spark):
    df = books(spark, [book(1, description="aa.ee. "), book(2, description=""), book(3, description="xx")])
    by_job = {r.isbn13: r.asDict() for r in emotion.most_of_each(emotion.score_sentences(df)).collect()}
    inside = df.select("isbn13", *[c.alias(e) for e, c in emotion.letter_emotions(F.col("description")).items()])
    assert by_job == {r.isbn13: r.asDict() for r in inside.collect()}
    assert by_job[1]["anger"] == 1 and by_job[1]["joy"] == 1 and by_job[2]["joy"] == 0
    assert emotion.score_sentences(df, skip_blank=True).count() == 3
    scores = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.5, 0.2), (3, None, 0.3), (4, 0.9, 0.0)], "isbn13 long, joy double, fear double")
    assert [r.isbn13 for r in emotion.tone_sort(scores, "Happy").collect()] == [4, 1, 2, 3]
    assert [r.isbn13 for r in emotion.tone_sort(scores, "no such tone").collect()] == [1, 2, 3, 4]
    turned = emotion.relabel(spark.createDataFrame([(1.0, 2.0, 3.0)], "neutral double, sadness double, surprise double"))
    assert turned.columns == ["sadness", "surprise", "neutral"] and turned.select("neutral").first()[0] == 3.0


def test_scorer_is_made_once_in_each_task(spark):
    made = spark.sparkContext.accumulator(0)

    def factory():
        made.add(1)
        return scorers.letter_scorer(scorers.LETTERS)()

    df = books(spark, [book(i) for i in range(50)]).coalesce(1)
    emotion.score_sentences(df, factory).write.format("noop").mode("overwrite").save()
    assert made.value == 1


def index_of(spark, n=40, dims=4):
    rows = [(i, [float((i * 7 + d * 3) % 11) for d in range(dims)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest_forms_agree(spark):
    index = index_of(spark)
    queries = index.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    for block in (2, 1000):
        batch = vectors.nearest_batch(index.repartition(3), queries, k=6, block=block).collect()
        for q in queries.collect():
            alone = [(r.vec_id, r.d) for r in vectors.nearest(index, list(q.embedding), k=6).collect()]
            assert sorted((r.d, r.vec_id) for r in batch if r.query_id == q.query_id) == [(d, i) for i, d in alone]
    assert vectors.nearest(index, [0.0] * 4, k=500).count() == 40
    assert vectors.nearest_batch(index, queries.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_nearest_among_copies(spark, parts):
    rows = [(i, [0.1 * (i % 3), 0.7, -0.3, 1.9]) for i in range(900)] + [(1000 + i, [float(i), 0.7, 3.0, 1.9]) for i in range(30)]
    rows += [(2000, None)]
    index = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<float>").repartition(parts)
    queries = spark.createDataFrame([(k, [0.1 * k, 0.7, -0.3, 1.9]) for k in range(70)], "query_id long, embedding array<float>")
    got = vectors.nearest_batch(index, queries, k=6).collect()
    asked = {q.query_id: list(q.embedding) for q in queries.collect()}
    found = {r.vec_id: list(r.embedding) for r in index.where("embedding is not null").collect()}
    for k, vec in asked.items():
        every = []
        for i, x in found.items():
            d = 0.0
            for a, b in zip(x, vec):
                d += (a - b) * (a - b)
            every.append((d, i))
        assert sorted((r.d, r.vec_id) for r in got if r.query_id == k) == sorted(every)[:6]
    named = index.withColumn("vec_id", F.lpad(F.col("vec_id").cast("string"), 5, "0"))
    first = vectors.nearest_batch(named, queries.where("query_id = 0"), k=3).collect()
    assert sorted(r.vec_id for r in first) == ["00000", "00003", "00006"]


@pytest.mark.parametrize("dimensions", [64, 10])
def test_hashed_vectors(spark, dimensions):
    words = ["a", "b", "a", "née", "longer"]
    want = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions for w in words}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", scorers.token_bucket(F.col("w"), dimensions).alias("b")).collect()
    assert {r.w: r.b for r in rows} == want
    df = spark.createDataFrame([(1, "A b a née"), (2, ""), (3, None), (4, "x " * 500)], "isbn13 long, description string")
    by_row = {(r.isbn13, r.bucket): r.value for r in vectors.hash_embed(df, "isbn13", "description").collect()}
    dense = {r.isbn13: r.embedding for r in vectors.embed(df, "isbn13", "description").collect()}
    assert {k for k, _ in by_row} == {1, 4}
    for i, v in dense.items():
        assert all(math.isclose(x, by_row.get((i, b), 0.0), rel_tol=1e-6) for b, x in enumerate(v))


def shelf(spark):
    rows = [book(i, categories=["Fiction", "History"][i % 2], description=("e" * (i % 5)) + ".x") for i in range(40)]
    df = books(spark, rows).withColumn("simple_categories", category.simple_category(F.col("categories")))
    return df.select("*", *[c.alias(e) for e, c in emotion.letter_emotions(F.col("description")).items()])


def test_recommend(spark):
    index, catalogue, vec = index_of(spark), shelf(spark), [1.0, 2.0, 3.0, 4.0]
    near = [r.vec_id for r in vectors.nearest(index, vec, 20).collect()]
    everything = [r.isbn13 for r in recommend.recommend(index, catalogue, vec, None, None, 20, 10).collect()]
    assert everything == sorted(near)[:10]
    assert everything == [r.isbn13 for r in recommend.recommend(index, catalogue, vec, "All", "?", 20, 10).collect()]
    by_distance = [r.isbn13 for r in recommend.recommend(index, catalogue, vec, None, None, 20, 10, order="distance").collect()]
    assert sorted(by_distance) == sorted(near[:10])
    toned = recommend.recommend(index, catalogue, vec, "Fiction", "Happy", 20, 5).collect()
    plain = recommend.recommend(index, catalogue, vec, "Fiction", None, 20, 5).collect()
    assert {r.isbn13 for r in toned} == {r.isbn13 for r in plain} and [r.joy for r in toned] == sorted((r.joy for r in toned), reverse=True)
    assert recommend.recommend(index, catalogue, vec, "No such", None).count() == 0
    assert recommend.gallery(recommend.recommend(index, catalogue, vec)).columns == ["large_thumbnail", "caption"]


def test_asking_by_text(spark):
    """A text is embedded by the index's own embedder: it finds itself, and one request equals a batch of one."""
    texts = ["red fish swims", "blue bird flies high", "red bird", "", "old stone house", "a red fish swims far"]
    books = shelf(spark).where(F.col("isbn13") < len(texts)).drop("description")
    books = books.join(spark.createDataFrame(list(enumerate(texts)), "isbn13 long, description string"), "isbn13")
    index = vectors.embed(books, "isbn13", "description").withColumnRenamed("isbn13", "vec_id")
    asked = [(0, "Red fish SWIMS", "All", None), (1, "  ", "All", None), (2, "stone house", "Fiction", "Happy"), (3, "bird", None, None)]
    requests = spark.createDataFrame(asked, "query_id long, query string, category string, tone string")
    got = recommend.ask_batch(index, books, requests, initial_k=3, final_k=2, order="distance").collect()
    for number, text, category, tone in asked:
        mine = [r.isbn13 for r in sorted((r for r in got if r.query_id == number), key=lambda r: r.pos)]
        alone = recommend.ask(index, books, text, category=category, tone=tone, initial_k=3, final_k=2, order="distance").collect()
        assert sorted(mine) == sorted(r.isbn13 for r in alone) and bool(mine) == bool(text.strip())
    assert {r.isbn13 for r in got if r.query_id == 0} == {0, 5} and 4 in {r.isbn13 for r in got if r.query_id == 2}
    seen = []
    prepared = recommend.ask_batch(index, books, requests, initial_k=1, prepare=lambda df: seen.append(df.count()) or df)
    assert prepared.count() > 0 and seen[0] <= 3  # of the items that were found


def requests_of(spark, index):
    asked = [(0, "q", "All", "Happy"), (1, "q", None, None), (2, "  ", "All", None), (3, "q", "Nonfiction", "Sad")]
    df = spark.createDataFrame(asked, "query_id long, query string, category string, tone string")
    return df.join(index.withColumnRenamed("vec_id", "query_id"), "query_id")


@pytest.mark.parametrize("order", ["catalogue", "distance"])
def test_batch_equals_single_requests(spark, order):
    index, catalogue = index_of(spark), shelf(spark)
    requests = requests_of(spark, index)
    batch = recommend.recommend_batch(index, catalogue, requests, 20, 5, order).collect()
    for q in requests.collect():
        mine = [r.isbn13 for r in sorted((r for r in batch if r.query_id == q.query_id), key=lambda r: r.pos)]
        alone = [r.isbn13 for r in recommend.recommend(index, catalogue, list(q.embedding), q.category, q.tone, 20, 5, order).collect()]
        assert (sorted(mine) == sorted(alone) if order == "distance" else mine == alone) or not q.query.strip()
        assert q.query.strip() or not mine


def test_stream_of_requests(spark, tmp_path):
    from bindery.streaming.requests import answer_stream

    index, catalogue = index_of(spark), shelf(spark)
    requests = requests_of(spark, index)
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, index, catalogue, str(tmp_path / "out"), str(tmp_path / "ck"), initial_k=20, final_k=5).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == recommend.recommend_batch(index, catalogue, requests, 20, 5).count() > 0


def test_enrichment_chain(spark):
    out = enrich.enrich(books(spark, [book(1), book(2, categories="Odd"), book(3, description=None)]))
    assert {r.isbn13 for r in out.collect()} == {1, 2}
    assert set(scorers.EMOTIONS) <= set(out.columns)


# --- the index in cells ---


def blobs(n_blobs=12, each=40, width=6, seed=3):
    """Vectors in well parted groups, with exact copies, a null and rows that are not finite."""
    import random

    r = random.Random(seed)
    at = [[r.uniform(-50, 50) for _ in range(width)] for _ in range(n_blobs)]
    rows = [[c + r.gauss(0, 0.3) for c in at[k % n_blobs]] for k in range(n_blobs * each)]
    rows += [rows[7]] * 30 + [None, [math.nan] * width, [math.inf] + [0.0] * (width - 1)]
    return list(enumerate(rows))


@pytest.mark.parametrize("k, n_cells", [(5, None), (60, 12), (1000, 3)])
def test_cells_find_what_a_full_search_finds(spark, tmp_path, monkeypatch, k, n_cells):
    monkeypatch.setattr(cells, "PACK", 16)
    index = spark.createDataFrame(blobs(), "vec_id long, embedding array<double>")
    cells.build(index, str(tmp_path), n_cells, sample=200)
    queries = index.where("vec_id % 37 = 0 or vec_id >= 505").withColumnRenamed("vec_id", "query_id")
    finite = queries.where("query_id < 511")
    asked = sorted(map(tuple, cells.search(spark, str(tmp_path), finite, k).collect()), key=repr)
    want = vectors.nearest_batch(index, finite, k).select("query_id", "vec_id", "d").collect()
    assert repr(asked) == repr(sorted(map(tuple, want), key=repr))  # NaN too
    odd = cells.search(spark, str(tmp_path), queries.where("query_id >= 510"), 3).collect()
    assert {r.query_id for r in odd} == {511, 512} and len(odd) == 6  # a null query finds nothing


def test_cells_far_away_are_not_read(spark, tmp_path):
    index = spark.createDataFrame(blobs()[:480], "vec_id long, embedding array<double>")
    cells.build(index, str(tmp_path), 12)
    n_cells = spark.read.parquet(f"{tmp_path}/cells").count()
    one = index.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    found = cells.search(spark, str(tmp_path), one, 10)
    read = {f.split("cell=")[1].split("/")[0] for f in found.inputFiles() if "cell=" in f}
    assert found.count() == 10 and len(read) < n_cells / 2


def test_probing_misses_little_among_groups(spark, tmp_path):
    index = spark.createDataFrame(blobs()[:480], "vec_id long, embedding array<double>")
    cells.build(index, str(tmp_path), 30)
    queries = index.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    whole = set(map(tuple, vectors.nearest_batch(index, queries, 10).select("query_id", "vec_id").collect()))
    some = set(map(tuple, cells.search(spark, str(tmp_path), queries, 10, probes=6).select("query_id", "vec_id").collect()))
    assert len(some & whole) >= 0.9 * len(whole)


def test_an_empty_index_finds_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id string, embedding array<float>")
    cells.build(none, str(tmp_path))
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    found = cells.search(spark, str(tmp_path), queries)
    assert found.count() == 0 and dict(found.dtypes)["vec_id"] == "string"


# --- keeping an index up to date ---


def counting_embedder(path):
    """Embeds a text as its length and writes down what it was given, whatever process it runs in."""

    def make():
        def embed(texts):
            with open(path, "a") as seen:
                seen.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    return make


def test_only_changed_texts_are_embedded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upkeep, "FANOUT", 3)
    path, log = str(tmp_path / "index"), tmp_path / "seen"

    def state(rows):
        return spark.createDataFrame(rows, "k long, t string")

    def entries(version=None):
        return sorted(map(repr, upkeep.read(spark, path, "k", version).collect()))

    def given():
        out = sorted(log.read_text().split("\n")[:-1]) if log.exists() else []
        log.write_text("")
        return out

    first = [(1, "a"), (2, "bb"), (None, "ccc"), (4, None), (4, ""), (1, "a")]
    assert upkeep.update(state(first), path, "k", "t", counting_embedder(str(log))) == {"version": 1, "added": 5, "gone": 0}
    assert given() == ["", "", "a", "bb", "ccc"]
    was = entries()
    assert upkeep.update(state(first), path, "k", "t", counting_embedder(str(log))) == {"version": 1, "added": 0, "gone": 0}
    assert given() == [] and upkeep.versions(spark, path) == [1]
    second = [(1, "a"), (2, "new"), (None, "ccc"), (5, "a")]
    assert upkeep.update(state(second), path, "k", "t", counting_embedder(str(log))) == {"version": 2, "added": 2, "gone": 3}
    assert given() == ["a", "new"]
    assert entries(1) == was and len(entries()) == 4
    assert upkeep.update(state(first), path, "k", "t", counting_embedder(str(log)))["version"] == 3
    assert given() == ["", "", "bb"]
    assert entries() == was and os.path.exists(f"{path}/whole-3")
    assert upkeep.update(state([]), path, "k", "t", counting_embedder(str(log))) == {"version": 4, "added": 0, "gone": 5}
    assert entries() == [] and given() == []


def test_an_update_that_fails_leaves_the_index_as_it_was(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "a")], "k long, t string")
    upkeep.update(rows, path, "k", "t")
    was = upkeep.read(spark, path, "k").collect()

    def broken():
        raise OSError("no model")

    with pytest.raises(Exception, match="no model"):
        upkeep.update(spark.createDataFrame([(1, "b")], "k long, t string"), path, "k", "t", broken)
    assert upkeep.versions(spark, path) == [1] and upkeep.read(spark, path, "k").collect() == was


# --- counts on the way, and bad records ---


def test_counts_come_from_the_pass_that_writes(spark, tmp_path, monkeypatch):
    rows = [book(1), book(2, description=None), book(3, average_rating=None), book(4, description="short"), book(None), book(6, description=" ")]
    books(spark, rows).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    tracker, group = spark.sparkContext.statusTracker(), "counts"
    spark.sparkContext.setJobGroup(group, group)
    counts = clean.write_cleaned(source, str(tmp_path / "out"))
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("other", "other")
    assert counts == {"read": 6, "no_id": 1, "incomplete": 2, "short": 2, "written": 2}
    assert len(jobs) == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 2
    lines = spark.createDataFrame([("1 a",), ("",), ("  ",), ("no id",), (None,)], "value string")
    assert files.write_parsed_corpus(lines, str(tmp_path / "lines")) == {"read": 5, "blank": 2, "bad_id": 1, "written": 2}


def test_bad_records_are_kept_apart(spark, tmp_path):
    schema = files.T.StructType([f for f in files.CATALOGUE if f.name in ("isbn13", "title", "num_pages")])
    lines = ["isbn13,title,num_pages", '1,"a\n""b""",10', "2,N/A,", "x3,c,ten", "4,d", "5,e,6,7", "6,f,12.0", ",,nan"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    checked = files.check_csv(spark, str(tmp_path / "in.csv"), schema)
    good, rejected = files.quarantine(checked, str(tmp_path / "out"))
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([(1, 'a\n"b"', 10), (2, None, None), (6, "f", 12), (None, None, None)], key=repr)
    assert good.dtypes == [("isbn13", "bigint"), ("title", "string"), ("num_pages", "int")]
    found = {r.title: [tuple(x) for x in r.rejects] for r in rejected.collect()}
    assert found == {"c": [("isbn13", "x3", "not bigint"), ("num_pages", "ten", "not int")], "d": [(None, "4,d", "malformed record")], "e": [(None, "5,e,6,7", "malformed record")]}
    assert files.quarantine(checked.limit(0), str(tmp_path / "none"))[1].count() == 0


# --- how tables lie ---


def rows_scanned(df):
    """Rows that the scans of a query gave out."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
        if "QueryStage" in node.nodeName():
            plan.append(node.plan())
        if node.nodeName().startswith("Scan"):
            out += node.metrics().apply("numOutputRows").value()
    return out


def test_row_groups_without_the_keys_are_skipped(spark, tmp_path):
    n, groups = 200_000, 8
    df = spark.range(n).select(F.xxhash64("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(groups)
    keys = [r.key for r in df.orderBy("text").limit(3).collect()]
    plain = str(tmp_path / "plain")
    df.write.parquet(plain)
    stored = layout.land_for_lookup(df, str(tmp_path / "bloom"), "key", distinct_keys=n // groups)
    found = layout.look_up(stored, "key", [*keys, None, -5])
    assert sorted(r.key for r in found.collect()) == sorted(keys)
    assert rows_scanned(found) <= n / groups * 4 < n * 0.9 < rows_scanned(layout.look_up(spark.read.parquet(plain), "key", keys))
    assert layout.look_up(stored, "key", [None]).count() == 0
    assert layout.look_up(stored, "key", [r.key for r in df.limit(45).collect()]).count() == 45
    with pytest.raises(ValueError, match="join"):
        layout.look_up(stored, "key", list(range(layout.MOST_KEYS + 1)))


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    a = spark.range(1000).select((F.col("id") % 300).alias("k"), "id")
    b = spark.range(0, 400, 2).select(F.col("id").alias("k"), F.lit("x").alias("x"))
    left, right = layout.bucketed(a, str(tmp_path / "a"), "k", 4), layout.bucketed(b, str(tmp_path / "b"), "k", 4)
    joined = left.hint("merge").join(right, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "k").collect()))


def test_categories_nobody_asks_are_not_read(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("category"))
    stored = layout.land_by_category(df, str(tmp_path / "in"), "category")
    spark.createDataFrame([("c1", 1), ("c1", 1), ("c4", 2), (None, 1)], "category string, day int").write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked")).where("day = 1")
    found = layout.of_categories(stored, asked, "category")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in found.collect()) == list(range(1, 100, 5))
    assert stored.where("category is null").count() == 20


def test_sketches_merge(spark):
    rows = [(f"g{k % 3}", " ".join(["w"] * (k % 500))) for k in range(6000)] + [("g0", None)]
    sketches = profile.length_sketches(spark.createDataFrame(rows, "g string, description string"), "g")
    merged = profile.sketched_quantiles(profile.merged_sketches(sketches), (0.1, 0.5)).collect()
    assert {r["rows"] for r in merged} == {6000}
    for r in merged:
        assert abs(r.length - r["at"] * 500) <= profile.RANK_ERROR * 500 + 2


@pytest.mark.parametrize("tokens", [1, 40, 10_000])
def test_batches_keep_to_the_budget(tokens):
    import pandas as pd

    seen = []

    def model():
        def score(batch):
            seen.append(list(batch["text"]))
            return pd.DataFrame({"n": batch["text"].str.len()}, index=batch.index)

        return score

    texts = ["a b c", "", "one " * 100, "a", None, "b b", "c c c c", "d"] * 5
    out = scorers.budgeted(model, tokens)()(pd.DataFrame({"text": texts}, index=range(100, 100 + len(texts))))
    assert out["n"].tolist() == pd.Series(texts).str.len().tolist() or out["n"].fillna(-1).tolist() == pd.Series(texts).str.len().fillna(-1).tolist()
    assert sum(map(len, seen)) == len(texts)
    for batch in seen:
        longest = max(max(1, len((t or "").split())) for t in batch)
        assert len(batch) == 1 or longest * len(batch) <= tokens
    assert scorers.budgeted(model, tokens)()(pd.DataFrame({"text": pd.Series([], dtype=str)})).empty


def test_vectors_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k long, t string")
    hashed = vectors.hash_embed(df, "k", "t")
    assert "Exchange" not in hashed._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in hashed.collect()} == {1} and abs(sum(r.value**2 for r in hashed.collect()) - 1) < 1e-9
