"""Book-shaped views of the driver's tables; see FIXTURES.md for the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators.category import simple_category

#: Languages stand for raw categories; de and es are left to the classifier.
LANGUAGE_MAP = {"en": "Fiction", "fr": "Nonfiction"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ALL_PARTS = ("authors", "average_rating", "thumbnail")


def catalogue(spark: SparkSession, sf_dir: str, only: list[int] | None = None, parts: tuple[str, ...] = ALL_PARTS) -> DataFrame:
    """The catalogue; with ``only``, the few items of a search, those alone: their ids are pushed down to the scans. Columns that come from other
    tables than ``documents`` are joined if they are among ``parts``."""
    docs = table(spark, sf_dir, "documents")
    if only is not None:
        docs = docs.where(F.col("doc_id").isin(only))
    lines_of = F.split("text", "\n")
    books = docs.select(
        F.col("doc_id").alias("isbn13"),
        F.get(lines_of, F.lit(0)).alias("title"),
        F.nullif(F.get(lines_of, F.lit(1)), F.lit("")).alias("subtitle"),
        F.col("lang").alias("categories"),
        F.col("text").alias("description"),
        (1990 + F.col("doc_id") % 35).cast("int").alias("published_year"),
        F.col("n_chars").alias("num_pages"),
    )
    if "authors" in parts:
        lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
        if only is not None:
            lines = lines.where(F.col("l_partkey").isin(only))
        sellers = lines.distinct().join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        authors = sellers.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ";").alias("authors"))
        books = books.join(authors, F.col("isbn13") == F.col("l_partkey"), "left")
    if "average_rating" in parts:
        rated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rated"), F.col("quality").cast("double").alias("average_rating"))
        books = books.join(rated, F.col("isbn13") == F.col("rated"), "left")
    if "thumbnail" in parts:
        pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("thumbnail"))
        books = books.join(pages, F.col("isbn13") == F.col("page_id"), "left")
    own = ("isbn13", "title", "subtitle", "authors", "categories", "thumbnail", "description", "published_year", "num_pages", "average_rating")
    return books.select(*[c for c in own if c in books.columns])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(isbn13, description, categories): what needs no join."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("isbn13"), F.col("text").alias("description"), F.col("lang").alias("categories"))


def with_simple_category(df: DataFrame) -> DataFrame:
    return df.withColumn("simple_categories", simple_category(F.col("categories"), LANGUAGE_MAP))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def requests(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """(query_id, query, embedding, category, tone): each vector whose id is divisible by ``every`` asks; one in five is
    blank."""
    tones = F.array(*[F.lit(t) for t in ("All", "Happy", "Surprising", "Angry", "Suspenseful", "Sad")])
    categories = F.array(F.lit("All"), F.lit("Fiction"), F.lit("Nonfiction"))
    n = (F.col("vec_id") / every).cast("int")
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % every == 0)
    return asked.select(
        F.col("vec_id").alias("query_id"),
        F.when(n % 5 == 4, " ").otherwise("a book about").alias("query"),
        "embedding",
        F.get(categories, n % 3).alias("category"),
        F.get(tones, n % 6).alias("tone"),
    )


def text_requests(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """(query_id, query, category, tone): the first turns of each conversation whose id is divisible by ``every`` ask."""
    first = table(spark, sf_dir, "conversations").where((F.col("conv_id") % every == 0) & (F.col("turn") == 0))
    n = (F.col("conv_id") / every).cast("int")
    category = F.get(F.array(F.lit("All"), F.lit("Fiction"), F.lit("Nonfiction")), n % 3)
    tone = F.get(F.array(F.lit("Happy"), F.lit("All"), F.lit("Sad")), n % 3)
    return first.select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"), category.alias("category"), tone.alias("tone"))
