"""Catalogue CSV and text corpora. Parquet is the format between stages; CSV and text are for exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions.text import item_id, text_with_id

#: What counts as missing in a CSV field.
NA_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
#: What is missing in a foreign file, beside fields of nothing. In a file that keeps texts as they are, nothing else is missing: ().
MISSING = ("", *NA_TOKENS)

_TEXT = ("title", "subtitle", "authors", "categories", "thumbnail", "description")
CATALOGUE = T.StructType(
    [T.StructField("isbn13", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("published_year", T.IntegerType()), T.StructField("num_pages", T.IntegerType()), T.StructField("average_rating", T.DoubleType())]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CATALOGUE, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """Rows of a CSV with a header; fields may hold newlines and doubled quotes, and what is ``missing`` is null.

    A file with multi-line fields cannot be split, so large catalogues come as many files and are landed as Parquet.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = _records(spark, path, raw, header=True)
    known = {f.name: _known(f.name, missing) for f in schema}
    typed = [_typed(known[f.name], f.dataType).alias(f.name) for f in schema]
    return rows.select(*typed)


RECORD = "_record"


def _records(spark: SparkSession, path: str, raw: T.StructType, header: bool, **options) -> DataFrame:
    """The fields as texts: null for a field of nothing, an empty text for an empty pair of quotes."""
    # Spark makes null of every text that equals its mark for a field of nothing, so the mark is one that no file holds.
    nothing = uuid.uuid4().hex
    # charToEscapeQuoteEscaping would be U+0000 otherwise, which texts would lose.
    return spark.read.schema(raw).csv(path, header=header, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', nullValue=nothing, **options)


def _known(name: str, missing: tuple[str, ...]) -> Column:
    return F.when(~F.col(name).isin(*missing), F.col(name)) if missing else F.col(name)


def _typed(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return raw
    return raw.try_cast("double").try_cast(kind) if isinstance(kind, T.IntegerType) else raw.try_cast(kind)


def check_csv(
    spark: SparkSession, path: str, schema: T.StructType = CATALOGUE, header: bool = True, missing: tuple[str, ...] = MISSING, line_sep: str | None = None
) -> DataFrame:
    """The columns of ``schema`` as ``read_csv`` gives them, and ``rejects``: an array of (column, value, reason), empty for a good row.

    A record with too many or too few fields, or whose quotes do not close, is one reject of no column, whose value is the whole
    record. A field that is not missing and has not its column's type is a reject; missing fields are none. Without ``line_sep``
    records end as the first line break of a file does, which may be one inside a text.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(RECORD, T.StringType())])
    rows = _records(spark, path, raw, header, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, lineSep=line_sep)
    known = {f.name: _known(f.name, missing) for f in schema}
    typed = {f.name: _typed(known[f.name], f.dataType) for f in schema}
    whole = F.struct(F.lit(None).cast("string").alias("column"), F.col(RECORD).alias("value"), F.lit("malformed record").alias("reason"))
    fields = [
        F.when(known[f.name].isNotNull() & typed[f.name].isNull(), F.struct(F.lit(f.name).alias("column"), known[f.name].alias("value"), F.lit(f"not {f.dataType.simpleString()}").alias("reason")))
        for f in schema
        if not isinstance(f.dataType, T.StringType)
    ]
    rejects = F.when(F.col(RECORD).isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*fields)) if fields else F.array().cast("array<struct<column:string,value:string,reason:string>>"))
    return rows.select(*[c.alias(n) for n, c in typed.items()], rejects.alias("rejects"))


def quarantine(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected ones): ``checked`` written once, the rejected rows, with their rejects, apart from the good."""
    checked.withColumn("rejected", F.size("rejects") > 0).write.partitionBy("rejected").parquet(path)
    stored = checked.sparkSession.read.schema(checked.schema.add("rejected", "boolean")).parquet(path)
    return stored.where("not rejected").drop("rejected", "rejects"), stored.where("rejected").drop("rejected")


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df``, and the numbers of its rows (``read``) and of those that fulfil each condition, known once an action has gone
    through all of it; no scan or job of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("read"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]), seen


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """A CSV with a header, texts as they are, empty ones in quotes and nulls as fields of nothing: ``read_csv`` gives the same rows
    if it takes nothing else for missing. A single column is all in quotes, since readers skip blank lines, and its nulls are empty texts.
    """
    # Spark also quotes nulls if it is to quote all; texts with quotes, commas or line breaks are quoted anyway.
    kept = df.drop(*drop)
    kept.write.csv(path, header=True, escape='"', quoteAll=len(kept.columns) == 1, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_corpus(df: DataFrame, path: str, id_col: str = "isbn13", text_col: str = "description") -> None:
    """One line for each item, its id before its text; newlines in the text become spaces."""
    line = F.regexp_replace(text_with_id(F.col(id_col), F.col(text_col)), r"[\r\n]+", " ")
    df.select(line.alias("value")).write.text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(isbn13, text): the lines of a corpus that are not blank, trimmed; the id is null where a line has none."""
    return corpus_lines(spark.read.text(path))


def corpus_lines(lines: DataFrame) -> DataFrame:
    """(isbn13, text) from lines in ``value``."""
    text = F.trim("value").alias("text")
    return lines.select(text).where("text <> ''").select(item_id(F.col("text")).alias("isbn13"), "text")


def write_parsed_corpus(lines: DataFrame, path: str) -> dict[str, int]:
    """Write the parsed lines in ``value`` as Parquet and tell, from the same pass, how many were read, were blank, had no id and
    were written."""
    text = F.trim("value")
    rows, seen = observed(lines, "corpus", blank=text == "", bad_id=(text != "") & item_id(text).isNull())
    rows, kept = observed(corpus_lines(rows), "parsed")
    rows.write.parquet(path)
    return seen.get | {"written": kept.get["read"]}
