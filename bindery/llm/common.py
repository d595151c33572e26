"""What the operators share: tables in the shared folder and text normal forms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.sources.scratch import discard, landed

#: White space of the contracts, [\x20\x09-\x0D], as characters.
BLANKS = " \t\n\x0b\x0c\r"

__all__ = ["BLANKS", "ascii_lower", "discard", "each_text", "rows_by_text", "stage", "table", "whole_row", "word_count"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    return landed(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each_text(column):
    """The values of an Arrow column one after the other, so that no second copy of a batch's texts is held."""
    return (x.as_py() for x in column)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def rows_by_text(docs: DataFrame, good) -> DataFrame:
    """The rows of ``docs`` that ``good``, given the texts of a batch, says yes to; all columns stay, whatever their names."""
    at, plain = docs.columns.index("text"), docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(good(each_text(b.column(at))), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes Spark's fast ``lower``, which is the same there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in a text as long, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
