"""Profiling: missing values, correlations, frequencies, lengths. Each is one aggregation, or one for each pair."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.text import word_count
from bindery.operators.clean import BANDS
from bindery.sources.scratch import landed


def missing_matrix(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.select(key, *[F.col(c).isNull().cast("int").alias(c) for c in cols])


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, nulls) from one aggregation over all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "col", "nulls")


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are known; null for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def missing_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_a, col_b, r) between the null indicators of the columns that have nulls; no rows if fewer than two have."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    some = [c for c in cols if nulls[c]]
    if len(some) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    pairs = list(combinations_with_replacement(some, 2))
    flag = {c: F.col(c).isNull().cast("double") for c in some}
    wide = df.agg(*[pearson(flag[a], flag[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def range_cuts(df: DataFrame, cols: list[str], pieces: int = 64) -> dict[str, list[float]]:
    """Approximate quantiles that cut each column's values into about ``pieces`` ranges, from one aggregation."""
    steps = [i / pieces for i in range(1, pieces)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(c) for c in cols]).first()
    return {c: sorted(set(row[c] or [])) for c in cols}


def all_ranks(df: DataFrame, cols: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """(of, value, rank): for each column, the mean rank of each distinct value's rows, all columns in one pass.

    Distinct values are counted first. Their running counts come from windows over the ranges between a column's ``cuts``, each
    after the totals of the ranges before it, so no task sees all values.
    """
    values = df.select(*cols).unpivot([], cols, "of", "value").where("value is not null")
    piece = F.lit(0)
    for c in cols:
        if cuts[c]:
            piece = F.when(F.col("of") == c, F.size(F.filter(F.array(*[F.lit(x) for x in cuts[c]]), lambda b: b < F.col("value")))).otherwise(piece)
    dealt = values.groupBy("of", "value").agg(F.count("*").alias("n")).withColumn("piece", piece)
    before = Window.partitionBy("of").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    starts = dealt.groupBy("of", "piece").agg(F.sum("n").alias("total")).select("of", "piece", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    along = Window.partitionBy("of", "piece").orderBy("value")
    ranked = dealt.join(F.broadcast(starts), ["of", "piece"])  # some dozens of rows a column
    return ranked.select("of", "value", (F.col("start") + F.sum("n").over(along) - (F.col("n") - 1) / 2).alias("rank"))


def average_ranks(df: DataFrame, col: str, cuts: list[float]) -> DataFrame:
    """(value, rank) of one column; see ``all_ranks``."""
    return all_ranks(df, [col], {col: cuts}).select("value", "rank")


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_a, col_b, r): Spearman's rho of each pair over rows where both are known, ties at their average rank.

    Pairs with the same columns that have nulls are taken over the same rows, so their ranks are made once for all of
    them and one aggregation gives all their coefficients.
    """
    narrow = landed(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "ranked")
    cuts = range_cuts(narrow, cols)
    nulls = narrow.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    together: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for pair in combinations_with_replacement(cols, 2):
        together.setdefault(tuple(sorted({c for c in pair if nulls[c]})), []).append(pair)
    out = None
    for known, pairs in together.items():
        used = sorted({c for pair in pairs for c in pair})
        ranked = narrow.select(*used).dropna(subset=list(known)) if known else narrow.select(*used)
        ranks = landed(all_ranks(ranked, used, cuts), "ranks")
        for c in used:
            ranked = ranked.join(ranks.where(F.col("of") == c).select(F.col("value").alias(c), F.col("rank").alias(f"rank_{c}")), c)
        wide = ranked.agg(*[pearson(F.col(f"rank_{a}"), F.col(f"rank_{b}")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)])
        part = wide.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, count) by falling count, nulls left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), col)


def length_profile(df: DataFrame, col: str = "description") -> DataFrame:
    """(band, rows): items by the band of their word count."""
    n = word_count(F.col(col))
    band = F.when(n == 0, "0")
    for low, high in BANDS:
        band = band.when(n.between(low, high), f"{low}-{high}")
    named = df.where(F.col(col).isNotNull()).select(band.otherwise(f"{BANDS[-1][1] + 1}+").alias("band"))
    return named.groupBy("band").agg(F.count("*").alias("rows"))


RANK_ERROR = 0.0133  # of a KLL sketch of the default size, at 99 %


def length_sketches(df: DataFrame, by: str, col: str = "description") -> DataFrame:
    """(by, rows, sketch): a KLL sketch of the word counts of each group's items, some kilobytes that can be stored and merged."""
    n = word_count(F.col(col))
    return df.where(F.col(col).isNotNull()).groupBy(by).agg(F.count("*").alias("rows"), F.kll_sketch_agg_bigint(n).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Stored sketches merged, over all or by coarser groups."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """The other columns, and (at, length): the word count at each rank."""
    at = F.array(*[F.struct(F.lit(r).alias("at"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias("length")) for r in ranks])
    return sketches.select("*", F.inline(at)).drop("sketch")
