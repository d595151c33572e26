"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate r between 0 and ``most`` that stays as close as possible, in relative entropy over
documents, to 1 while each source's tokens meet its target: minimise sum r (ln r - 1) so that sum r * size = target.
The dual is convex with one multiplier per source, and its solution tilts rates exponentially by size:
r = min(most, exp(m * size / mean size)). Newton's method solves the dual: every step is one aggregation over
the (source, size) counts, and steps that leave the bracket of the root are halved back into it. The first multipliers
come from Newton steps on a histogram of each source's sizes, of a few hundred bins at most, so that two or three exact
steps are left. If ``max_steps`` do not settle every source, an error names how many are open.

Rates become whole copies by systematic rounding in the order of sizes: with F the running sum of the rates' fractions,
a document gets one more copy where F passes a whole number. A source is thus off by less than its largest document.
Then, until a source is within ``near`` of its target or no single document helps, the document whose size is nearest to
what the source is off by gets a copy more or less; every such step brings the source closer. ``mix_report`` gives what
is left.

Equal (doc_id, source, size) rows are counted first and cut into units of at most ``piece`` rows, and the units of one
source and size are dealt by hash to pieces of about ``piece`` rows, so that no source, size, id or group of
repeats meets in one task. Running sums over a source go over its distinct sizes, of which there are no more than words
in its longest text; those over sources go range by range. Tables of a row a source or a size are joined as Spark sees
fit by their measured size, and not broadcast by hint.

Targets share all tokens by weight 1, 2, 3, repeating over the sources by code point, null last, and stop at ``most``
times the source's tokens; the excess is shared again by weight. All sums that decide a copy are exact decimals or
longs, so reruns agree.

Defined cases: null or blank texts have size 0, add no tokens and are taken once; null is a source of its own, last;
repeated rows are documents of their own; null and repeated doc_id values are as good as others; a source without tokens
has target 0; an empty table gives an empty table; ``mixed_documents`` passes on all columns, maps included, under any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import discard, stage, whole_row, word_count

MOST = 3
NEAR = 0.001
UNIT = 1_000_000  # rates are whole numbers of 1 / UNIT
BINS = 8  # of a histogram, for each doubling of the size
START_STEPS = 16


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Rows with ``before_x`` for each x of ``sums``: the sum of x over all rows that come earlier in the order. Rows
    are dealt by range, so that a task orders one range and the sums of ranges go on from one another."""
    ranged = stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("part").agg(*[F.sum(x).alias(x) for x in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    starts = parts.select(F.col("part").alias("p"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"start_{x}") for x in sums])
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(starts, F.col("part") == F.col("p"))
    return joined.select(*df.columns, *[(F.col(f"start_{x}") + F.coalesce(F.sum(x).over(along), F.lit(0))).alias(f"before_{x}") for x in sums])


def source_targets(cells: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n) counts.

    Filling by weight up to the caps has a closed form: with sources by falling weight for their cap, some prefix keeps
    its cap's worth and the rest share by weight.
    """
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    nth = F.pmod(F.col("before_one"), F.lit(len(weights))).cast("int")
    w = F.get(F.array(*[F.lit(x).cast("long") for x in weights]), nth)
    named = running(sums, [F.col("source").asc_nulls_last()], ["one"]).select("source", "source_size", w.alias("w"))
    named = named.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    order = [F.col("ratio").asc(), F.col("source").asc_nulls_last()]
    filled = running(named, order, ["cap", "w"])
    total = filled.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))  # one row
    level = (F.col("all_size") - F.col("before_cap")) / (F.col("all_w") - F.col("before_w"))
    rated = filled.crossJoin(F.broadcast(total)).withColumn("level", level)
    # The first source that its level does not fill sets the level of all that follow.
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).alias("first")
    reached = rated.crossJoin(F.broadcast(rated.agg(first)))
    onward = F.struct("ratio", F.col("source").isNull().alias("last"), "source") >= F.struct("first.ratio", "first.last", "first.source")
    target = F.when(F.col("first.ratio").isNotNull() & onward, F.least(F.col("first.level") * F.col("w"), F.col("cap").cast("double")))
    return reached.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def newton(m: Column, low: Column, high: Column, tokens: Column, slope: Column, target: Column) -> tuple[Column, Column, Column]:
    """The next multiplier and bracket."""
    over = tokens > target
    low, high = F.when(over, low).otherwise(m), F.when(over, m).otherwise(high)
    step = m - F.try_divide(tokens - target, slope)
    return F.when((step > low) & (step < high), step).otherwise((low + high) / 2), low, high


def tilt(m: Column, z: Column, most: int) -> Column:
    """The rate of a document of ``z`` times its source's mean size."""
    return F.least(F.lit(float(most)), F.exp(F.least(m * z, F.lit(60.0))))


def start_multipliers(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """``state`` with multipliers that solve for histograms of the sizes, which are a bounded array a source."""
    s = state.select(F.col("source").alias("of"), "mean")
    z = F.col("size") / F.col("mean")
    sized = cells.where("size > 0").join(s, same(F.col("source"), F.col("of"))).withColumn("bin", F.floor(F.log2(z) * BINS))
    tokens = F.sum(F.col("n") * F.col("size")).cast("double")
    bins = sized.groupBy("of", "bin").agg(tokens.alias("tokens"), (tokens / F.sum("n") / F.first("mean")).alias("z"))
    listed = bins.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("bin", "z", "tokens"))).alias("bins"))
    joined = state.join(listed, same(F.col("source"), F.col("of")), "left").drop("of")

    def step(acc, _):
        def add(sums, b):
            r = tilt(acc["m"], b["z"], most)
            slope = F.when(r < most, b["tokens"] * b["z"] * r).otherwise(0.0)
            return F.struct((sums["t"] + b["tokens"] * r).alias("t"), (sums["s"] + slope).alias("s"))

        got = F.aggregate("bins", F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s")), add)
        m, low, high = newton(acc["m"], acc["low"], acc["high"], got["t"], got["s"], F.col("target"))
        return F.struct(m.alias("m"), low.alias("low"), high.alias("high"))

    first = F.struct(F.lit(0.0).alias("m"), F.lit(-1e5).alias("low"), F.lit(1e5).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(START_STEPS)), first, step)["m"]
    return joined.withColumn("m", F.when(F.col("done") | F.col("bins").isNull(), F.col("m")).otherwise(found)).drop("bins")


def tilted_rates(cells: DataFrame, targets: DataFrame, most: int = MOST, tolerance: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """(source, size, n, rate): ``rate`` in units of 1 / UNIT, for each (source, size) cell.

    Multipliers are a table of one row a source, joined to the cells in each Newton step.
    """
    docs = cells.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("docs"))
    state = targets.join(docs, same(F.col("source"), F.col("of"))).select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"),
        F.when(F.col("target") >= F.col("source_size") * float(most), F.lit(math.inf)).otherwise(F.lit(0.0)).alias("m"),
        F.lit(-1e5).alias("low"), F.lit(1e5).alias("high"))
    state = state.withColumn("done", (F.col("m") == math.inf) | (F.col("target") <= 0))
    state = stage(start_multipliers(cells, state, most), "multipliers")
    z = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("m") == math.inf, F.lit(float(most))).otherwise(tilt(F.col("m"), z, most))

    def tilted(state: DataFrame) -> DataFrame:
        s = state.withColumnRenamed("source", "of")
        return cells.join(s, same(F.col("source"), F.col("of"))).withColumn("r", rate)

    exact = lambda x: F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double")  # noqa: E731  the same in any order
    for _ in range(max_steps):
        step = tilted(state.where("not done")).groupBy("of", "target", "mean", "m", "low", "high").agg(
            exact(F.col("n") * F.col("size") * F.col("r")).alias("tokens"),
            exact(F.when(F.col("r") < most, F.col("n") * F.col("size") * z * F.col("r")).otherwise(0.0)).alias("slope"),
        )
        m, low, high = newton(*(F.col(c) for c in ("m", "low", "high", "tokens", "slope", "target")))
        near = F.abs(F.col("tokens") - F.col("target")) <= tolerance * F.col("target") + 1e-3
        near |= (F.col("high") - F.col("low") <= 1e-12 * F.abs("m"))  # a step of rounding: no multiplier comes nearer
        step = step.select(F.col("of").alias("source"), "target", "mean", F.when(near, F.col("m")).otherwise(m).alias("m"), low.alias("low"), high.alias("high"), near.alias("done"))
        before, state = state, stage(state.where("done").unionByName(step), "multipliers")
        discard(before)
        if state.where("not done").isEmpty():
            return tilted(state).select("source", "size", "n", F.round(F.col("r") * UNIT).cast("long").alias("rate"))
    raise RuntimeError(f"{state.where('not done').count()} sources did not settle in {max_steps} Newton steps")


def units_of(docs: DataFrame, piece: int) -> DataFrame:
    """(doc_id, source, size, h, n): equal rows once, cut into units of at most ``piece`` rows."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    cut = counted.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / piece))))
    n = F.least(F.lit(piece).cast("long"), F.col("rows") - F.col("unit") * piece)
    return cut.select("doc_id", "source", "size", F.xxhash64("doc_id", "unit").alias("h"), n.alias("n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, piece: int = 4096, near: float = NEAR) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``."""
    units = stage(units_of(docs, piece), "units")
    cells = stage(units.groupBy("source", "size").agg(F.sum("n").alias("n")), "size-counts")
    targets = stage(source_targets(cells, weights, most), "targets")
    rates = stage(tilted_rates(cells, targets, most).withColumn("pieces", F.ceil(F.col("n") / piece).cast("long")), "rates")
    fraction = F.pmod(F.col("rate"), F.lit(UNIT))
    # Running sums of fractions: up to each size of a source, up to each piece of a size, up to each unit of a piece.
    sizes = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    whole = rates.select(F.col("source").alias("of"), F.col("size").alias("as"), "rate", "pieces", F.coalesce(F.sum(F.col("n") * fraction).over(sizes), F.lit(0)).alias("size_start"))
    rated = units.join(whole, same(units["source"], whole["of"]) & (units["size"] == whole["as"]))
    rated = stage(rated.withColumn("piece", F.pmod("h", "pieces")).drop("of", "as", "pieces"), "rated")
    along = Window.partitionBy("source", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = rated.groupBy("source", "size", "piece").agg(F.sum("n").alias("n"))
    heads = heads.select(F.col("source").alias("of"), F.col("size").alias("as"), F.col("piece").alias("at"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "size", "piece").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rated.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = ranked.join(heads, same(ranked["source"], heads["of"]) & (ranked["size"] == heads["as"]) & (ranked["piece"] == heads["at"]))
    rows = joined.withColumn("rank", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + F.col("n"))))
    end = F.col("size_start") + (F.col("ahead") + F.col("rank")) * fraction + F.lit(UNIT // 2)
    extra = F.floor(end / UNIT) - F.floor((end - fraction) / UNIT)
    rounded = stage(rows.select("doc_id", "source", "size", "piece", "rank", (F.floor(F.col("rate") / UNIT) + extra).alias("copies")), "rounded")
    changes = stage(_corrections(rounded, targets, most, near), "corrections")
    named = targets.select(F.col("source").alias("of"), "source_size", "target")
    out = rounded.join(named, same(rounded["source"], named["of"])).drop("of")
    c = changes.select(*[F.col(k).alias(f"c_{k}") for k in ("source", "size", "piece", "rank")], "change")
    here = same(out["source"], c["c_source"]) & (out["size"] == c["c_size"]) & (out["piece"] == c["c_piece"]) & (out["rank"] == c["c_rank"])
    out = out.join(c, here, "left")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mix_report(mixed: DataFrame) -> DataFrame:
    """(source, source_size, target, taken, error): what the mix takes of each source, and how far off its target that is."""
    sums = mixed.groupBy("source", "source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    return sums.withColumn("error", F.coalesce(F.try_divide(F.col("taken") - F.col("target"), F.col("target")), F.lit(0.0)))


def _corrections(rounded: DataFrame, targets: DataFrame, most: int, near: float) -> DataFrame:
    """(source, size, piece, rank, change): single documents to take once more or once less. Each (source, size) offers
    one of either kind and serves once, so the rounds end; each brings a source closer."""
    at = F.struct("piece", "rank")
    cells = rounded.where("size > 0").groupBy("source", "size").agg(
        F.min(F.when(F.col("copies") < most, at)).alias("up"), F.min(F.when(F.col("copies") >= 1, at)).alias("down"),
        F.sum(F.col("copies") * F.col("size")).alias("tokens"))
    cells = stage(cells, "cells")
    taken = cells.groupBy(F.col("source").alias("of")).agg(F.sum("tokens").alias("tokens"))
    off = (F.col("target") - F.col("tokens")).alias("off")
    state = stage(taken.join(targets, same(F.col("of"), F.col("source"))).select("of", "target", off), "off-target")
    found, row = None, F.when(F.col("off") > 0, F.col("up")).otherwise(F.col("down"))
    while True:
        open_ones = state.where(F.abs("off") > F.col("target") * near)
        offers = cells.join(open_ones, same(F.col("source"), F.col("of"))).where(row.isNotNull() & (F.col("size") < 2 * F.abs("off")))
        best = F.min_by(F.struct("size", row.alias("at"), F.signum("off").cast("long").alias("change")), F.struct(F.abs(F.abs("off") - F.col("size")), "size"))
        picked = stage(offers.groupBy("source").agg(best.alias("best")).select(
            "source", "best.size", F.col("best.at.piece").alias("piece"), F.col("best.at.rank").alias("rank"), "best.change"), "picked")
        found = picked if found is None else found.unionByName(picked)
        if picked.isEmpty():
            return found
        p = picked.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), (F.col("change") * F.col("size")).alias("moved"))
        cells = cells.join(p, same(cells["source"], p["p_source"]) & (cells["size"] == p["p_size"]), "left_anti")
        moved = state.join(p, same(F.col("of"), F.col("p_source")), "left")
        state = stage(moved.select("of", "target", (F.col("off") - F.coalesce("moved", F.lit(0))).alias("off")), "off-target")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those with maps, which Spark does not hash, by their text."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, piece: int = 4096) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with all their columns. Rows that are equal in every
    column are interchangeable and share the copies given to them; where there are over ``piece`` of them, one stands for
    all and its copies are dealt out in lots of ``piece``."""
    hashed = docs.select(F.struct(row_hash(docs).alias("row"), "doc_id").alias("ident"), whole_row(docs).alias("all"))
    copies = mix(hashed.select(F.col("ident").alias("doc_id"), "all.source", "all.text"), weights, most, piece)
    chosen = copies.groupBy(F.col("doc_id").alias("ident")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    crowded = stage(chosen.where(F.col("rows") > piece), "crowded")
    # Of the copies' very type, so that one shuffle serves both the join and the ranks.
    idents = hashed.withColumn("ident", F.col("ident").cast(chosen.schema["ident"].dataType))
    rows = idents.join(chosen.where(F.col("rows") <= piece), "ident")
    nth = F.row_number().over(Window.partitionBy("ident").orderBy("rows"))
    times = F.floor(F.col("copies") / F.col("rows")) + (nth <= F.pmod("copies", "rows")).cast("long")
    out = rows.withColumn("times", times).select("all", "times")
    if not crowded.isEmpty():
        one = idents.join(crowded, "ident").groupBy("ident", "copies").agg(F.first("all").alias("all"))
        lots = one.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / piece))))
        lots = lots.repartition("ident", "lot").withColumn("times", F.least(F.lit(piece).cast("long"), F.col("copies") - F.col("lot") * piece))
        out = out.unionByName(lots.select("all", "times"))
    return out.select("all", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("all.*")
