"""The tables behind the charts: histogram, box statistics, density curve, pair grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, present
from ..functions.small_tables import attach
from .quantiles import exact_quantiles
from .split import sample_n

BINS = 30
GRID_POINTS = 200
#: Moments that a box has of its rows, and the bandwidths up to which it adds to the grid.
TERMS, REACH = 16, 8
BANDWIDTHS_BEYOND = 3.0
WHISKER = 1.5


def histogram(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """``bins`` equal bins from min to max, the last one closed: (bin, lo, hi, n), empty bins kept."""
    x = number(col)
    values = df.select(x.alias("v")).filter(F.col("v").isNotNull())
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = F.lit(lo) + F.col("bin") * F.lit(width)
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", edge.alias("lo"), (edge + width).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def box_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers at the farthest point within 1.5 IQR, and outlier count per group."""
    data = df.select(F.col(group), number(value).alias("v")).filter(
        F.col(group).isNotNull() & F.col("v").isNotNull()
    )
    q = exact_quantiles(data, ["v"], (0.25, 0.5, 0.75), [group])
    boxes = q.groupBy(group).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
            for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ]
    )
    reach = WHISKER * (F.col("q75") - F.col("q25"))
    inside = F.col("v").between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        attach(data, boxes, [group])
        .groupBy(group, "q25", "q50", "q75")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.least(F.min(F.when(inside, F.col("v"))), F.first("q25")).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, F.col("v"))), F.first("q75")).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def density_by_group(
    df: DataFrame,
    value: str,
    group: str | None = None,
    points: int = GRID_POINTS,
    pre_bins: int | None = None,
) -> DataFrame:
    """Gaussian density curve per group, each scaled to the group's share of all rows.

    Bandwidth by Scott's rule, ``points`` grid points from three bandwidths below the minimum to
    three above the maximum.  A row is not spread over the grid: it adds ``TERMS`` moments to its box (a fast Gauss
    transform), and boxes are summed on the grid.  A row's kernel, of height 1, is off by less than 1e-11: with
    half a bandwidth to the middle of the box, Cramer's bound leaves 1.09 times the sum of 0.5^n / sqrt(n!) from
    ``TERMS`` on, 4e-12, and beyond ``REACH`` bandwidths a kernel is under 2e-14.
    ``pre_bins`` (opt-in, approximate) first rounds values to that many steps of their range.
    """
    key = group or "_all"
    base = df if group else df.withColumn(key, F.lit(1))
    data = base.select(F.col(key), number(value).alias("v")).filter(
        F.col(key).isNotNull() & F.col("v").isNotNull()
    )
    stats = data.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"),
        F.stddev_samp("v").alias("sd"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    total = stats.agg(F.sum("size")).scalar()
    stats = (
        stats.withColumn("total", total)
        .withColumn("bw", F.col("sd") * F.pow(F.col("size"), F.lit(-0.2)))
        .filter(F.col("bw") > 0)
    )
    joined = attach(data, stats, [key]).withColumn("w", F.lit(1))
    if pre_bins:
        step = (F.col("hi") - F.col("lo")) / pre_bins
        rounded = F.col("lo") + F.round((F.col("v") - F.col("lo")) / step) * step
        keep = [key, "size", "bw", "lo", "hi", "total"]
        joined = joined.groupBy(*keep, rounded.alias("v")).agg(F.sum("w").alias("w"))
    # each row adds to the moments about the middle of its box, one bandwidth wide
    box = F.floor((F.col("v") - F.col("lo")) / F.col("bw"))
    t = (F.col("v") - (F.col("lo") + (F.col("box") + 0.5) * F.col("bw"))) / (F.col("bw") * math.sqrt(2))
    power, moments = F.col("w").cast("double"), []
    for k in range(TERMS):
        moments.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("t") / (k + 1)
    boxes = joined.withColumn("box", box).withColumn("t", t).groupBy(key, "bw", "lo", "hi", "total", "box").agg(*moments)
    sums = boxes.select(key, "bw", "lo", "hi", "total", "box", F.array(*[F.col(f"m{k}") for k in range(TERMS)]).alias("moments"))
    # boxes end at zero so far away that no point there would show it
    near = F.col("bw") * (REACH + 0.5)
    start = F.col("lo") - BANDWIDTHS_BEYOND * F.col("bw")
    step = (F.col("hi") + BANDWIDTHS_BEYOND * F.col("bw") - start) / (points - 1)
    middle = F.col("lo") + (F.col("box") + 0.5) * F.col("bw")
    first = F.greatest(F.lit(0), F.ceil((middle - near - start) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((middle + near - start) / step)).cast("int")
    x = start + F.col("point") * step
    at = sums.withColumn("point", F.explode(F.sequence(first, last))).withColumn("x", x)
    added = _hermite_sum((F.col("x") - middle) / (F.col("bw") * math.sqrt(2)), F.col("moments"))
    curve = at.groupBy(key, "point", "x", "bw", "total").agg(F.sum(added).alias("kernel_sum"))
    height = F.col("kernel_sum") / (F.col("total") * F.col("bw") * math.sqrt(2 * math.pi))
    # every grid point is there, whether a box is near or not
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x).select(key, "point", "x")
    curve = grid.join(curve.select(key, "point", height.alias("density")), [key, "point"], "left")
    out = curve.select(key, "point", "x", F.greatest(F.coalesce("density", F.lit(0.0)), F.lit(0.0)).alias("density"))
    return out if group else out.drop(key)


def _hermite_sum(x: Column, moments: Column) -> Column:
    """exp(-x^2) times the sum of moments times Hermite polynomials of x, from one to the next."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("now"), F.lit(0.0).alias("before"), F.lit(0.0).alias("k"))

    def step(s: Column, m: Column) -> Column:
        after = 2 * x * s["now"] - 2 * s["k"] * s["before"]
        return F.struct((s["sum"] + m * s["now"]).alias("sum"), after.alias("now"), s["now"].alias("before"), (s["k"] + 1.0).alias("k"))

    return F.aggregate(moments, start, step, lambda s: s["sum"]) * F.exp(-x * x)


def pair_points(df: DataFrame, key: str, cols: Sequence[str], hue: str, n: int) -> DataFrame:
    """Scatter points of every column pair on a seeded sample of ``n`` records.

    The table says how many records it shows (``n_shown``) out of how many (``n_total``).
    """
    cols = present(df, cols)
    total = df.count()
    structs = [
        F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), number(a).alias("x"), number(b).alias("y"))
        for a in cols
        for b in cols
        if a != b
    ]
    sample = sample_n(df, key, n) if total > n else df
    shown = {"n_shown": F.lit(min(n, total)).cast("long"), "n_total": F.lit(total).cast("long")}
    return sample.select(key, hue, F.inline(F.array(*structs))).withColumns(shown)


def pair_grid(df: DataFrame, cols: Sequence[str], hue: str, bins: int = 30) -> DataFrame:
    """All records in cells: (x_name, y_name, hue, x_bin, y_bin, n) of every column pair.

    Bins are of equal width over a column's range; records with a missing value are in no cell of that
    column.  Cells are counted before they are shuffled.
    """
    cols = present(df, cols)
    ends = df.select(*[f(number(c)).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max))]).first()

    def bin_of(i: int, c: str):
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        if lo is None or lo == hi:
            return F.when(number(c).isNotNull(), 0)
        place = F.least(F.floor((number(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        return F.when(number(c).isNotNull(), place)

    binned = df.select(hue, *[bin_of(i, c).alias(f"_b{i}") for i, c in enumerate(cols)])
    pairs = [
        F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(f"_b{i}").alias("x_bin"), F.col(f"_b{j}").alias("y_bin"))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if i != j
    ]
    cells = binned.select(hue, F.inline(F.array(*pairs))).filter("x_bin is not null and y_bin is not null")
    return cells.groupBy("x_name", "y_name", hue, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def pair_grid_diagonal(df: DataFrame, cols: Sequence[str], hue: str) -> DataFrame:
    """Density curves of the columns by ``hue``: the diagonal of the grid, over all records."""
    curves = [density_by_group(df, c, hue).withColumn("column", F.lit(c)) for c in present(df, cols)]
    return reduce(DataFrame.unionByName, curves)
