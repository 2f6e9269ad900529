"""Exact quantiles with linear interpolation, for groups of any size.

A quantile needs one or two order statistics of its group.  Each is searched in a box, at first the whole
group: a sketch of the box's values gives two of its values that the wanted rank must lie between, exact
counts below, at and between them tell whether it is one of the two or inside, and the inside is the next
box, a few hundredths of the one before.  When a box has few rows these are sorted.  Edges are values of
the data, so infinities, wide spreads and hot values need no special case.  A round is two scans with partial
sums; no rows move.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number
from ..functions.small_tables import join_pinned, pinned

SORT_ROWS = 20_000  # rows of one box that may be sorted as one list
EDGES = 200  # parts that a sketch cuts a box into
ACCURACY = 10_000  # of the sketch: ranks are off by a share of 1 / ACCURACY at most


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, _v) with missing values dropped."""
    return (
        df.select(*by, *[number(c).alias(c) for c in cols])
        .unpivot(list(by), list(cols), "column", "_v")
        .filter(F.col("_v").isNotNull())
    )


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Long table (by..., column, prob, quantile); null groups are dropped, as are null values."""
    for b in by:
        df = df.filter(F.col(b).isNotNull())
    values = long_values(df, cols, by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pinned(_search(values, [*by, "column"], [float(p) for p in probs], sort_rows)[0])[0]
    finally:
        values.unpersist()


def _ranks(probs: Sequence[float]) -> list[Column]:
    ends = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    return [f(e).cast("long") for e in ends for f in (F.floor, F.ceil)]


def _search(values: DataFrame, keys: list[str], probs: list[float], sort_rows: int) -> tuple[DataFrame, int]:
    """The quantiles, and the number of rounds.

    A group's state is a row of arrays with an entry for each wanted rank: the box (_lo, _hi; ends are not
    in it, null is no end), the rows below and in it, and the statistic once it is known.
    """
    slots = 2 * len(probs)
    none = F.array(*[F.lit(None).cast("double")] * slots)
    state = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    state = state.withColumn("_rank", F.array(*_ranks(probs))).withColumns(
        {
            "_lo": none,
            "_hi": none,
            "_below": F.array(*[F.lit(0).cast("long")] * slots),
            "_in": F.array(*[F.col("_n")] * slots),
            "_stat": none,
        }
    )
    rounds = 0
    while True:
        state, fits = pinned(state)
        largest = state.agg(F.max(F.greatest(F.lit(0), *[F.when(_open(i), F.col("_in")[i]) for i in range(slots)]))).first()[0]
        if (largest or 0) <= sort_rows:
            return _quantiles(values, state, fits, keys, probs), rounds
        if rounds and largest >= before:
            raise RuntimeError(f"the search made no progress on a box of {largest} rows")
        before, rounds = largest, rounds + 1
        state = _narrowed(values, state, fits, keys, slots)


def _open(i: int) -> Column:
    return F.col("_stat")[i].isNull() & (F.col("_in")[i] > 0)


def _inside(i: int) -> Column:
    lo, hi = F.col("_lo")[i], F.col("_hi")[i]
    return _open(i) & F.coalesce(F.col("_v") > lo, F.lit(True)) & F.coalesce(F.col("_v") < hi, F.lit(True))


def _leaders(slots: int, same: Sequence[str]) -> Column:
    """For each slot the first one that is open and equal to it in some arrays; what these share is done once."""

    def leader(i: int) -> Column:
        alike = [F.when(reduce(and_, [F.col(c)[j].eqNullSafe(F.col(c)[i]) for c in same], _open(j)), j) for j in range(i)]
        return F.coalesce(*alike, F.lit(i))

    return F.array(*[leader(i) for i in range(slots)])


def _narrowed(values: DataFrame, state: DataFrame, fits: bool, keys: list[str], slots: int) -> DataFrame:
    """The state after one round."""
    grid = [i / EDGES for i in range(EDGES + 1)]
    state = state.withColumn("_by", _leaders(slots, ("_lo", "_hi", "_below")))
    joined = join_pinned(values, state, fits, keys)
    sketch = [
        F.percentile_approx(F.when((F.col("_by")[i] == i) & _inside(i), F.col("_v")), grid, ACCURACY).alias(f"_e{i}") for i in range(slots)
    ]
    edges = state.join(joined.groupBy(*keys).agg(*sketch), keys)
    every = F.array(*[F.col(f"_e{i}") for i in range(slots)])
    at = [(F.col("_rank")[i] - F.col("_below")[i] + 0.5) / F.greatest(F.col("_in")[i], F.lit(1)) * EDGES for i in range(slots)]
    slack = 2.0 * EDGES / ACCURACY + 1
    pick = lambda i, x: F.element_at(every[F.col("_by")[i]], F.greatest(F.lit(1), F.least(F.lit(EDGES + 1), x.cast("int") + 1)))
    low = F.array(*[pick(i, F.floor(at[i] - slack)) for i in range(slots)])
    high = F.array(*[pick(i, F.ceil(at[i] + slack)) for i in range(slots)])
    cut, fits = pinned(edges.select(*[c for c in state.columns if c != "_by"], low.alias("_a"), high.alias("_b")))
    cut = cut.withColumn("_by", _leaders(slots, ("_a", "_b")))
    joined = join_pinned(values, cut, fits, keys)
    v, counts = F.col("_v"), []
    for i in range(slots):
        a, b = F.col("_a")[i], F.col("_b")[i]
        tests = {"lt": v < a, "at": v == a, "mid": (v > a) & (v < b), "end": (v == b) & (a < b)}
        counts += [F.count(F.when((F.col("_by")[i] == i) & t, 1)).alias(f"_{k}{i}") for k, t in tests.items()]
    told = cut.join(joined.groupBy(*keys).agg(*counts), keys)
    told = told.withColumns({f"_{k}": F.array(*[F.col(f"_{k}{i}") for i in range(slots)]) for k in ("lt", "at", "mid", "end")})
    new: dict[str, list[Column]] = {c: [] for c in ("_lo", "_hi", "_below", "_in", "_stat")}
    for i in range(slots):
        by = F.col("_by")[i]
        rank, start = F.col("_rank")[i], F.col("_lt")[by]
        middle = start + F.col("_at")[by]
        end = middle + F.col("_mid")[by]
        found = (
            F.when((rank >= start) & (rank < middle), F.col("_a")[i]).when((rank >= end) & (rank < end + F.col("_end")[by]), F.col("_b")[i])
        )
        kept = ~_open(i) | (rank < start) | (rank >= end)  # as it was: settled, or its box could not be cut
        for c, value in (("_lo", F.col("_a")[i]), ("_hi", F.col("_b")[i]), ("_below", middle), ("_in", F.col("_mid")[by])):
            new[c].append(F.when(kept, F.col(c)[i]).otherwise(value))
        new["_stat"].append(F.when(_open(i), found).otherwise(F.col("_stat")[i]))
    return told.select(*keys, "_n", "_rank", *[F.array(*e).alias(c) for c, e in new.items()])


def _quantiles(values: DataFrame, state: DataFrame, fits: bool, keys: list[str], probs: list[float]) -> DataFrame:
    """Sort the rows of the boxes that are left, each of few rows, and interpolate."""
    slots = range(2 * len(probs))
    joined = join_pinned(values, state, fits, keys)
    # ranks of one box share its list
    first = [F.array_position(F.transform(F.arrays_zip("_lo", "_hi", "_below"), lambda z: z == F.arrays_zip("_lo", "_hi", "_below")[i]), True) == i + 1 for i in slots]
    rows = [F.collect_list(F.when(_inside(i) & first[i], F.col("_v"))).alias(f"_l{i}") for i in slots]
    lists = state.join(joined.groupBy(*keys).agg(*rows), keys)
    for i in slots:
        lists = lists.withColumn(f"_l{i}", F.sort_array(f"_l{i}"))
    boxes = F.arrays_zip("_lo", "_hi", "_below")
    every = F.array(*[F.col(f"_l{i}") for i in slots])
    stats = []
    for i in slots:
        mine = F.element_at(every, F.array_position(F.transform(boxes, lambda z: z == boxes[i]), True).cast("int"))  # noqa: B023
        place = (F.col("_rank")[i] - F.col("_below")[i] + 1).cast("int")
        stats.append(F.coalesce(F.col("_stat")[i], F.try_element_at(mine, place)))
    found = lists.select(*keys, "_n", F.array(*stats).alias("_s"))
    out = []
    for j, p in enumerate(probs):
        low, high = F.col("_s")[2 * j], F.col("_s")[2 * j + 1]
        position = F.lit(p) * (F.col("_n") - 1)
        value = F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))
        out.append(F.struct(F.lit(p).alias("prob"), value.alias("quantile")))
    return found.select(*keys, F.inline(F.array(*out)))


def quantile(df: DataFrame, col: str, q: float) -> float | None:
    """One exact quantile as a number (a deliberate small action)."""
    row = exact_quantiles(df, [col], [q]).first()
    return None if row is None else row["quantile"]


def _grid(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def approximate_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 1000
) -> DataFrame:
    """Opt-in sketch version of ``exact_quantiles``: one pass, rank error at most n / accuracy."""
    long = long_values(df, cols, by)
    for b in by:
        long = long.filter(F.col(b).isNotNull())
    sketch = F.percentile_approx("_v", _grid(probs), accuracy).alias("_qs")
    return (
        long.groupBy(*by, "column")
        .agg(sketch)
        .select(*by, "column", F.posexplode("_qs").alias("_i", "quantile"))
        .select(*by, "column", F.element_at(_grid(probs), F.col("_i") + 1).alias("prob"), "quantile")
    )
