"""Welch's t-test, Cramer's V, Pearson correlation, chi-square and one-way ANOVA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, present, text_is
from ..functions.small_tables import attach, cut_lineage
from ..functions.student_t import chi2_tail_p, f_tail_p, two_sided_p

#: Rows that a task counts the cells of at a time.
COUNTED_ROWS = 200_000


def welch_stats(df: DataFrame, group: str, value: str, high: str, low: str) -> DataFrame:
    """One row: n, mean, variance of both groups, t statistic and Satterthwaite degrees of freedom.

    The groups are compared without regard to case; t is for mean(high) - mean(low).
    """
    y = number(value)
    aggs = []
    for side, name in (("high", high), ("low", low)):
        x = F.when(text_is(group, name), y)
        aggs += [
            F.count(x).alias(f"n_{side}"),
            F.avg(x).alias(f"mean_{side}"),
            F.var_samp(x).alias(f"var_{side}"),
        ]
    wanted = F.lower(F.col(group).cast("string")).isin(high.lower(), low.lower())
    se_high = F.col("var_high") / F.col("n_high")
    se_low = F.col("var_low") / F.col("n_low")
    se2 = se_high + se_low
    diff = F.col("mean_high") - F.col("mean_low")
    return (
        df.filter(wanted)
        .agg(*aggs)
        .withColumn("mean_difference", diff)
        .withColumn("t", F.when(se2 > 0, diff / F.sqrt(se2)))
        .withColumn(
            "dof",
            F.when(
                se2 > 0,
                se2 * se2
                / (se_high * se_high / (F.col("n_high") - 1) + se_low * se_low / (F.col("n_low") - 1)),
            ),
        )
    )


@dataclass(frozen=True)
class WelchResult:
    t: float | None
    dof: float | None
    p_two_sided: float | None
    p_one_sided: float | None
    alpha: float

    @property
    def reject(self) -> bool:
        return self.p_one_sided is not None and self.p_one_sided < self.alpha

    @property
    def decision(self) -> str:
        return "Reject H0" if self.reject else "Fail to reject H0"


def welch_test(
    df: DataFrame, group: str, value: str, high: str, low: str, alpha: float = 0.05
) -> WelchResult:
    """One-sided Welch test of mean(high) > mean(low); reads one aggregated row."""
    row = welch_stats(df, group, value, high, low).first()
    t, dof = row["t"], row["dof"]
    if t is None or dof is None:
        return WelchResult(None, None, None, None, alpha)
    p2 = two_sided_p(t, dof)
    return WelchResult(t, dof, p2, p2 / 2 if t > 0 else 1 - p2 / 2, alpha)


def _cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Contingency counts of all pairs in one pass: (a, b, x, y, n).

    Tasks number the levels of each column and count pairs of numbers, some rows at a time; what is shuffled
    are the cells that occur there, not a row for each record and pair.
    """
    cols = sorted({c for p in pairs for c in p})
    text = df.select([F.coalesce(F.col(c).cast("string"), F.lit("Missing")).alias(f"c{i}") for i, c in enumerate(cols)])
    place = {c: i for i, c in enumerate(cols)}
    at = [(place[a], place[b]) for a, b in pairs]

    def counted(rows: pa.Table) -> pa.RecordBatch:
        coded = [c.combine_chunks().dictionary_encode() for c in rows.columns]
        codes = [c.indices.to_numpy() for c in coded]
        found = []
        for i, j in at:
            width = len(coded[j].dictionary)
            cell, n = np.unique(codes[i].astype(np.int64) * width + codes[j], return_counts=True)
            found.append((np.full(len(cell), len(found)), coded[i].dictionary.take(pa.array(cell // width)), coded[j].dictionary.take(pa.array(cell % width)), n))
        pair, x, y, n = zip(*found)
        columns = [pa.array(np.concatenate(pair).astype(np.int32)), pa.concat_arrays(x), pa.concat_arrays(y), pa.array(np.concatenate(n))]
        return pa.RecordBatch.from_arrays(columns, names=["pair", "x", "y", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COUNTED_ROWS:
                yield counted(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield counted(pa.Table.from_batches(held))

    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    cells = text.mapInArrow(run, "pair int, x string, y string, n long").groupBy("pair", "x", "y").agg(F.sum("n").alias("n"))
    return cells.select(F.get(names, F.col("pair")).alias("p"), "x", "y", "n").select("p.a", "p.b", "x", "y", "n")


def chi_square(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, n, r, k, chi2, dof) per pair, with Yates' correction on 2 x 2 tables.

    Works on the occupied cells only.  With row sums R and column sums C the statistic over the full
    grid is n * (sum O^2 / (R C) - 1); the empty cells are in the closed form.  On a 2 x 2 table all
    four |O - E| are equal and sum 1/E = n * (sum 1/R) * (sum 1/C).
    """
    n = F.col("n")
    cells = cut_lineage(_cells(df, pairs))
    row_sums = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("R"))
    column_sums = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("C"))
    # attached, not windowed or dealt by row: the row of a two-level column may have very many cells
    filled = attach(attach(cells, row_sums, ["a", "b", "x"]), column_sums, ["a", "b", "y"])
    table = filled.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        F.round(F.sum(n / F.col("R"))).cast("long").alias("r"),  # each row adds 1
        F.round(F.sum(n / F.col("C"))).cast("long").alias("k"),
        F.sum(n / F.col("R") * (n / F.col("C"))).alias("s"),
        F.sum(n / F.col("R") / F.col("R")).alias("inv_r"),
        F.sum(n / F.col("C") / F.col("C")).alias("inv_c"),
        F.max_by(F.struct(n.alias("o"), "R", "C"), F.struct("n", "x", "y")).alias("cell"),
    )
    gap = F.abs(F.col("cell.o") - F.col("cell.R") * F.col("cell.C") / n)
    yates = gap - F.least(F.lit(0.5), gap)
    chi2 = F.when(
        (F.col("r") == 2) & (F.col("k") == 2), yates * yates * n * F.col("inv_r") * F.col("inv_c")
    ).otherwise(F.greatest(n * (F.col("s") - 1), F.lit(0.0)))
    return table.select("a", "b", "n", "r", "k", chi2.alias("chi2"), ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Bias-corrected Cramer's V per pair: (a, b, n, r, k, chi2, v)."""
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi2 = F.greatest(F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1), F.lit(0.0))
    denominator = F.least(
        r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1
    )
    v = F.when(denominator > 0, F.sqrt(phi2 / denominator)).otherwise(F.lit(0.0))
    return chi_square(df, pairs).select("a", "b", "n", "r", "k", "chi2", v.alias("v"))


def _mirrored(upper: DataFrame, value: str, cols: Sequence[str]) -> DataFrame:
    """Both triangles of a symmetric matrix from the upper one."""
    return upper.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col(value).alias(value)),
                F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col(value).alias(value)),
            )
        )
    )


def association_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cramer's V of every pair of the existing columns as a long symmetric table, diagonal 1."""
    cols = present(df, cols)
    if len(cols) < 2:
        raise ValueError("not enough columns to compute categorical associations")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    upper = cramers_v(df, pairs).select("a", "b", "v")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, v double")
    return _mirrored(upper, "v", cols).unionByName(diagonal)


def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation as a long symmetric table, all pairs in one aggregate."""
    cols = present(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(number(a), number(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{i}").alias("r"))
        for i, (x, y) in enumerate(pairs)
        for a, b in ({(x, y), (y, x)})
    ]
    return wide.select(F.inline(F.array(*cells)))


def chi_square_test(df: DataFrame, a: str, b: str) -> tuple[float, int, float]:
    """(chi2, dof, p) of independence of two text columns."""
    row = chi_square(df, [(a, b)]).first()
    return row["chi2"], row["dof"], chi2_tail_p(row["chi2"], row["dof"])


def anova_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA from per-group counts, means and variances: F with both degrees of freedom."""
    y = number(value)
    groups = (
        df.filter(F.col(group).isNotNull() & y.isNotNull())
        .groupBy(group)
        .agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    )
    grand = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    off = F.col("m") - grand
    totals = groups.withColumn("between", F.col("n") * off * off).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum("between").alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    f = (F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return totals.withColumn("f", F.when((F.col("groups") > 1) & (F.col("within") > 0), f))


def anova_test(df: DataFrame, group: str, value: str) -> tuple[float, float]:
    """(F, p) of a one-way ANOVA."""
    row = anova_stats(df, group, value).first()
    return row["f"], f_tail_p(row["f"], row["groups"] - 1, row["n"] - row["groups"])
