"""Reproducible splits, folds and samples without sorting or grouping the rows.

Records are ordered by a seeded hash of their key.  "The k records with the lowest hash" then only
needs the k-th lowest hash: count rows per hash prefix, find the prefix in which the k-th row lies, go
on with longer prefixes inside it while it holds many rows, rank the few that are left, and compare
every row with the cut.  The split itself is a filter: no row moves, whatever the size of a class.
Keys must be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small_tables import attach, computed, join_pinned, pinned
from ..schema import FOLDS, SEED, TEST_SHARE
from .clean import seeded_hash

PREFIX = 4  # hex digits a round: 65,536 about equal buckets in what is left
HASH_DIGITS = 32
COUNTED_PREFIX = 3  # of hashes counted for many labels at once: 4,096 buckets, which a task can add up
RANKED_ROWS = 100_000  # rows of one bucket that are ranked in one task


def hash_cuts(
    hashed: DataFrame,
    by: Sequence[str],
    ranks: Callable[[DataFrame], DataFrame],
    prefix: int = PREFIX,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """The hash at each wanted rank: (by..., _cut), from rows of (by..., _h).

    ``ranks`` turns the stratum sizes (by..., _n) into the wanted ranks (by..., _rank), from 1.
    Sizes are summed from the bucket counts, so finding the buckets reads the rows once.  ``hashed`` is
    read once more for every further round, and once to rank.
    """
    by = list(by)
    digits, wanted = prefix, None
    while True:
        inside = hashed
        if wanted is not None:
            before = wanted.select(*by, "_bucket").distinct().withColumnRenamed("_bucket", "_in")
            inside = attach(hashed.withColumn("_in", F.substring("_h", 1, digits - prefix)), before, [*by, "_in"])
        else:
            inside = inside.withColumn("_in", F.lit(""))
        buckets = (
            inside.groupBy(*by, "_in", F.substring("_h", 1, digits).alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, "_in").orderBy("_bucket")))  # few buckets
        )
        if wanted is None:
            sizes = ranks(buckets.groupBy(*by).agg(F.sum("_n").alias("_n")))
            old = sizes.select(*by, F.lit("").alias("_in"), "_rank", F.col("_rank").alias("_at"))
        else:
            old = wanted.select(*by, F.col("_bucket").alias("_in"), "_rank", F.col("_place").alias("_at"))
        found = (
            buckets.join(old, [*by, "_in"])
            .withColumn("_place", F.expr("_at - (_upto - _n)"))
            .filter("_place between 1 and _n")
        )
        wanted = computed(found.select(*by, "_bucket", "_rank", "_place", "_n"))  # a row for each rank
        most = wanted.agg(F.max("_n")).first()[0] or 0
        if most <= ranked_rows or digits >= HASH_DIGITS:
            break
        digits += prefix
    row = F.row_number().over(Window.partitionBy(*by, "_bucket", "_rank").orderBy("_h"))
    return (
        attach(hashed.withColumn("_bucket", F.substring("_h", 1, digits)), wanted.drop("_n"), [*by, "_bucket"])
        .withColumn("_row", row)
        .filter("_row = _place")
        .select(*by, F.col("_h").alias("_cut"))
    )


def _with_cuts(
    df: DataFrame,
    key: str,
    by: Sequence[str],
    seed: int | str,
    ranks: Callable[[DataFrame], DataFrame],
    how: str = "left",
) -> DataFrame:
    """Rows with their hash ``_h`` and the sorted hash cuts ``_cuts`` of their stratum.

    The input is evaluated once for its strata and hashes, which are kept meanwhile, and once for the rows.
    """
    hashed = df.select(*by, seeded_hash(key, seed).alias("_h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = hash_cuts(hashed, by, ranks)
        per_stratum = pinned(cuts.groupBy(*by).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")))  # few ranks
    finally:
        hashed.unpersist()
    return join_pinned(df.withColumn("_h", seeded_hash(key, seed)), *per_stratum, by, how)


def _one_stratum(df: DataFrame) -> DataFrame:
    return df.withColumn("_all", F.lit(1))


def _share_of(n: Column, share: float) -> Column:
    """ceil(share * n), safe against 0.2 * 5 = 1.0000000000000002."""
    return F.ceil(F.round(n * F.lit(share), 9))


def test_quotas(counts: DataFrame, label: str, test_share: float, by: Sequence[str] = ()) -> DataFrame:
    """Test rows per class, as ``_rank``, from class counts (by..., label, _n), for each of ``by`` on its own.

    The test set has ceil(share * n) rows in all.  The train rows are shared out in proportion, the
    odd ones going to the classes with the largest remainders (ties to the smaller label).
    """
    classes = Window.partitionBy(*by or [F.lit(1)])  # one row per class
    exact = F.expr("_n * _train_total / _total")
    turn = F.row_number().over(classes.orderBy(F.desc("_remainder"), label))
    left_over = F.col("_train_total") - F.sum("_base").over(classes)
    return (
        counts.withColumn("_total", F.sum("_n").over(classes))
        .withColumn("_train_total", F.col("_total") - _share_of(F.col("_total"), test_share))
        .withColumn("_base", F.floor(exact))
        .withColumn("_remainder", F.round(exact - F.floor(exact), 9))
        .withColumn("_train", F.col("_base") + (turn <= left_over).cast("int"))
        .select(*by, label, F.expr("_n - _train").alias("_rank"))
        .filter("_rank > 0")
    )


def _low_hash(cut: DataFrame, *helpers: str) -> DataFrame:
    low = F.col("_h") <= F.element_at("_cuts", 1)
    return cut.withColumn("is_test", F.coalesce(low, F.lit(False))).drop("_h", "_cuts", *helpers)


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = TEST_SHARE, seed: int | str = SEED
) -> DataFrame:
    """Add ``is_test``: exact class proportions, repeatable, stable under repartitioning.

    Rows without a label are dropped.
    """
    known = df.filter(F.col(label).isNotNull())
    return _low_hash(
        _with_cuts(known, key, [label], seed, lambda counts: test_quotas(counts, label, test_share))
    )


def stratified_splits(
    df: DataFrame, key: str, labels: Mapping[str, str], test_share: float = TEST_SHARE, seed: int | str = SEED
) -> DataFrame:
    """Add a test flag for each of several 0/1 labels (label: flag column), as ``stratified_split`` sets it.

    All labels share the passes over the rows.  The flag is null where the label is.  The first pass counts the classes of all
    labels by hash prefix; only rows whose prefix holds a wanted rank get a row for each label, so what is shuffled and kept
    does not grow with rows times labels.
    """
    names = list(labels)
    hashed = df.select(*[F.col(c).cast("int").alias(f"_c{i}") for i, c in enumerate(names)], seeded_hash(key, seed).alias("_h"))
    pairs = [(i, k) for i in range(len(names)) for k in (0, 1)]
    prefix = F.substring("_h", 1, COUNTED_PREFIX)
    by_prefix = hashed.groupBy(prefix.alias("_bucket")).agg(*[F.count_if(F.col(f"_c{i}") == k).alias(f"_n{i}_{k}") for i, k in pairs])
    table = by_prefix.orderBy("_bucket").collect()  # 4,096 rows at most
    sizes = [(names[i], k, n) for i, k in pairs if (n := sum(r[f"_n{i}_{k}"] for r in table))]
    spark, by = df.sparkSession, ["_of", "_class"]
    quotas = test_quotas(spark.createDataFrame(sizes, "_of string, _class int, _n long"), "_class", test_share, ["_of"]).collect()
    inside = []  # (label, class, prefix, rank among the rows of that prefix)
    for q in quotas:
        column, left = f"_n{names.index(q['_of'])}_{q['_class']}", q["_rank"]
        for r in table:
            if left <= r[column]:
                inside.append((q["_of"], q["_class"], r["_bucket"], left))
                break
            left -= r[column]
    # a prefix that several labels want is a row of each; the ranks within prefixes are found as in ``hash_cuts``
    wanted = spark.createDataFrame(inside, "_of string, _class int, _bucket string, _rank long")
    strata = F.explode(F.array(*[F.struct(F.lit(c).alias("_of"), F.col(f"_c{i}").alias("_class")) for i, c in enumerate(names)]))
    some = hashed.where(prefix.isin(sorted({w[2] for w in inside})))
    some = some.select("_h", prefix.alias("_bucket"), strata.alias("_s")).select("_h", "_bucket", "_s.*")
    some = some.join(F.broadcast(wanted.drop("_rank")), [*by, "_bucket"]).select(*by, "_h").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = hash_cuts(some, by, lambda _: wanted.select(*by, "_rank")).collect()  # two a label
    finally:
        some.unpersist()
    at = {(c["_of"], c["_class"]): c["_cut"] for c in cuts}
    h = F.col("_h")  # a column of its own: within the flags the hash would be worked out again for each label

    def flag(c: str) -> Column:
        low = F.when(F.col(c) == 1, h <= F.lit(at.get((c, 1), ""))).otherwise(h <= F.lit(at.get((c, 0), "")))
        return F.when(F.col(c).isNotNull(), low)

    return df.withColumn("_h", seeded_hash(key, seed)).withColumns({name: flag(c) for c, name in labels.items()}).drop("_h")


def random_split(
    df: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int | str = SEED
) -> DataFrame:
    """Add ``is_test`` for ceil(share * n) rows."""

    def ranks(sizes: DataFrame) -> DataFrame:
        return sizes.select("_all", _share_of(F.col("_n"), test_share).alias("_rank")).filter("_rank > 0")

    return _low_hash(_with_cuts(_one_stratum(df), key, ["_all"], seed, ranks), "_all")


def bucket_split(key: str, test_share: float = TEST_SHARE, seed: int | str = SEED) -> Column:
    """Test membership by hash range alone: about the share, no pass over the data at all."""
    first = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double")
    return first / float(2**32) < test_share


def assign_folds(df: DataFrame, key: str, k: int = FOLDS, seed: int | str = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1: equal slices of the hash order, the first n % k one row longer."""

    def ranks(sizes: DataFrame) -> DataFrame:
        n = F.col("_n")
        ends = F.array(*[F.floor(n / k) * i + F.least(n % k, F.lit(i)) for i in range(1, k)])
        return sizes.select("_all", F.explode(F.array_distinct(ends)).alias("_rank")).filter("_rank > 0")

    cut = _with_cuts(_one_stratum(df), key, ["_all"], seed, ranks)
    above = F.size(F.filter("_cuts", lambda c: F.col("_h") > c))
    return cut.withColumn("fold", F.coalesce(above, F.lit(0)).cast("int")).drop("_h", "_cuts", "_all")


def sample_n(df: DataFrame, key: str, n: int, seed: int | str = SEED) -> DataFrame:
    """The ``n`` records with the lowest hash; all of them if there are no more than ``n``."""

    def ranks(sizes: DataFrame) -> DataFrame:
        return sizes.select("_all", F.least("_n", F.lit(n)).alias("_rank")).filter("_rank > 0")

    cut = _with_cuts(_one_stratum(df), key, ["_all"], seed, ranks, "inner")
    return cut.filter(F.col("_h") <= F.element_at("_cuts", 1)).drop("_h", "_cuts", "_all")
