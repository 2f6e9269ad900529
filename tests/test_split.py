import math

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import small_tables
from rosterlens.operators import split
from rosterlens.operators.clean import seeded_hash


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1003).select(
        F.concat(F.lit("p"), "id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("y"), "id"
    ).persist()


def keys(df):
    return {r.key for r in df.select("key").collect()}


def test_stratified_split_has_exact_proportions(people):
    done = split.stratified_split(people, "key", "y").persist()
    assert done.count() == 1003
    test = {r.y: r["count"] for r in done.filter("is_test").groupBy("y").count().collect()}
    assert sum(test.values()) == math.ceil(0.2 * 1003)
    assert abs(test[1] - 0.2 * 144) <= 1 and abs(test[0] - 0.2 * 859) <= 1


def test_stratified_split_is_stable_under_repartitioning(people):
    first = keys(split.stratified_split(people, "key", "y").filter("is_test"))
    assert keys(split.stratified_split(people.repartition(17, "id"), "key", "y").filter("is_test")) == first
    assert keys(split.stratified_split(people, "key", "y", seed=1).filter("is_test")) != first


def test_split_takes_the_lowest_hashes(people):
    order = [r.key for r in people.orderBy(seeded_hash("key")).collect()]
    assert keys(split.random_split(people, "key").filter("is_test")) == set(order[:201])
    assert keys(split.sample_n(people, "key", 10)) == set(order[:10])
    assert split.sample_n(people, "key", 5000).count() == 1003
    folds = {r.key: r.fold for r in split.assign_folds(people, "key", 5).collect()}
    sizes = [201, 201, 201, 200, 200]
    assert [folds[k] for k in order] == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_narrowing_in_many_rounds(people):
    order = [r.h for r in people.select(seeded_hash("key").alias("h")).orderBy("h").collect()]
    hashed = people.select("y", seeded_hash("key").alias("_h"))
    ranks = lambda sizes: sizes.select("y", F.explode(F.array(F.lit(1), F.lit(100), F.col("_n"))).alias("_rank"))
    own = {y: [r.h for r in people.filter(F.col("y") == y).select(seeded_hash("key").alias("h")).orderBy("h").collect()] for y in (0, 1)}
    for ranked_rows in (1, 3, 1000):
        cuts = split.hash_cuts(hashed, ["y"], ranks, prefix=1, ranked_rows=ranked_rows).collect()
        assert sorted((r.y, r._cut) for r in cuts) == sorted((y, h[i]) for y, h in own.items() for i in (0, 99, len(h) - 1))
    assert sorted(own[0] + own[1]) == order


def test_input_is_evaluated_once_besides_the_filter(spark, people):
    seen = spark.sparkContext.accumulator(0)

    def look(row):
        seen.add(1)
        return row

    watched = spark.createDataFrame(people.rdd.map(look), people.schema)
    assert split.stratified_split(watched, "key", "y").filter("is_test").count() == 201
    assert seen.value == 2 * 1003


def test_small_and_empty_inputs(people):
    two = people.filter("id < 2")
    assert split.random_split(two, "key").filter("is_test").count() == 1
    assert {r.fold for r in split.assign_folds(two, "key", 5).collect()} == {0, 1}
    none = people.filter("id < 0")
    assert split.random_split(none, "key").count() == 0
    assert split.assign_folds(none, "key").count() == 0
    assert split.stratified_split(none, "key", "y").count() == 0


def test_bucket_split_needs_no_exchange(people):
    cut = people.filter(split.bucket_split("key"))
    assert 150 < cut.count() < 250


def test_sample_is_exact_at_every_size(people):
    assert split.sample_n(people, "key", 300).count() == 300
    assert split.sample_n(people.filter("id < 140"), "key", 20).count() == 20
    assert split.sample_n(people, "key", 5000).count() == 1003


def test_labels_named_like_internal_columns(people):
    odd = people.withColumnsRenamed({"y": "rank"}).withColumn("n", F.lit(1))
    assert split.stratified_split(odd, "key", "rank").filter("is_test").count() == 201


def test_long_text_is_not_broadcast(people):
    few = people.limit(3).select("key", F.repeat("key", 1000).alias("long"))
    assert small_tables.pinned(few)[1] and not small_tables.pinned(few, max_bytes=5000)[1]


def test_attach_beyond_the_broadcast_bound(people):
    small = people.groupBy("y").agg(F.count(F.lit(1)).alias("size"))
    a = small_tables.attach(people, small, ["y"]).orderBy("id").collect()
    b = small_tables.attach(people, small, ["y"], max_rows=1).orderBy("id").collect()
    assert [(r.id, r["size"]) for r in a] == [(r.id, r["size"]) for r in b] and len(b) == 1003
    plan = small_tables.attach(people, small, ["y"], max_rows=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    left = small_tables.attach(people, small.filter("y = 1"), ["y"], "left", max_rows=0)
    assert left.count() == 1003 and left.filter("size is null").count() == 859
