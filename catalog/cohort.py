"""The stand-in for the soldier table: one row per order that has lines, key ``o_orderkey``.

Division, brigade, mos, rank and trend are region, nation, market segment, order priority and order
status; the scores are order and customer amounts; the flags are ``returned`` and ``low_flag``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.operators.scoring import LinearScore
from rosterlens.operators.units import ScenarioSpec
from rosterlens.schema import FeatureSpec

KEY = "o_orderkey"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lines = (
        table("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("qty"),
            (F.avg("l_discount") + 0.0).alias("disc"),
            F.count(F.lit(1)).alias("n_lines"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
        )
    )
    # the two big joins first: unit names are looked up at the end and never shuffled
    return (
        table("orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            KEY,
            F.col("r_name").alias("division_level"),
            F.col("n_name").alias("brigade_level"),
            F.col("c_mktsegment").alias("mos"),
            F.col("o_orderpriority").alias("rank"),
            F.col("o_orderstatus").alias("trend"),
            "o_totalprice",
            "c_acctbal",
            "qty",
            "disc",
            "n_lines",
            "returned",
            (F.col("o_totalprice") < 50000).cast("int").alias("low_flag"),
        )
    )


def gappy(df: DataFrame) -> DataFrame:
    """The cohort with missing values in a score and in a text column."""
    return df.withColumns(
        {
            "qty": F.when(F.col("n_lines") > 1, F.col("qty")),
            "mos": F.nullif("mos", F.lit("BUILDING")),
        }
    )


COHORT_SQL = """
cohort as (
  select o.o_orderkey, r.r_name division_level, n.n_name brigade_level, c.c_mktsegment mos,
         o.o_orderpriority as "rank", o.o_orderstatus trend, o.o_totalprice, c.c_acctbal,
         l.qty, l.disc, l.n_lines, l.returned,
         case when o.o_totalprice < 50000 then 1 else 0 end low_flag
  from orders o join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
  join (select l_orderkey, sum(l_quantity) qty, avg(l_discount) + 0.0 disc, count(*) n_lines,
               max(case when l_returnflag = 'R' then 1 else 0 end) returned
        from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
),
gappy as (
  select * replace (case when n_lines > 1 then qty end as qty, nullif(mos, 'BUILDING') as mos) from cohort
)"""

# fixed scoring models, so that scores can be checked against SQL without training
RISK_MODELS = {
    "price_risk": LinearScore(
        -0.4,
        (("o_totalprice", 250000.0, 140013.37, 0.8), ("qty", 100.0, 61.0, -0.5), ("c_acctbal", 4500.0, 3201.7, 0.3)),
        (("rank", "1-URGENT", 0.6), ("rank", "5-LOW", -0.4), ("trend", "P", 0.2)),
    ),
    "return_risk": LinearScore(
        0.9,
        (("qty", 100.0, 61.0, 1.1), ("n_lines", 4.0, 2.3, 0.7), ("disc", 0.05, 0.02003, -0.2)),
        (("mos", "MACHINERY", -0.3), ("division_level", "EUROPE", 0.5), ("division_level", "ASIA", -0.25)),
    ),
    "credit_risk": LinearScore(
        -1.0,
        (("c_acctbal", 4500.0, 3201.7, -1.4), ("o_totalprice", 250000.0, 140013.37, 0.2)),
        (("mos", "BUILDING", 0.35), ("trend", "F", -0.15)),
    ),
}
SCORE_MODEL = LinearScore(
    96.0,
    (("o_totalprice", 250000.0, 140013.37, 3.7), ("n_lines", 4.0, 2.3, 41.0), ("disc", 0.05, 0.02003, -0.75)),
    (("rank", "2-HIGH", 1.25), ("mos", "FURNITURE", -2.0)),
    link="identity",
)
THRESHOLDS = {"price_risk": 0.5, "return_risk": 0.7, "credit_risk": 0.4}

SCENARIO = ScenarioSpec(
    ranges={"qty": (0.0, 300.0), "c_acctbal": (-1000.0, 10000.0), "disc": (0.0, 0.1)}, flags=("low_flag",)
)
SCENARIO_BASE = {"qty": 90.0, "c_acctbal": 3000.0, "disc": 0.05, "low_flag": 0}
SCENARIO_OVERRIDES = {"qty": 130.0, "c_acctbal": 500.0, "disc": 0.02, "low_flag": 1}

NUMERIC = ["o_totalprice", "c_acctbal", "qty", "disc"]
COUNTED = [*NUMERIC, "n_lines"]
CATEGORICAL = ["division_level", "mos", "rank", "trend"]
FEATURES = FeatureSpec(("o_totalprice", "c_acctbal", "qty", "disc"), ("mos", "rank", "trend"))
#: Nine 0/1 targets of the cohort.
NINE = {
    "returned": "returned",
    "low_price": "low_flag",
    "urgent": "cast(rank = '1-URGENT' as int)",
    "low_rank": "cast(rank = '5-LOW' as int)",
    "building": "cast(mos = 'BUILDING' as int)",
    "pending": "cast(trend = 'P' as int)",
    "europe": "cast(division_level = 'EUROPE' as int)",
    "many_lines": "cast(n_lines >= 5 as int)",
    "dear": "cast(o_totalprice > 200000 as int)",
}
