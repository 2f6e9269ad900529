import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rosterlens import schema as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def soldier_rows(n: int = 400, seed: int = 7) -> pd.DataFrame:
    """A cleaned-table fixture: every column of the schema, related scores, a few missing values."""
    rng = np.random.default_rng(seed)
    out = {S.KEY: [f"s{i:05d}" for i in range(n)]}
    brigade = rng.integers(0, 6, n)
    words = {
        "marital_status": ["married", "single"],
        "pcs_in_last_3_years": ["no", "yes"],
        "rank": ["E-4", "E-5", "E-6"],
        "mos": ["11B", "68W"],
        "type_of_jump": ["none", "static"],
        "day_or_night_jump": ["day", "night"],
        "parachute_type": ["T-11", "MC-6"],
        "aircraft_type": ["C-130", "C-17"],
        "load": ["combat", "light"],
        "stress_trend": ["declining", "improving", "stable"],
        "sleep_trend": ["declining", "improving", "stable"],
        "optempo_trend": ["declining", "improving", "stable"],
        "acft_score_trend": ["declining", "improving"],
        "behavioral_health": ["good", "poor", "severe", "at risk"],
        "morale": ["high", "low", "medium", "poor"],
        "profile_status": ["none", "temporary", "permanent"],
    }
    for c, levels in words.items():
        out[c] = np.array(levels)[rng.integers(0, len(levels), n)]
    out["corps_level"] = np.where(brigade < 4, "I Corps", "V Corps")
    out["division_level"] = np.array([f"D{b // 2}" for b in brigade])
    out["brigade_level"] = np.array([f"B{b}" for b in brigade])
    for c in S.RISK_FEATURES.numeric:
        out[c] = rng.normal(10, 3, n).round(2)
    out["stress_score"] = (rng.uniform(0, 100, n)).round(1)
    out["sleep_score"] = rng.uniform(0, 10, n).round(1)
    out["fatigue"] = rng.uniform(0, 1, n).round(3)
    out["OPTEMPO"] = rng.uniform(0, 1, n).round(3)
    out["overweight"] = rng.integers(0, 2, n)
    out["acft_failure"] = rng.integers(0, 2, n)
    out["low_morale"] = np.isin(out["morale"], ["low", "poor"]).astype(int)
    out["poor_behavioral_health"] = np.isin(out["behavioral_health"], ["poor", "severe"]).astype(int)
    drive = out["stress_score"] / 100 - out["sleep_score"] / 10 + rng.normal(0, 0.4, n)
    for i, c in enumerate(S.OBSERVED_FLAGS):
        out[c] = (drive + rng.normal(0, 0.2, n) > 0.2 + 0.05 * i).astype(int)
    out["soldier_readiness"] = (0.6 - 0.3 * drive + rng.normal(0, 0.05, n)).clip(0, 1).round(3)
    out["retention_rate"] = (0.8 - 0.1 * drive + rng.normal(0, 0.03, n)).clip(0, 1).round(3)
    return pd.DataFrame(out)


@pytest.fixture(scope="session")
def soldiers(spark, tmp_path_factory):
    from rosterlens.sources.tables import load_table

    path = str(tmp_path_factory.mktemp("data") / "soldiers.csv")
    soldier_rows().to_csv(path, index=False)
    df = load_table(spark, path).repartition(4).persist()
    yield df
    df.unpersist()
