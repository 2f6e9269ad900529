"""The soldier table as one configuration of the operators: types, feature lists, targets.

Column names and the constants below are fixed values: the results depend on them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

KEY = "soldier_id"

# --- fixed values: column names by role -------------------------------------------------------

LEAVE_AND_TENURE = [
    "leave_days_taken_past_12mo",
    "days_since_last_leave",
    "years_at_unit",
]
BODY_AND_FITNESS = [
    "age",
    "body_mass_index",
    "overweight",
    "acft_history_average",
    "current_acft_score",
    "acft_failure",
]
JUMP_AND_INJURY = [
    "airborne_ops",
    "jump_count",
    "musculoskeletal_injury",
    "airborne_related_injury",
    "acft_related_injury",
]
WORKLOAD = ["stress_score", "sleep_score", "fatigue", "OPTEMPO"]
CLIMATE = [
    "family_stress_score",
    "financial_stress_score",
    "unit_climate_score",
    "leadership_trust_index",
]
DERIVED_FLAGS = ["low_morale", "poor_behavioral_health"]

PERSON = ["marital_status", "pcs_in_last_3_years", "rank", "mos"]
UNIT_LEVELS = ["corps_level", "division_level", "brigade_level"]
FINE_UNIT_LEVELS = ["company_level", "battalion_level"]
JUMP_KIND = ["type_of_jump", "day_or_night_jump", "parachute_type", "aircraft_type", "load"]
SURVEY_TEXT = [
    "stress_trend",
    "sleep_trend",
    "optempo_trend",
    "behavioral_health",
    "morale",
    "acft_score_trend",
]

OBSERVED_FLAGS = [
    "high_burnout_risk",
    "high_risk_of_injury",
    "ucmj",
    "poor_performance",
    "suicide_risk",
    "non_deployable",
]
SCORES = ["soldier_readiness", "retention_rate"]

FILTER_COLUMNS = ["corps_level", "division_level", "brigade_level", "mos", "rank"]
RATE_GROUPS = ["brigade_level", "mos", "rank", "division_level"]

SPELLING_FIXES = {
    "airborne_raleted_injury": "airborne_related_injury",
    "overweigth": "overweight",
    "suicie_risk": "suicide_risk",
}

LOW_MORALE_WORDS = ("low", "poor")
POOR_HEALTH_WORDS = ("poor", "severe")
POOR_HEALTH_WORDS_DASHBOARD = ("poor", "at risk", "high risk")
PROFILE_WORDS = ("temporary", "permanent")

SHIFT_RANGES = {
    "stress_score": (0.0, 100.0),
    "sleep_score": (0.0, 10.0),
    "fatigue": (0.0, 1.0),
    "OPTEMPO": (0.0, 1.0),
}
SCENARIO_FLAGS = ["low_morale", "acft_failure", "poor_behavioral_health"]

CORRELATION_COLUMNS = WORKLOAD + CLIMATE + SCORES
ASSOCIATION_COLUMNS = (
    PERSON + UNIT_LEVELS + JUMP_KIND + SURVEY_TEXT + DERIVED_FLAGS + ["acft_failure"]
)
COUNT_PLOT_COLUMNS = [
    "behavioral_health",
    "morale",
    "sleep_trend",
    "stress_trend",
    "profile_status",
    "low_morale",
    "poor_behavioral_health",
]

SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
DEFAULT_THRESHOLD = 0.5
READY_CUT = 0.5

# --- features and targets -----------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns a model reads, in the order of its feature vector."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys((*self.numeric, *self.categorical)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> FeatureSpec:
        d = json.loads(text)
        return FeatureSpec(tuple(d["numeric"]), tuple(d["categorical"]))


RISK_FEATURES = FeatureSpec(
    numeric=tuple(
        LEAVE_AND_TENURE
        + ["dwell_time", "quarterly_counseling_frequency"]
        + BODY_AND_FITNESS
        + JUMP_AND_INJURY
        + ["deployments", "months_deployed_last_rotation", "training_density"]
        + WORKLOAD
        + CLIMATE
        + DERIVED_FLAGS
    ),
    categorical=tuple(PERSON + UNIT_LEVELS + JUMP_KIND + SURVEY_TEXT),
)
READINESS_FEATURES = FeatureSpec(
    numeric=tuple(WORKLOAD + CLIMATE + ["acft_failure"] + DERIVED_FLAGS),
    categorical=tuple(SURVEY_TEXT),
)
RETENTION_FEATURES = FeatureSpec(
    numeric=tuple(
        BODY_AND_FITNESS
        + JUMP_AND_INJURY
        + ["deployments", "dwell_time", "months_deployed_last_rotation", "training_density"]
        + WORKLOAD
        + CLIMATE
        + DERIVED_FLAGS
        + LEAVE_AND_TENURE
    ),
    categorical=tuple(JUMP_KIND + SURVEY_TEXT + PERSON),
)


@dataclass(frozen=True)
class TargetSpec:
    """How a 0/1 label is made: ``binary``, ``in_set``, ``quantile`` or ``threshold``."""

    name: str
    kind: str
    column: str | None = None
    values: tuple[str, ...] = field(default=())
    q: float = 0.25
    cut: float = 0.85

    @property
    def source(self) -> str:
        return self.column or self.name


RISK_TARGETS = {
    **{name: TargetSpec(name, "binary") for name in OBSERVED_FLAGS},
    "profile_status": TargetSpec("profile_status", "in_set", values=PROFILE_WORDS),
    "low_readiness_risk": TargetSpec("low_readiness_risk", "quantile", "soldier_readiness", q=0.25),
    "low_retention_risk": TargetSpec("low_retention_risk", "threshold", "retention_rate", cut=0.85),
}

# --- table types ----------------------------------------------------------------------------------

_INTEGERS = ["overweight", "acft_failure", *DERIVED_FLAGS, *OBSERVED_FLAGS]
_TEXTS = [
    KEY,
    *PERSON,
    *UNIT_LEVELS,
    *FINE_UNIT_LEVELS,
    *JUMP_KIND,
    *SURVEY_TEXT,
    "profile_status",
    "soldier_readiness_bin",
]


def column_type(name: str) -> T.DataType:
    """Type of a soldier-table column, raw spellings included; unknown columns are text."""
    name = SPELLING_FIXES.get(name, name)
    if name in _INTEGERS:
        return T.IntegerType()
    if name in RISK_FEATURES.numeric or name in SCORES:
        return T.DoubleType()
    return T.StringType()


def table_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(c), True) for c in columns])


SOLDIER_SCHEMA = table_schema(
    list(dict.fromkeys([*_TEXTS[:-1], *RISK_FEATURES.numeric, *OBSERVED_FLAGS, *SCORES]))
)
