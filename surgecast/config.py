"""Granularity parameters and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
WEEK_US = 7 * DAY_US
# 1970-01-01 was a Thursday; shifting by three days puts week starts on Mondays.
WEEK_OFFSET_US = 3 * DAY_US


@dataclass(frozen=True)
class Granularity:
    code: str
    step_us: int
    offset_us: int
    interval: str            # Spark/DuckDB interval literal for one step
    lags: tuple              # nowcast lags (W1)
    rolling: tuple           # nowcast rolling windows (W3)
    ema_spans: tuple         # nowcast EMA spans (W4)
    season: int | None       # past-only season S (W5); None when not supported
    ttl_us: int | None       # online-store time-to-live (W13)


# lag/rolling/EMA sets, seasons and TTLs per granularity.
GRANULARITIES = {
    "H": Granularity("H", HOUR_US, 0, "1 hour", (1, 6, 12, 24), (6, 12, 24), (12, 24, 48), 24, 48 * HOUR_US),
    "D": Granularity("D", DAY_US, 0, "1 day", (1, 7, 14, 28), (7, 14, 28), (7, 14, 28), 7, 14 * DAY_US),
    "W": Granularity("W", WEEK_US, WEEK_OFFSET_US, "7 days", (1, 4, 12, 52), (4, 12, 26), (4, 12, 26), None, None),
}


def granularity(code: str) -> Granularity:
    key = (code or "").upper()
    if key not in GRANULARITIES:
        raise ValueError(f"unknown granularity {code!r}; known: {', '.join(GRANULARITIES)}")
    return GRANULARITIES[key]


# Residual-sigma fallbacks when a series is too short to fit (D, H).
FALLBACK_SIGMA = {"D": 48.65, "H": 0.21}
DEFAULT_FALLBACK_SIGMA = 50.0

# Monte-Carlo VaR setup.
N_SIMULATIONS = 10_000
VAR_SEED = 42

# Validation bounds, gates and thresholds.
VOLUME_MIN = 0.0
VOLUME_MAX = 1_000_000.0
MIN_ROWS_GATE = 30
MIN_TRAIN_ROWS = 40
HOLDOUT_FRACTION = 0.8
GARCH_MIN_RESIDUALS = 30
HOUR_SIGMA_MIN_COUNT = 20
HOUR_SIGMA_FLOOR = 0.5
RECENT_WINDOW = 60
DATA_DRIFT_SHARE = 0.10
CONCEPT_DRIFT_THRESHOLD = 0.15
MAX_REASONABLE_VOLUME = 100_000
RATE_LIMIT_PER_MINUTE = 60
RANGE_FILTER_MIN_TS = "2009-01-01 00:00:00"

# Timestamp column priority list used to find the event time.
TS_CANDIDATES = ("tpep_pickup_datetime", "lpep_pickup_datetime", "pickup_datetime",
                 "CreatedStamp", "createdstamp", "TimePeriod")

# Declared feature lists of the daily and hourly feature views.
FEATURE_VIEW_FIELDS = {
    "D": ("Volume_Lag1", "Volume_LagDelta1", "Volume_Lag7", "Volume_LagDelta7",
          "Sin_DayOfWeek", "Cos_DayOfWeek", "Sin_WeekOfYear", "Cos_WeekOfYear",
          "Regime_0", "Regime_1", "Regime_2"),
    "H": ("Volume_Lag1", "Volume_LagDelta1", "Volume_Lag6", "Volume_LagDelta6",
          "Volume_Lag12", "Volume_LagDelta12", "Volume_Lag24", "Volume_LagDelta24",
          "Sin_Hour", "Cos_Hour", "Regime_0", "Regime_1", "Regime_2"),
}

# Boosted-tree settings of the forecast and the nowcast model.
GBT_TREES = 300
GBT_NOWCAST_TREES = 100
GBT_STEP = 0.05
GBT_LEAVES = 31
GBT_MIN_INSTANCES = 15
GBT_NOWCAST_MIN_INSTANCES = 20
# A holdout of fewer rows than this (train and test) has trees of fewer leaves.
GBT_SMALL_ROWS = 200
GBT_SMALL_LEAVES = 15

# Inputs of the forecast model, by granularity.
FORECAST_FIELDS = {
    "D": ("Lag1", "LagS", "PrevDelta1", "PrevDeltaS", "RollMean", "RollStd",
          "Sin_DayOfWeek", "Cos_DayOfWeek", "Sin_WeekOfYear", "Cos_WeekOfYear"),
    "H": ("Lag1", "LagS", "PrevDelta1", "PrevDeltaS", "RollMean", "RollStd",
          "Sin_DayOfWeek", "Cos_DayOfWeek", "Sin_WeekOfYear", "Cos_WeekOfYear", "Sin_Hour", "Cos_Hour"),
}

# Latency bucket bounds (seconds).
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

# Accepted request fields.
REQUEST_GRANULARITIES = ("D", "H")
REQUEST_CONFIDENCE_RANGE = (0.5, 0.9999)
REQUEST_PERIOD_MAX_LEN = 20
REQUEST_PERIOD_PATTERN = r"^[0-9T:Z-]*$"

# Columns a PII report may never drop.
PII_KEEP = ("CreatedStamp", "createdstamp", "TimePeriod", "Volume")
