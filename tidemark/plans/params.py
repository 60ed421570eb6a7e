"""Constants and run parameters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

# Fixed values that results depend on.
EPSILON = 1e-10
SHORT, MEDIUM, LONG = (5, 10), (20, 50), (100,)
HURST_DEFAULT, HURST_MIN_POINTS, HURST_LAGS = 0.5, 20, (2, 20)
HURST_FREE, HURST_PENALTY_MAX = 0.50, 0.70
SUTTE_PERIOD, SUTTE_THRESHOLD, SUTTE_MIN_HISTORY = 3, 0.02, 10
DIVERGENCE_WINDOW, DIVERGENCE_THRESHOLD = 20, 0.10
SUTTE_BOOST, SUTTE_PENALTY = 0.30, 0.50
TYPICAL_MIN, TYPICAL_MAX = 0.30, 0.80
ATTENTION_MULTIPLIER, ATTENTION_MIN_HISTORY = 8, 20
ATTENTION_TOP_K, ATTENTION_TEMPERATURE = 12, 0.35
PERIODIC_TOP_K, PERIODIC_TEMPERATURE = 8, 0.20
CONTEXT_CLIP, IQR_TO_STD, MAD_TO_STD = 5.0, 1.349, 1.4826
AR_LAGS, AR_MIN_SAMPLES, AR_TOLERANCE = 3, 10, 0.75
CONTEXT_BONUS = 0.35
HOLD_MULTIPLIER, MIN_HOLD = 1.5, 5
CALIBRATION_BINS, CALIBRATION_MIN_SAMPLES, CALIBRATION_BLEND = 7, 25, 0.65
CV_SPLITS, CV_TRAIN_MULTIPLIER = 5, 3
REGIME_RECENT, REGIME_BASELINE, REGIME_HALF_LIFE = 20, 80, 20
REGIME_HIGH, REGIME_LOW = 1.5, 0.67
BOOTSTRAP_SAMPLES, BOOTSTRAP_PERCENTILES, SEED = 500, (5.0, 50.0, 95.0), 42
DIAGNOSTIC_SAMPLES, DIAGNOSTIC_LEVELS, AUTO_PERCENTILE = 500, (0.1, 0.2, 0.3, 0.4, 0.5), 70.0
THRESHOLD_BOUNDS = (0.10, 0.50)
DISPLAY_THRESHOLD = 0.55
ATTENTION_WEIGHTS = {
    "hl_range_pct": 1.10,
    "oc_range_pct": 0.90,
    "vol_ratio_20": 1.30,
    "trend_strength_5": 0.85,
    "trend_strength_20": 1.10,
    "hurst_20": 1.25,
    "rsi_5": 0.70,
    "rsi_20": 0.85,
    "body_to_range_ratio": 1.10,
    "wick_balance": 1.00,
    "sutte_signal": 1.15,
    "sutte_conviction": 1.05,
    "minute_sin": 0.50,
    "minute_cos": 0.50,
    "dow_sin": 0.35,
    "dow_cos": 0.35,
}
PERIODIC_WEIGHTS = {"minute_sin": 1.00, "minute_cos": 1.00, "dow_sin": 0.80, "dow_cos": 0.80}
COMPONENTS = (
    "contraction",
    "range",
    "position",
    "hurst",
    "attention",
    "periodic",
    "scale",
    "sutte",
)
#: Ranges that the parameter search draws from.
SEARCH = {
    "lookback": (5, 50),
    "lookforward": (5, 30),
    "min_bars": (3, 15),
    "threshold": (0.10, 0.50),
    "weight": (0.1, 0.5),
    "max_hold": (5, 30),
    "steepness": (1.0, 5.0),
    "logistic_threshold": (0.3, 1.5),
    "range_threshold": (1.0, 3.0),
    "position_sensitivity": (0.5, 2.0),
    "min_expansion": (1.1, 2.0),
}


@dataclass(frozen=True)
class Params:
    """One setting of the detector and the breakout predictor."""

    lookback: int = 20
    lookforward: int = 10
    min_bars: int = 5
    range_threshold: float = 2.0
    position_sensitivity: float = 1.0
    threshold: float = 0.30
    min_expansion: float = 1.2
    max_hold: int = 15
    steepness: float = 2.0
    logistic_threshold: float = 0.5
    weight_contraction: float = 0.125
    weight_range: float = 0.125
    weight_position: float = 0.125
    weight_hurst: float = 0.125
    weight_attention: float = 0.125
    weight_periodic: float = 0.125
    weight_scale: float = 0.125
    weight_sutte: float = 0.125

    @property
    def history(self) -> int:
        """Rows that a full window is compared with."""
        return max(ATTENTION_MIN_HISTORY, ATTENTION_MULTIPLIER * self.lookback)

    @property
    def reach(self) -> int:
        """Rows before a row that its score and the zones that act on it read."""
        return max(self.lookback + self.history + 1, self.max_hold + self.lookback, MIN_HOLD, 10)

    @property
    def hold_rows(self) -> int:
        """Rows that a zone acts on, at most."""
        return max(self.max_hold, MIN_HOLD)

    def weight(self, component: str) -> float:
        return getattr(self, f"weight_{component}")

    def normalised(self) -> Params:
        """The same with weights that sum to one."""
        total = sum(self.weight(c) for c in COMPONENTS)
        return replace(self, **{f"weight_{c}": self.weight(c) / total for c in COMPONENTS}) if total else self

    def digest(self) -> str:
        """Eight hex digits that name the setting."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:8]
