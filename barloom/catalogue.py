"""Timeframes and constants. All numbers here are fixed values that results depend on."""

from __future__ import annotations

#: Timeframe: (minutes, role, swing length, exhaustion %, Fibonacci bars, least pattern count), from the highest down.
TIMEFRAMES: dict[str, tuple[int, str, int, float, int, int]] = {
    "1W": (10080, "macro", 8, 6.0, 20, 3),
    "1D": (1440, "macro", 10, 4.0, 20, 5),
    "4H": (240, "context", 10, 2.5, 50, 5),
    "1H": (60, "context", 10, 1.5, 50, 10),
    "30M": (30, "phase", 10, 1.0, 100, 15),
    "15M": (15, "phase", 8, 0.8, 100, 20),
    "5M": (5, "exec", 8, 0.5, 200, 30),
    "1M": (1, "exec", 5, 0.3, 300, 30),
}
ORDER = list(TIMEFRAMES)
PARENT = dict(zip(ORDER[1:], ORDER[:-1]))
MINUTES = {tf: v[0] for tf, v in TIMEFRAMES.items()}
ROLE = {tf: v[1] for tf, v in TIMEFRAMES.items()}
SWING_BARS = {tf: v[2] for tf, v in TIMEFRAMES.items()}
EXHAUSTION = {tf: v[3] for tf, v in TIMEFRAMES.items()}
FIB_BARS = {tf: v[4] for tf, v in TIMEFRAMES.items()}
MIN_COUNT = {tf: v[5] for tf, v in TIMEFRAMES.items()}
MIN_COUNT_GLOBAL = 10

MACD_SPANS = (12, 26, 9)
STOCH_BARS, STOCH_SMOOTH, STOCH_HIGH, STOCH_LOW = 14, 3, 80, 20
MA_SPANS = {"ema8": 8, "ema21": 21, "sma50": 50, "sma200": 200}
FIB_RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
NEAR_PCT = 0.3
MIN_MOVE_BARS = 3

HOLDOUT_QUANTILE, HOLDOUT_WR, HOLDOUT_GAP = 0.75, 0.55, 0.10
WINDOWS, OVERLAP, MAX_WR_STD, MIN_EDGE_SHARE, WR_EDGE = 5, 0.5, 0.15, 0.70, 0.55
KNN_SIMILARITY, KNN_MIN, KNN_EXCLUDED = 0.75, 10, 120
HORIZONS = (30, 60, 120)
TAKE_PROFIT, STOP_LOSS, HOLD = 0.015, 0.007, 240
COMBO_WR, COMBO_N, COMBO_TRADES, COMBO_SIZE = 0.57, 500, 3, 4


def ratio_name(ratio: float) -> str:
    """0.236 is 0236."""
    return str(ratio).replace(".", "")
