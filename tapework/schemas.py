"""Declared schemas and the fixed values every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")

# Fixed column order of the canonical bar.
CANONICAL = ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")

BAR = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

# Raw landing file; every value is read as text and cast after renaming, so one bad cell
# becomes NULL instead of failing a whole file.
RAW_CSV = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume")
])

METRICS = T.StructType([
    T.StructField(n, T.DoubleType())
    for n in ("mae", "rmse", "ic", "dir_acc", "sharpe", "max_dd", "hit_rate")
])

# A linear model over standardised features; the arrays follow the order of ``features``.
PARAMETERS = T.StructType([
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("scale", T.ArrayType(T.DoubleType())),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
])

REGISTRY = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("fold", T.LongType()),
    T.StructField("lookback", T.LongType()),
    T.StructField("horizon", T.LongType()),
    T.StructField("n_features", T.LongType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("model_formats", T.ArrayType(T.StringType())),
    T.StructField("metrics", METRICS),
    T.StructField("performance_status", T.StringType()),
    T.StructField("prediction_target", T.StringType()),
    T.StructField("scaler", T.StringType()),
    T.StructField("parameters", PARAMETERS),
])

# Lags and window lengths of the training features.
LAGS = (1, 2, 3, 5, 10, 20, 60, 120, 200)
SHIFTED_WINDOWS = (5, 10, 20, 60)
MA_WINDOWS = (5, 10, 20)
EMA_SPANS = (5, 12, 26)
VOL_WINDOWS = (10, 20)
MOMENTUM = 5

# Forecasting and backtest settings.
LOOKBACK = 200
HORIZON = 1
N_SPLITS = 4
WALK_STEP = 25
COST = 0.0001
PERIODS_PER_YEAR = 252

# Instrument display names.
DISPLAY_NAMES = {
    "EURUSD=X": "Euro / US Dollar",
    "GBPUSD=X": "British Pound / US Dollar",
    "USDJPY=X": "US Dollar / Japanese Yen",
    "AUDUSD=X": "Australian Dollar / US Dollar",
    "USDCAD=X": "US Dollar / Canadian Dollar",
    "USDCHF=X": "US Dollar / Swiss Franc",
    "NZDUSD=X": "New Zealand Dollar / US Dollar",
    "EURMAD=X": "Euro / Moroccan Dirham",
    "EURRUB=X": "Euro / Russian Ruble",
    "RUBUSD=X": "Russian Ruble / US Dollar",
}

# Requested period -> (fetch period, interval).
PERIOD_CONFIG = {
    "1d": ("1d", "5m"),
    "5d": ("5d", "5m"),
    "1mo": ("2mo", "1d"),
    "3mo": ("3mo", "1d"),
    "6mo": ("6mo", "1d"),
    "1y": ("1y", "1d"),
    "2y": ("2y", "1d"),
    "5y": ("5y", "1wk"),
    "max": ("max", "1mo"),
}

# Fixed values: (period, interval) tried in this order when a request finds nothing.
FALLBACK_INTERVALS = (("1d", "5m"), ("5d", "1h"), ("1mo", "1d"))

# Minutes per period, and points kept for daily and longer candles.
PERIOD_MINUTES = {"1d": 1440, "5d": 7200, "1mo": 43200, "3mo": 129600, "6mo": 259200, "1y": 525600}
DAILY_POINTS = {"1y": 400, "6mo": 220, "3mo": 120, "1mo": 40, "5d": 120, "1d": 2000}
MAX_POINTS = 6000
DEFAULT_POINTS = 2000

# Fixed value: length of a sequence when a search gives no configuration.
DEFAULT_WINDOW = 30


def training_features(lookback: int = LOOKBACK) -> list[str]:
    """Ordered feature names of the training frame (28 at the default lookback)."""
    names = [f"{p}{s}" for p in PRICES for s in ("", "_log", "_log_return")]
    names.remove("close_log_return")
    names += [f"close_log_return_lag_{k}" for k in LAGS if k <= lookback]
    for k in SHIFTED_WINDOWS:
        if k <= lookback:
            names += [f"close_log_return_mean_{k}", f"close_log_return_std_{k}"]
    return names


TECHNICAL_FEATURES = [
    *PRICES, "close_log", "close_log_return", f"close_momentum_{MOMENTUM}",
    *[f"close_ma_{k}" for k in MA_WINDOWS],
    *[f"close_ema_{k}" for k in EMA_SPANS],
    *[f"close_log_return_vol_{k}" for k in VOL_WINDOWS],
    "high_low_range", "high_low_range_pct", "close_direction",
]
