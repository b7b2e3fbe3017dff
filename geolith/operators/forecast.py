"""Series forecasts: linear, ARIMA(1,1,1), their hybrid, and the choice among them.

A series is one group of some dozen points; the groups are dealt by Spark.
ARIMA is fitted by least squares of the conditional errors on a grid, not by
maximum likelihood.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MIN_ARIMA, MIN_HYBRID, MIN_HYBRID_CHOICE = 8, 12, 14


def linear(y: np.ndarray, steps: int) -> np.ndarray:
    t = np.arange(len(y))
    slope, level = np.polyfit(t, y, 1)
    return level + slope * (len(y) + np.arange(steps))


def _errors(d: np.ndarray, mean: float, ar: float, ma: float) -> np.ndarray:
    out, before = np.zeros(len(d)), 0.0
    for i in range(1, len(d)):
        before = out[i] = d[i] - mean - ar * (d[i - 1] - mean) - ma * before
    return out


def arima(y: np.ndarray, steps: int) -> np.ndarray:
    """ARIMA(1,1,1) by conditional least squares; the line where the series is too short."""
    if len(y) < MIN_ARIMA:
        return linear(y, steps)
    d = np.diff(y)
    mean = d.mean()
    ar, ma = min(
        ((a, m) for a in np.linspace(-0.9, 0.9, 19) for m in np.linspace(-0.9, 0.9, 19)),
        key=lambda p: float(np.square(_errors(d, mean, *p)).sum()),
    )
    change, error, level, out = d[-1], _errors(d, mean, ar, ma)[-1], y[-1], []
    for _ in range(steps):
        change = mean + ar * (change - mean) + ma * error
        error, level = 0.0, level + change
        out.append(level)
    return np.array(out)


def hybrid(y: np.ndarray, steps: int) -> np.ndarray:
    """The line plus an ARIMA of what it leaves."""
    if len(y) < MIN_HYBRID:
        return linear(y, steps)
    t = np.arange(len(y))
    slope, level = np.polyfit(t, y, 1)
    return linear(y, steps) + arima(y - level - slope * t, steps)


METHODS = {"linear": linear, "arima": arima, "hybrid": hybrid}


def rolling_mape(y: np.ndarray, method: str) -> float:
    """Mean relative error of one-step forecasts from the last origins; infinite with too few points."""
    if len(y) <= 10:
        return float("inf")
    errors = [
        abs(METHODS[method](y[:i], 1)[0] - y[i]) / max(abs(y[i]), 1e-9) for i in range(max(10, len(y) - 8), len(y))
    ]
    return float(np.mean(errors))


def choose(y: np.ndarray) -> str:
    names = ["linear", "arima", *(["hybrid"] if len(y) >= MIN_HYBRID_CHOICE else [])]
    return min(names, key=lambda n: (rolling_mape(y, n), names.index(n)))


def confidence(mape: float) -> float:
    """From the error as a fraction set against 25: small errors all give 0.95."""
    return 0.35 if not np.isfinite(mape) else float(np.clip(1 - mape / 25, 0.1, 0.95))


def forecast(series: DataFrame, key: str, t: str, y: str, periods: int = 3, method: str = "auto", ratio: bool = False) -> DataFrame:
    """(key, step, forecast, method, mape, confidence, trend) for every series.

    Under two points the last value is repeated with confidence 0.3. Values are
    never negative; ratios stay within 0 and 1. The trend is increasing or decreasing beyond 1 %.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(t)[y].dropna().to_numpy(float)
        if len(values) < 2:
            name, mape, sure = "naive", float("inf"), 0.3
            ahead = np.full(periods, values[-1] if len(values) else 0.0)
        else:
            name = choose(values) if method == "auto" else method
            ahead, mape = METHODS[name](values, periods), rolling_mape(values, name)
            sure = confidence(mape)
        ahead = np.clip(np.nan_to_num(ahead), 0.0, 1.0 if ratio else None)
        last = values[-1] if len(values) else 0.0
        change = (ahead[-1] - last) / abs(last) if last else 0.0
        trend = "increasing" if change > 0.01 else "decreasing" if change < -0.01 else "stable"
        return pd.DataFrame(
            {
                key: pdf[key].iloc[0], "step": np.arange(1, periods + 1), "forecast": ahead, "method": name,
                "mape": mape if np.isfinite(mape) else None, "confidence": sure, "trend": trend,
            }
        )

    return series.select(key, t, y).groupBy(key).applyInPandas(
        run, f"`{key}` string, step int, forecast double, method string, mape double, confidence double, trend string"
    )


def register_forecast_function(spark, name: str = "series_forecast") -> None:
    """Makes ``SELECT * FROM t, LATERAL series_forecast(values, periods)`` known: step and forecast of an array of values."""
    from pyspark.sql.functions import udtf

    class SeriesForecast:
        def eval(self, values: list, periods: int):
            y = np.array([v for v in values or [] if v is not None], float)
            ahead = METHODS[choose(y)](y, periods) if len(y) >= 2 else np.full(periods, y[-1] if len(y) else 0.0)
            for step, value in enumerate(np.maximum(0.0, np.nan_to_num(ahead)), 1):
                yield step, float(value)

    spark.udtf.register(name, udtf(SeriesForecast, returnType="step int, forecast double"))
