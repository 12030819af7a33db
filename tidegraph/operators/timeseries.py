"""Unit-root and stationarity tests of series, and bootstrap bands chosen by their outcome."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.resample import block_dates, block_length

# Response surfaces of the unit-root test (MacKinnon 1994), constant and constant with trend:
# largest value of the small-p polynomial, bounds, coefficients of the two polynomials.
ADF_SURFACE = {
    "c": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-2.89, -16.18, 0.70, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}
# Critical values of the stationarity test (Kwiatkowski et al. 1992) at the levels below.
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, float(e @ e), e


def _trend(n: int, spec: str) -> np.ndarray:
    return np.column_stack([np.ones(n), np.arange(1, n + 1)]) if spec == "ct" else np.ones((n, 1))


def adf(x: np.ndarray, spec: str = "c") -> tuple[float, float]:
    """Augmented Dickey-Fuller statistic and p value; lags up to 12 (n/100)^(1/4) by least AIC on a common sample."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - (2 if spec == "c" else 3))
    d = np.diff(x)
    if most < 0 or np.ptp(x) == 0:
        return math.nan, math.nan

    def design(lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(first, len(d))
        cols = [x[rows], *(d[rows - k] for k in range(1, lags + 1))]
        return d[rows], np.column_stack([*cols, _trend(len(rows), spec)])

    def aic(lags: int) -> float:
        y, z = design(lags, most)
        rss = _ols(y, z)[1]
        return len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]

    lags = min(range(most + 1), key=aic)
    y, z = design(lags, lags)
    beta, rss, _ = _ols(y, z)
    cov = rss / (len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)
    stat = float(beta[0] / math.sqrt(cov[0, 0])) if cov[0, 0] > 0 else math.nan
    star, low, high, small, large = ADF_SURFACE[spec]
    if math.isnan(stat):
        return stat, math.nan
    if stat > high:
        return stat, 1.0
    if stat < low:
        return stat, 0.0
    z = sum(c * stat**k for k, c in enumerate(small if stat <= star else large))
    return stat, 0.5 * (1 + math.erf(z / math.sqrt(2)))


def kpss(x: np.ndarray, spec: str = "c") -> tuple[float, float]:
    """KPSS statistic and p value (between 0.01 and 0.10, by interpolation), bandwidth chosen from the data (Hobijn et al. 1998)."""
    n = len(x)
    e = _ols(x, _trend(n, spec))[2]
    cov = lambda k: float(e[k:] @ e[: n - k]) / n
    c0 = cov(0)
    if c0 <= 0:
        return math.nan, math.nan
    many = int(n ** (2 / 9))
    s0 = c0 + 2 * sum(cov(k) for k in range(1, many + 1))
    s1 = 2 * sum(k * cov(k) for k in range(1, many + 1))
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
    long_run = c0 + 2 * sum((1 - k / (lags + 1)) * cov(k) for k in range(1, lags + 1))
    if long_run <= 0:
        return math.nan, math.nan
    stat = float(np.sum(np.cumsum(e) ** 2) / n**2 / long_run)
    return stat, float(np.interp(stat, KPSS_CRITICAL[spec], KPSS_LEVELS))


def _kind(p_adf: float, p_kpss: float) -> str:
    if not (math.isfinite(p_adf) and math.isfinite(p_kpss)):
        return "test_incomplete"
    if p_adf < 0.05:
        return "stationary" if p_kpss >= 0.05 else "inconclusive"
    return "unit_root" if p_kpss < 0.05 else "inconclusive"


def conclusion(level: str, trend: str) -> str:
    """What the tests with a constant and with a trend say together."""
    if level == "stationary":
        return "level_stationary"
    if level == "unit_root" and trend == "stationary":
        return "trend_stationary"
    if level == "unit_root" and trend == "unit_root":
        return "unit_root_I1"
    return "inconclusive"


def test_row(x: np.ndarray) -> tuple:
    """n_obs, the eight figures (6 places) and the conclusion of one series."""
    if len(x) < 20:
        return (len(x), *[None] * 8, "insufficient")
    figures = [round(v, 6) for spec in ("c", "ct") for f in (adf, kpss) for v in f(x, spec)]
    said = conclusion(_kind(figures[1], figures[3]), _kind(figures[5], figures[7]))
    return (len(x), *(None if math.isnan(v) else v for v in figures), said)


test_row.__test__ = False
_TEST_COLUMNS = "n_obs long, adf_c double, adf_c_p double, kpss_c double, kpss_c_p double, adf_ct double, adf_ct_p double, kpss_ct double, kpss_ct_p double, conclusion string"


def stationarity(series: DataFrame, key: str) -> DataFrame:
    """One row a series (``key, t, value``, nulls dropped): ADF and KPSS with a constant and with a trend, and the conclusion. A series is as long as the calendar."""
    names = ["n_obs", "adf_c", "adf_c_p", "kpss_c", "kpss_c_p", "adf_ct", "adf_ct_p", "kpss_ct", "kpss_ct_p", "conclusion"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("t")["value"].to_numpy(float)
        return pd.DataFrame([(rows[key].iloc[0], *test_row(x))], columns=[key, *names])

    kind = series.schema[key].dataType.simpleString()
    return series.where(F.col("value").isNotNull()).groupBy(key).applyInPandas(run, f"{key} {kind}, {_TEST_COLUMNS}")


def bootstrap_band(series: DataFrame, said: str, n: int, ci: tuple[float, float] = (0.05, 0.95), seed: int = 42) -> DataFrame:
    """``t, value, low, high, scheme``: pointwise quantiles of block-bootstrapped copies of one series (``t, value``).

    Blocks of levels for a stationary series, of residuals from a line for a trend-stationary one, of differences (summed up from the first value) for a unit root and, marked as a
    fallback, for anything else; the length of a block follows from the number of values. Fewer than 20 values raise an error.
    """
    rows = series.where(F.col("value").isNotNull()).select("t", "value", (F.row_number().over(Window.orderBy("t")) - 1).alias("p"))  # one row a date
    size = rows.count()
    if size < 20:
        raise ValueError("a band needs at least 20 values")
    scheme = said if said in ("level_stationary", "trend_stationary", "unit_root_I1") else "unit_root_I1 (FALLBACK)"
    blocks = block_dates(size, n, series.sparkSession, seed)
    if scheme == "level_stationary":
        drawn = blocks.join(rows.select(F.col("p").alias("src"), "value"), "src").select("rep", F.col("t").alias("p"), F.col("value").alias("v"))
    elif scheme == "trend_stationary":
        line = rows.agg(F.regr_slope("value", F.col("p").cast("double")).alias("b"), F.regr_intercept("value", F.col("p").cast("double")).alias("a")).first()
        fit = lambda c: line["a"] + line["b"] * F.col(c)
        rest = rows.select(F.col("p").alias("src"), (F.col("value") - fit("p")).alias("e"))
        drawn = blocks.join(rest, "src").select("rep", F.col("t").alias("p"), (F.col("e") + fit("t")).alias("v"))
    else:
        first = rows.where("p = 0").first()["value"]
        steps = rows.select(F.col("p").alias("src"), (F.lead("value").over(Window.orderBy("p")) - F.col("value")).alias("d")).where("d is not null")
        moved = block_dates(size - 1, n, series.sparkSession, seed, size=block_length(size)).join(steps, "src")
        summed = F.sum("d").over(Window.partitionBy("rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
        start = series.sparkSession.range(n).select((F.col("id") + 1).cast("int").alias("rep"), F.lit(0).alias("p"), F.lit(first).alias("v"))
        drawn = moved.select("rep", (F.col("t") + 1).alias("p"), (first + summed).alias("v")).unionByName(start)
    bands = drawn.groupBy("p").agg(F.percentile("v", F.array(F.lit(ci[0]), F.lit(ci[1]))).alias("q"))
    return rows.join(bands, "p").select("t", "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.lit(scheme).alias("scheme"))
