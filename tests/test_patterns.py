"""R1/R3/R4 on hand-made monthly series against a brute-force numpy implementation of the rules."""

import datetime as dt
import math

import numpy as np
import pytest

from salescope.functions.series import RCRIT, critical_r
from salescope.operators import patterns
from tests.helpers import add_months, make_tables, sales_row

AS_OF = dt.date(2002, 1, 1)
START = dt.date(2000, 1, 15)

SERIES = {
    "const12": [100] * 12,
    "spike8": [100, 101, 99, 100, 102, 98, 100, 1000],
    "drop8": [1000, 1001, 999, 1000, 1002, 998, 1000, 10],
    "lag3": [10, 50, 90, 20, 30, 40, 25, 35, 45, 11, 52, 88],
    "trend6": [10, 20, 30, 40, 50, 61],
    "trend7_weak": [10, 30, 20, 40, 30, 50, 35],
    "trend8": [80, 70, 75, 60, 55, 50, 52, 40],
    "two": [5, 7],
    "three": [5, 7, 6],
    "season24": [round(100 + 60 * math.sin(2 * math.pi * i / 12) + (i % 5), 2) for i in range(24)],
    "lag6_only": [10, 80, 15, 70, 20, 60, 12, 79, 17, 71, 19, 61, 30, 31],
    "stable_noise": [100, 103, 98, 101, 99, 102, 100, 97, 101, 100],
    "moderate": [100, 140, 90, 130, 80, 120, 95, 125],
    "fluct": [10, 200, 30, 180, 5, 220, 15, 190, 25],
}


def t_pvalue(r: float, n: int) -> float:
    """Two-sided p of a Pearson r by numerical integration of the Student-t density."""
    df = n - 2
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt(df / (1 - r * r))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    xs = np.linspace(t, t + 2000, 2_000_001)
    ys = c * (1 + xs * xs / df) ** (-(df + 1) / 2)
    return float(2 * np.trapezoid(ys, xs))


def brute(sales):
    x = np.array(sales, dtype=float)
    n = len(x)
    if n < 3:
        return dict(pattern="Insufficient Data", seasonal_lag=None, anomaly_count=None, has_trend=None,
                    trend_direction=None)
    mean, std = x.mean(), x.std()
    cv = std / mean if mean > 0 else 0
    lag_hit = None
    if n >= 12:
        for lag in (3, 6, 12):
            if n >= 2 * lag:
                a, b = x[:lag], x[-lag:]
                if a.std() > 0 and b.std() > 0 and np.corrcoef(a, b)[0, 1] > 0.7:
                    lag_hit = lag
                    break
    z = np.abs(x - mean) / std if std > 0 else np.zeros(n)
    anom = np.where(z > 2.5)[0] if std > 0 else np.array([], dtype=int)
    if n >= 6:
        idx = np.arange(n)
        slope = np.polyfit(idx, x, 1)[0] if std > 0 else 0.0
        r = np.corrcoef(idx, x)[0, 1] if std > 0 else 0.0
        has_trend = bool(abs(r) > 0.7 and t_pvalue(r, n) < 0.05)
        direction = "increasing" if slope > 1e-12 else "decreasing"
    else:
        has_trend, direction = False, "none"
    if len(anom):
        pattern = "Strange (Spike)" if x[anom].mean() > mean else "Strange (Drop)"
    elif lag_hit:
        pattern = "Seasonal"
    elif cv < 0.2:
        pattern = "Stable"
    elif cv > 0.5:
        pattern = "Fluctuating"
    else:
        pattern = "Moderate Variation"
    return dict(pattern=pattern, seasonal_lag=lag_hit, anomaly_count=len(anom), has_trend=has_trend,
                trend_direction=direction, cv=round(cv, 3))


@pytest.fixture(scope="module")
def series_sales(spark):
    rows = []
    for code, vals in SERIES.items():
        for i, v in enumerate(vals):
            rows.append(sales_row(add_months(START, i), v, Item_Code=code, Item_Desc=f"desc {code}", Brand="B"))
    return make_tables(spark, rows).sales


def test_critical_r_matches_published_values():
    assert [round(RCRIT[n], 6) for n in (6, 7, 8)] == [0.811401, 0.754492, 0.706734]
    assert round(critical_r(9), 6) == 0.666384 and 9 not in RCRIT
    for n in (6, 8, 12):  # p at the critical r is 0.05 by integration too
        assert abs(t_pvalue(critical_r(n), n) - 0.05) < 1e-6


def test_item_pattern_matches_brute_force(series_sales):
    got = {r["Item_Code"]: r.asDict() for r in
           patterns.item_pattern(series_sales, as_of=AS_OF, months=80).collect()}
    assert set(got) == set(SERIES)
    for code, vals in SERIES.items():
        exp = brute(vals)
        g = got[code]
        for k in ("pattern", "seasonal_lag", "anomaly_count", "has_trend", "trend_direction"):
            assert g[k] == exp[k], (code, k, g[k], exp[k])
        if "cv" in exp:
            assert abs(g["cv"] - exp["cv"]) <= 0.0011, (code, g["cv"], exp["cv"])
    assert got["const12"]["pattern"] == "Stable" and got["const12"]["cv"] == 0.0
    assert got["spike8"]["pattern"] == "Strange (Spike)" and got["drop8"]["pattern"] == "Strange (Drop)"
    assert got["lag3"]["pattern"] == "Seasonal" and got["lag3"]["seasonal_lag"] == 3
    assert got["two"]["pattern"] == "Insufficient Data" and got["two"]["cv"] is None
    assert got["lag3"]["peak_months"].count(",") == 2
    assert got["lag3"]["planning_implication"].startswith("Stock up 2 months prior to peak (")


def test_anomalies_match_brute_force(series_sales):
    got = {(r["Item_Code"], r["Month"]): r for r in
           patterns.anomalies(series_sales, as_of=AS_OF, months=80).collect()}
    exp = set()
    for code, vals in SERIES.items():
        x = np.array(vals, dtype=float)
        if len(x) < 3 or x.std() == 0:
            continue
        for i in np.where(np.abs(x - x.mean()) / x.std() > 2.5)[0]:
            d = add_months(START, int(i))
            exp.add((code, f"{d.year}-{d.month:02d}"))
    assert set(got) == exp
    assert got[("spike8", "2000-08")]["Type"] == "Spike"
    x = np.array(SERIES["spike8"], dtype=float)
    assert abs(got[("spike8", "2000-08")]["Z_Score"] - abs(x[-1] - x.mean()) / x.std()) < 1e-6
    assert got[("spike8", "2000-08")]["Z_Score"] <= math.sqrt(7)  # |z| <= sqrt(n-1)


def test_run_rate_bands(spark):
    rows = []
    for brand, vals in {"VS": [100, 101, 99, 100], "ST": [100, 130, 80, 100], "UN": [10, 300, 20, 250],
                        "IN": [100, 100]}.items():
        for i, v in enumerate(vals):
            rows.append(sales_row(add_months(dt.date(2001, 9, 10), i), v, Brand=brand))
    sales = make_tables(spark, rows).sales
    got = {r["Brand"]: r for r in patterns.run_rate_stability(sales, as_of=AS_OF, months=12).collect()}
    for b, vals in {"VS": [100, 101, 99, 100], "ST": [100, 130, 80, 100], "UN": [10, 300, 20, 250]}.items():
        x = np.array(vals, dtype=float)
        cv = x.std() / x.mean()
        exp = "Very Stable" if cv < .15 else "Stable" if cv < .3 else "Moderate" if cv < .5 else "Unstable"
        assert got[b]["stability"] == exp and abs(got[b]["cv"] - round(cv, 3)) < 1e-9
        assert got[b]["min_monthly_sales"] == min(vals) and got[b]["max_monthly_sales"] == max(vals)
    assert got["IN"]["stability"] == "Insufficient Data" and got["IN"]["cv"] is None
