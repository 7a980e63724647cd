from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import READINGS, at
from wattloom.operators.regular_grid import GAP, INTERPOLATED, OBSERVED, regular_grid
from wattloom.operators.rolling import rolling_totals


def rolled(spark, rows, **kw):
    df = spark.createDataFrame(rows, READINGS)
    out = rolling_totals(df, "zone_id", "datetime", "load_mw", **kw)
    return {(r["entity_id"], str(r["activity_day"])): r for r in out.collect()}


def test_inactive_days_and_fixed_denominators(spark):
    rows = [(1, 7, at("2020-02-27T05:00"), 10.0), (2, 7, at("2020-02-27T06:00"), 20.0), (3, 7, at("2020-03-01T00:00"), 6.0)]
    out = rolled(spark, rows, periods=(2, 7))
    assert sorted(d for _, d in out) == ["2020-02-27", "2020-02-28", "2020-02-29", "2020-03-01"]
    leap = out[7, "2020-02-29"]
    assert (leap["n_readings"], leap["day_total"], leap["total_2d"], leap["mean_reading_2d"]) == (0, 0.0, 0.0, None)
    last = out[7, "2020-03-01"]
    assert last["total_7d"] == 36.0 and last["avg_7d"] == pytest.approx(36 / 7) and last["mean_reading_7d"] == 12.0 and last["active_days_7d"] == 2


def test_unusable_rows_repeats_and_clashing_columns(spark):
    rows = [(1, 1, at("2020-01-01T00:00"), 1.0), (2, 1, at("2020-01-01T00:00"), 1.0), (3, 1, at("2020-01-02T00:00"), float("nan")), (4, 1, at("2020-01-03T00:00"), 2.0), (5, None, at("2020-01-01T00:00"), 5.0), (6, 1, None, 5.0), (7, 2, at("2020-01-01T00:00"), None)]
    df = spark.createDataFrame(rows, READINGS).withColumns({"entity_id": F.lit("x"), "activity_day": F.lit(0), "value": F.lit(None), "day": F.lit(1)})
    out = {str(r["activity_day"]): r for r in rolling_totals(df, "zone_id", "datetime", "load_mw").collect()}
    assert out["2020-01-01"]["n_readings"] == 2 and out["2020-01-02"]["n_readings"] == 0 and len(out) == 3
    assert rolling_totals(df.limit(0), "zone_id", "datetime", "load_mw").count() == 0


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 3), at(f"2021-{rng.randint(1, 3):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:00"), float(rng.randint(-5, 50))) for i in range(120)]
    out = rolled(spark, rows)
    for (zone, day), r in out.items():
        d = at(day)
        inside = [v for _, z, t, v in rows if z == zone and 0 <= (d.date() - t.date()).days < 30]
        assert r["total_30d"] == pytest.approx(sum(inside)) and r["readings_30d"] == len(inside)


def pchip(xs, ys, x):
    """Monotone cubic by the textbook, for one segment."""
    h, d = np.diff(xs).astype(float), np.diff(ys) / np.diff(xs)
    n = len(xs)
    m = np.zeros(n)
    if n == 2:
        m[:] = d[0]
    else:
        for i in range(1, n - 1):
            if d[i - 1] * d[i] > 0:
                w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])
        for i, (h0, d0, h1, d1) in ((0, (h[0], d[0], h[1], d[1])), (n - 1, (h[-1], d[-1], h[-2], d[-2]))):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[i] = 0 if np.sign(v) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v
    i = np.searchsorted(xs, x) - 1
    s = (x - xs[i]) / h[i]
    return (2 * s**3 - 3 * s**2 + 1) * ys[i] + (s**3 - 2 * s**2 + s) * h[i] * m[i] + (3 * s**2 - 2 * s**3) * ys[i + 1] + (s**3 - s**2) * h[i] * m[i + 1]


@pytest.mark.parametrize("shard", [4, 16, 1024])
def test_grid_is_the_same_for_any_sharding(spark, shard):
    rng = random.Random(11)
    hours = sorted(rng.sample(range(90), 40)) + [130, 131, 133]
    rows = [(i, 5, at("2020-01-01T00:00") + __import__("datetime").timedelta(hours=h, minutes=rng.randint(0, 59)), rng.uniform(0, 9)) for i, h in enumerate(hours)]
    out = regular_grid(spark.createDataFrame(rows, READINGS), "zone_id", "datetime", "load_mw", 3600, 4, shard).orderBy("period_start").collect()
    assert len(out) == hours[-1] - hours[0] + 1 and out[0]["period_start"] == at("2020-01-01T00:00") + __import__("datetime").timedelta(hours=hours[0])
    value = {h: r[3] for h, r in zip(hours, rows, strict=True)}
    segments, seg = [], [hours[0]]
    for a, b in zip(hours, hours[1:]):
        if b - a > 5:
            segments.append(seg)
            seg = []
        seg.append(b)
    segments.append(seg)
    for i, r in enumerate(out):
        h = hours[0] + i
        if h in value:
            assert r["status"] == OBSERVED and r["value"] == pytest.approx(value[h])
            continue
        seg = next((s for s in segments if s[0] < h < s[-1]), None)
        if seg is None:
            assert r["status"] == GAP and r["value"] is None
        else:
            assert r["status"] == INTERPOLATED and r["value"] == pytest.approx(pchip(np.array(seg), np.array([value[x] for x in seg]), h), abs=1e-9)


def test_grid_edges(spark):
    rows = [(1, 1, at("2020-01-01T23:59:59"), 4.0), (2, 1, at("2020-01-01T23:00:00"), 6.0), (3, 2, None, 1.0), (4, None, at("2020-01-01T00:00"), 1.0), (5, 3, at("2020-01-01T00:00"), float("nan"))]
    df = spark.createDataFrame(rows, READINGS).withColumns({"p": F.lit(1), "v": F.lit("a"), "shard": F.lit(None), "halo": F.lit(1)})
    out = regular_grid(df, "zone_id", "datetime", "load_mw", 3600, 3).collect()
    assert [(r["entity_id"], str(r["period_start"]), r["value"], r["status"], r["n_readings"]) for r in out] == [(1, "2020-01-01 23:00:00", 5.0, OBSERVED, 2)]
    assert regular_grid(df.limit(0), "zone_id", "datetime", "load_mw", 3600, 3).count() == 0
    with pytest.raises(ValueError):
        regular_grid(df, "zone_id", "datetime", "load_mw", 7000, 3)


def test_interpolation_keeps_the_shape(spark):
    rows = [(i, 1, at("2020-01-01T00:00") + __import__("datetime").timedelta(hours=3 * i), v) for i, v in enumerate((0.0, 0.0, 1.0, 1.0, 10.0, 10.0))]
    out = [r["value"] for r in regular_grid(spark.createDataFrame(rows, READINGS), "zone_id", "datetime", "load_mw", 3600, 3).orderBy("period_start").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(out, out[1:])) and not any(math.isnan(x) for x in out)
