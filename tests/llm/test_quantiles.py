from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattloom.llm.quantiles import TailSketch, merge_sketches, percentiles, rank_errors, tail_sketches

QS = (0.1, 0.5, 0.9, 0.95, 0.99, 0.999)


def rank_error(sorted_values, q, v):
    """Distance of v's ranks from q n, over the part above q."""
    lo, hi = np.searchsorted(sorted_values, v, "left"), np.searchsorted(sorted_values, v, "right")
    want = q * len(sorted_values)
    return max(0, lo - want, want - hi) / (len(sorted_values) * (1 - q))


@pytest.mark.parametrize("shape", ["lognormal", "rising", "falling", "ties"])
def test_errors_stay_in_proportion_to_the_tail(shape):
    rng = np.random.default_rng(0)
    x = {"lognormal": rng.lognormal(0, 2, 200_000), "rising": np.arange(200_000.0), "falling": -np.arange(200_000.0), "ties": rng.integers(0, 9, 200_000).astype(float)}[shape]
    whole = TailSketch()
    whole.update(x)
    merged = TailSketch()
    for part in np.array_split(x, 37):
        s = TailSketch()
        s.update(part)
        merged.merge(TailSketch.from_bytes(s.to_bytes()))
    y = np.sort(x)
    for s in (whole, merged):
        assert s.n == len(x) == sum(len(v) << h for h, v in enumerate(s.levels)) and s.quantiles([0.0, 1.0]) == [y[0], y[-1]]
        assert all(rank_error(y, q, v) < 0.02 for q, v in zip(QS, s.quantiles(QS), strict=True))
        assert len(s.to_bytes()) < 200_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=80), st.floats(0.01, 0.99))
def test_small_groups_are_exact(values, q):
    s = TailSketch()
    s.update(np.array(values))
    assert s.quantiles([q])[0] == sorted(values)[max(0, int(np.ceil(q * len(values) - 1e-9)) - 1)]


def test_groups_nulls_and_rollup(spark):
    rows = [("a" if i % 3 else None, i % 2, float(i)) for i in range(3000)] + [("a", 0, None), ("a", 0, float("nan")), ("b", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(5).withColumns({"n": F.lit(1), "sketch": F.lit("x"), "part": F.lit(None)})
    days = tail_sketches(df, ["g", "day"], "v")
    got = {(r["g"], r["day"]): (r["n"], r["q"][0]) for r in days.select("g", "day", "n", percentiles("sketch", [0.5]).alias("q")).collect()}
    for g in ("a", None):
        for day in (0, 1):
            values = sorted(v for k, d, v in rows if k == g and d == day and v is not None and v == v)
            assert got[g, day] == (len(values), pytest.approx(values[len(values) // 2 - 1], abs=60))
    assert len(got) == 4
    rolled = {r["g"]: r["n"] for r in merge_sketches(days, ["g"]).collect()}
    assert rolled == {"a": 2000, None: 1000}
    assert tail_sketches(df.limit(0), ["g"], "v").count() == 0 and tail_sketches(df, [], "v").first()["n"] == 3000


@pytest.mark.parametrize("k", [16, 64])
def test_stated_errors_hold_for_all_shapes_and_merges(k):
    rng = np.random.default_rng(k)
    shapes = [rng.random, lambda n: rng.lognormal(0, 3, n), lambda n: np.sort(rng.random(n)), lambda n: -np.sort(rng.random(n)), lambda n: np.sin(np.arange(n) * 0.01), lambda n: rng.pareto(1.1, n), lambda n: rng.integers(0, 50, n).astype(float)]
    for shape in shapes:
        x = shape(int(rng.integers(20_000, 90_000)))
        sketches = []
        for part in np.array_split(x, int(rng.integers(1, 30))):
            sketches.append(TailSketch(k))
            sketches[-1].update(part)
        while len(sketches) > 1:  # a tree of merges
            for other in sketches[1:4]:
                sketches[0].merge(other)
            sketches = [*sketches[4:], sketches[0]]
        y = np.sort(x)
        for q, v in zip(QS, sketches[0].quantiles(QS), strict=True):
            assert rank_error(y, q, v) * (1 - q) <= sketches[0].rank_error(q) + 1 / len(x)


def test_coins_differ_between_parts():
    rng = np.random.default_rng(1)
    coins = [TailSketch()._coin(np.sort(rng.random(50)), 0, 0) for _ in range(400)]
    assert 140 < sum(coins) < 260


def test_many_keys_are_handed_on_and_merged_in_runs(spark):
    rows = [(i % 97, float(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    few, many = ({(r["g"], r["n"], r["q"][0], r["e"][0]) for r in tail_sketches(df, ["g"], "v", most_keys=m).select("g", "n", percentiles("sketch", [0.5]).alias("q"), rank_errors("sketch", [0.5]).alias("e")).collect()} for m in (3, 4096))
    assert few == many and len(few) == 97 and all(e == 0 for *_, e in few)
