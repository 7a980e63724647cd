"""Implausible readings: wavelet details for spikes, zero-detail runs for stuck values, bounds for impossible ones."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.timeparts import epoch_seconds

SPIKE, STUCK, IMPOSSIBLE = "spike", "stuck", "impossible"


@dataclass(frozen=True)
class SpikeRule:
    """How a measurement behaves.

    ``threshold`` is in robust standard deviations of a level's coefficients; ``least_ratio`` the least deviation, as a
    factor, that counts at all; ``low`` and ``high`` are physical bounds, ``low_open`` says that ``low`` itself is
    impossible; ``stuck_run`` successive readings of one value at different times are a stand. ``heavy_tail`` measurements
    have ordinary peaks: what they should be is then told by the ``companion`` column, to which the quantity is in
    proportion, or, where it is null, by the range of all that the companion shows.
    """

    threshold: float = 8.0
    least_ratio: float = 1.35
    low: float = 0.0
    low_open: bool = False
    high: float = float("inf")
    stuck_run: int = 6
    heavy_tail: bool = False
    levels: int = 6
    #: A factor from the expected value beyond which a reading doesn't shape the first approximation of its surroundings.
    outlying: float = 2.5
    #: Heavy tails only: what readings near 0 may differ by, in the measurement's unit.
    slack: float = 0.3


SCALING = np.array([1, 4, 6, 4, 1]) / 16.0
#: Readings on either side that the coarsest of six levels reaches.
REACH = 128


def wavelet_details(y: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """Detail coefficients of the undecimated spline wavelet transform, finest level first; ends are mirrored."""
    c = y
    for j in range(levels):
        step = 1 << j
        if 2 * step >= len(y):
            return
        padded = np.pad(c, 2 * step, mode="reflect")
        smooth = sum(w * padded[k * step : k * step + len(c)] for k, w in enumerate(SCALING))
        yield c - smooth
        c = smooth


def robust_scale(d: np.ndarray) -> float:
    """Standard deviation of the normal part: from the median of the absolute values that aren't 0."""
    a = np.abs(d)
    a = a[a > 0]
    return float(np.median(a)) * 1.4826 if len(a) else 0.0


def hour_median(hour: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Median of the values at the same hour of the day."""
    out = np.empty(len(x))
    order = np.argsort(hour, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(hour[order]) != 0])
    for part in np.split(order, starts[1:]):
        out[part] = np.median(x[part])
    return out


def coarse_parts(y: np.ndarray, levels: int) -> list[np.ndarray]:
    """What is left of a signal when the details of the finest level, of the two finest, and so on are taken away."""
    out, c = [], y
    for d in wavelet_details(y, levels):
        c = c - d
        out.append(c)
    return out


def wavelet_outliers(y: np.ndarray, every: np.ndarray, at: np.ndarray, rule: SpikeRule, least: float, start: float, rounds: int = 6) -> np.ndarray:
    """Which of the deviations ``every``, taken at the places ``at`` of the signal ``y``, are spikes.

    A reading's detail at a level is its distance from what the signal without outliers keeps beyond that level. It is
    significant beyond ``rule.threshold`` robust deviations of that level's details, and ``least``; a reading is a spike
    if the levels agree, but for two. What is found so is cut out, bridged, and the rest transformed anew until nothing
    changes; the first cut is at ``start``, since a stretch of outliers would else pass for the signal.
    """
    held = np.abs(y) > start
    for _ in range(rounds):
        kept = np.flatnonzero(~held)
        clean = np.interp(np.arange(len(y)), kept, y[kept]) if len(kept) else np.zeros(len(y))
        coarse = coarse_parts(clean, rule.levels)
        limits = [max(least, rule.threshold * robust_scale((y - c)[kept])) for c in coarse]
        agreed = max(1, len(coarse) - 2)
        found = sum((np.abs(y - c) > m).astype(int) for c, m in zip(coarse, limits, strict=True)) >= agreed
        if (found == held).all():
            break
        held = found
    return sum((np.abs(every - c[at]) > m).astype(int) for c, m in zip(coarse, limits, strict=True)) >= agreed


def stuck_runs(x: np.ndarray, least: int) -> np.ndarray:
    """Readings of stands: runs of zero detail at the finest level, checked to be of one value and ``least`` long.

    The finest coefficient weighs five readings, so a stand has four zero details fewer than readings.
    """
    if len(x) < max(least, 5):
        return np.zeros(len(x), dtype=bool)
    zero = np.abs(next(wavelet_details(x, 1))) <= 1e-12 * np.abs(x).max()
    part = np.cumsum(np.r_[True, zero[1:] != zero[:-1]]) - 1
    long = zero & (np.bincount(part)[part] >= max(1, least - 4))
    run = np.cumsum(np.r_[True, np.diff(x) != 0]) - 1
    return (np.bincount(run)[run] >= least) & (np.bincount(run, weights=long)[run] > 0)


def expected_by(other: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What a companion (NaN where there is none) lets expect; without it the nearest value that it shows anywhere."""
    known = ~np.isnan(other) & (other > 0)
    if known.any():
        other = other * np.median(x[known] / other[known])
        cap = np.max(other[known]) * 1.25
    else:
        cap = np.median(x) * 40
    return np.where(known, other, np.clip(x, np.percentile(x, 2) * 0.2, cap))


def flag_source(t: np.ndarray, x: np.ndarray, other: np.ndarray, rule: SpikeRule) -> np.ndarray:
    """The kind of implausibility of each reading of one source, '' for none. t (seconds) is sorted and may repeat."""
    kind = np.full(len(x), "", dtype=object)
    impossible = (x < rule.low) | (x > rule.high) | ((x == rule.low) & rule.low_open) | ~np.isfinite(x)
    first = np.r_[True, np.diff(t) != 0][: len(t)]
    good = ~impossible
    # one reading a time makes the signal; impossible values are held out, else they'd blur the details
    keep = first & good
    if keep.sum() >= 5:
        sig_t, sig = t[keep], x[keep]
        at = np.clip(np.searchsorted(sig_t, t, side="right") - 1, 0, len(sig) - 1)
        if rule.heavy_tail:
            usual = expected_by(other[keep], sig)
            # without a companion only what leaves its whole range deviates
            slack = np.where(np.isnan(other[keep]), 1e-9, rule.slack)
            depart = lambda v, i: np.log((v + slack[i]) / (usual[i] + slack[i]))
            least, start = np.log(rule.least_ratio), np.log(rule.least_ratio)
        else:
            usual = hour_median((sig_t // 3600) % 24, sig)
            level = np.median(np.abs(sig))
            if rule.low_open and rule.low >= 0:
                # a level that can only be positive is taken by ratios: a fall to a thousandth then shows as clearly as a rise
                depart = lambda v, i: np.log(v / usual[i])
                least, start = np.log(rule.least_ratio), np.log(rule.outlying)
            else:
                depart = lambda v, i: (v - usual[i]) / (level or 1.0)
                least, start = rule.least_ratio - 1, rule.outlying - 1
        every = np.zeros(len(x))
        every[good] = depart(x[good], at[good])
        kind[good & wavelet_outliers(depart(sig, np.arange(len(sig))), every, at, rule, least, start)] = SPIKE
        kind[good & stuck_runs(sig, rule.stuck_run)[at] & (x == sig[at])] = STUCK
    kind[impossible] = IMPOSSIBLE
    zero = first & (x == 0)
    if zero.sum() >= rule.stuck_run:  # an outage that reads 0 all along is a stand, possible or not
        one = np.flatnonzero(first)
        runs = one[stuck_runs(x[one], rule.stuck_run) & (x[one] == 0)]
        kind[np.isin(t, t[runs]) & (x == 0)] = STUCK
    return kind


def time_shards(readings: DataFrame, shard_s: int, halo_s: int, halo_rows: int) -> DataFrame:
    """Copies of the readings by (entity_id, shard), with the neighbours' readings near the border as ``halo``.

    A shard gets what lies within ``halo_s`` of its borders and, where reports are rarer, the ``halo_rows`` readings of the
    shard before and after that lie nearest.
    """
    own = readings.withColumn("own", F.floor(F.col("t") / F.lit(shard_s)))
    whole = Window.partitionBy("entity_id", "own")
    into = F.col("t") - F.col("own") * shard_s
    ranked = own.withColumns({"from_start": F.row_number().over(whole.orderBy("t")), "rows": F.count("*").over(whole)})
    back = (into < halo_s) | (F.col("from_start") <= halo_rows)
    ahead = (into >= shard_s - halo_s) | (F.col("rows") - F.col("from_start") < halo_rows)
    to = F.array_compact(F.array(F.col("own"), F.when(back, F.col("own") - 1), F.when(ahead, F.col("own") + 1)))
    return ranked.withColumn("shard", F.explode(to)).withColumn("halo", F.col("shard") != F.col("own")).drop("own", "from_start", "rows")


def shard_blocks(batches: Iterator[pd.DataFrame], most: int, reach: int = 2 * REACH) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """(rows, first, end) from batches sorted by shard: each shard's rows with the range that is still to be judged.

    A shard comes whole up to ``most`` rows; a longer one comes in blocks that overlap by ``reach`` rows on either side, so
    a task holds no more however often a source reports.
    """
    held: list[pd.DataFrame] = []
    size, done = 0, 0
    for pdf in batches:
        key = pdf["entity_id"].to_numpy(), pdf["shard"].to_numpy()
        cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1 if len(pdf) else []
        for part in np.split(np.arange(len(pdf)), cuts):
            if not len(part):
                continue
            rows = pdf.iloc[part[0] : part[-1] + 1]
            if held and (held[-1]["entity_id"].iloc[0] != rows["entity_id"].iloc[0] or held[-1]["shard"].iloc[0] != rows["shard"].iloc[0]):
                yield pd.concat(held, ignore_index=True), done, size
                held, size, done = [], 0, 0
            held.append(rows)
            size += len(rows)
            if size >= most + 2 * reach:
                block = pd.concat(held, ignore_index=True)
                yield block, done, size - reach
                held, size, done = [block.iloc[-2 * reach :]], 2 * reach, reach
    if held:
        yield pd.concat(held, ignore_index=True), done, size


def implausible_measures(
    df: DataFrame, id_col: str, entity: str, ts: str, rules: Mapping[str, SpikeRule], companions: Mapping[str, Column] | None = None,
    shard_days: int = 28, halo_days: int = 3, block_rows: int = 100_000,
) -> DataFrame:
    """(reading_id, entity_id, field, value, kind) of the readings that the source cannot truly have had.

    Each source is cut into time shards with a halo, once for all fields of ``rules``. What a reading departs from the
    usual value at its hour (or from its companion, for heavy tails) makes a signal that goes through an undecimated
    wavelet transform; ``spike``s are readings whose details exceed a robust threshold at the levels that have to agree.
    ``stuck`` are runs of zero detail, ``impossible`` readings outside the physical bounds.

    Null and NaN values, null entities and null times take no part and are no cases. Repeated deliveries are judged each
    by its own value, against surroundings in which a time counts once. A shard with fewer than five different times
    is only held against the bounds. Shards of more than ``block_rows`` readings are judged in overlapping blocks. An
    empty table gives no rows; extra columns are ignored.
    """
    fields = list(rules)
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    other = lambda f: (companions or {}).get(f, F.lit(None)).cast("double")
    paired = [f for f in fields if f in (companions or {})]
    readings = df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull() & F.coalesce(*[value(f) for f in fields]).isNotNull()).select(
        F.col(entity).alias("entity_id"), F.col(id_col).alias("reading_id"), epoch_seconds(ts).alias("t"),
        *[value(f).alias(f"x{i}") for i, f in enumerate(fields)], *[other(f).alias(f"o{fields.index(f)}") for f in paired],
    )

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, begin, end in shard_blocks(batches, block_rows):
            here = np.arange(len(block))
            judged = (here >= begin) & (here < end) & ~block["halo"].to_numpy(dtype=bool)
            for i, f in enumerate(fields):
                x = block[f"x{i}"].to_numpy(dtype=float)
                has = np.flatnonzero(~np.isnan(x))
                if not judged[has].any():
                    continue
                o = block[f"o{i}"].to_numpy(dtype=float)[has] if f in paired else np.full(len(has), np.nan)
                kind = flag_source(block["t"].to_numpy()[has], x[has], o, rules[f])
                hit = has[(kind != "") & judged[has]]
                if len(hit):
                    yield block.loc[hit, ["reading_id", "entity_id"]].assign(field=f, value=x[hit], kind=kind[np.isin(has, hit)])

    types = dict(readings.dtypes)
    longest = max(r.stuck_run for r in rules.values())
    return (
        time_shards(readings, shard_days * 86400, halo_days * 86400, longest)
        .repartition("entity_id", "shard")
        .sortWithinPartitions("entity_id", "shard", "t", "reading_id")
        .mapInPandas(flag, f"reading_id {types['reading_id']}, entity_id {types['entity_id']}, field string, value double, kind string")
    )


def implausible_readings(df: DataFrame, id_col: str, entity: str, ts: str, value: str, rule: SpikeRule, companion: Column | None = None, **shards: int) -> DataFrame:
    """(reading_id, entity_id, value, kind) of one field; see ``implausible_measures``."""
    return implausible_measures(df, id_col, entity, ts, {value: rule}, {} if companion is None else {value: companion}, **shards).drop("field")
