"""Irregular readings onto a regular grid, by shape-preserving cubic interpolation over time shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.timeparts import epoch_seconds, from_epoch_seconds, usable
from wattloom.session import checkpointed

OBSERVED, INTERPOLATED, GAP = "observed", "interpolated", "gap"


def period_means(df: DataFrame, entity: str, ts: str, value: str, step_s: int, shard_steps: int) -> DataFrame:
    """(entity_id, shard, p, v, n): mean and number of usable readings of each period that has any."""
    return (
        df.where(usable(value, entity, ts))
        .select(F.col(entity).alias("entity_id"), F.floor(epoch_seconds(ts) / F.lit(step_s)).alias("p"), F.col(value).cast("double").alias("v"))
        .withColumn("shard", F.floor(F.col("p") / F.lit(shard_steps)))
        .groupBy("entity_id", "shard", "p")
        .agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    )


def with_halo(obs: DataFrame) -> DataFrame:
    """Add to each shard the last reading before it and the first two after it, from the nearest shards that have any.

    What is exchanged is a summary of three readings a shard, so its windows by entity are small.
    """
    knots = F.sort_array(F.collect_list(F.struct("p", "v", "n")))
    ends = (
        obs.groupBy("entity_id", "shard")
        .agg(knots.alias("k"))
        .select("entity_id", "shard", F.slice("k", 1, 2).alias("head"), F.element_at("k", -1).alias("tail"))
    )
    by_shard = Window.partitionBy("entity_id").orderBy("shard")
    none = F.slice(F.col("head"), 1, 0)
    before = F.array_compact(F.array(F.lag("tail").over(by_shard)))
    after = F.concat(F.coalesce(F.lead("head", 1).over(by_shard), none), F.coalesce(F.lead("head", 2).over(by_shard), none))
    ends = ends.withColumn("near", F.concat(before, F.slice(after, 1, 2)))
    halo = ends.select("entity_id", "shard", F.explode("near").alias("k"))
    return obs.select("entity_id", "shard", "p", "v", "n", F.lit(False).alias("halo")).unionByName(
        halo.select("entity_id", "shard", "k.p", "k.v", "k.n", F.lit(True).alias("halo"))
    )


def inner_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Derivative at an inner knot: weighted harmonic mean of the neighbouring secants, 0 at an extremum."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Derivative at an end knot from the nearest secant (h0, d0) and the next; plain secant where there is no next."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(d1.isNull(), d0)
        .when(F.signum(m) != F.signum(d0), 0.0)
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0)
        .otherwise(m)
    )


def regular_grid(df: DataFrame, entity: str, ts: str, value: str, step_s: int, max_gap_steps: int, shard_steps: int = 1024) -> DataFrame:
    """A complete series per entity: (entity_id, period_start, value, status, n_readings).

    Periods [start, start + step) are aligned to midnight and run from the entity's first usable reading to its last.
    ``observed`` periods have the mean of their usable readings. Up to ``max_gap_steps`` missing periods in a row are
    ``interpolated`` by monotone cubic Hermite pieces, which never leave the range of the two readings beside the gap;
    longer gaps stay null with status ``gap`` and split the series into segments that don't shape each other.

    Work is sharded by (entity, ``shard_steps`` periods), so one busy or long series is spread over many tasks; each shard
    gets halo readings from its neighbours. Rows with null entity or time, or null or NaN value, take no part; several
    readings of a period, equal or not, are averaged; an entity with one period has that row alone; an empty table gives
    none. Extra columns are ignored.
    """
    if step_s <= 0 or 86400 % step_s:
        raise ValueError("step_s must divide a day")
    rows = with_halo(checkpointed(period_means(df, entity, ts, value, step_s, shard_steps)))
    by_p = Window.partitionBy("entity_id", "shard").orderBy("p")
    rows = rows.withColumns({
        "p0": F.lag("p").over(by_p), "v0": F.lag("v").over(by_p),
        "p2": F.lead("p").over(by_p), "v2": F.lead("v").over(by_p),
        "p3": F.lead("p", 2).over(by_p), "v3": F.lead("v", 2).over(by_p),
    }).where(~F.col("halo"))
    joined = lambda a, b: (F.col(b) - F.col(a)) <= max_gap_steps + 1
    h = {0: F.when(joined("p0", "p"), F.col("p") - F.col("p0")), 1: F.col("p2") - F.col("p"), 2: F.when(joined("p2", "p3"), F.col("p3") - F.col("p2"))}
    d = {0: (F.col("v") - F.col("v0")) / h[0], 1: (F.col("v2") - F.col("v")) / h[1], 2: (F.col("v3") - F.col("v2")) / h[2]}
    bridged = (h[1] > 1) & joined("p", "p2")
    m1 = F.when(h[0].isNull(), end_slope(h[1], d[1], h[2], d[2])).otherwise(inner_slope(h[0], d[0], h[1], d[1]))
    m2 = F.when(h[2].isNull(), end_slope(h[1], d[1], h[0], d[0])).otherwise(inner_slope(h[1], d[1], h[2], d[2]))
    rows = rows.select(
        "entity_id", "p", "v", "v2", "n", h[1].cast("double").alias("h"), F.when(bridged, m1).alias("m1"), F.when(bridged, m2).alias("m2"),
        F.explode(F.sequence("p", F.coalesce(F.col("p2") - 1, F.col("p")))).alias("i"),
    )
    s = (F.col("i") - F.col("p")) / F.col("h")
    cubic = (
        (2 * s * s * s - 3 * s * s + 1) * F.col("v") + (s * s * s - 2 * s * s + s) * F.col("h") * F.col("m1")
        + (3 * s * s - 2 * s * s * s) * F.col("v2") + (s * s * s - s * s) * F.col("h") * F.col("m2")
    )
    at_knot = F.col("i") == F.col("p")
    within = F.greatest(F.least("v", "v2"), F.least(F.greatest("v", "v2"), cubic))
    return rows.select(
        "entity_id",
        from_epoch_seconds(F.col("i") * step_s).alias("period_start"),
        F.when(at_knot, F.col("v")).when(F.col("m1").isNotNull(), within).alias("value"),
        F.when(at_knot, OBSERVED).when(F.col("m1").isNotNull(), INTERPOLATED).otherwise(GAP).alias("status"),
        F.when(at_knot, F.col("n")).otherwise(0).alias("n_readings"),
    )
