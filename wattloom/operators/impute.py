"""Missing values filled from similar records: mined functional dependencies first, then groups, with provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.joins import lookup_join
from wattloom.session import checkpointed

OBSERVED = "observed"

#: What each meter can report; other numbers are fillers. Fixed values of the meters, in the fields' units.
METERS: dict[str, tuple[float, float] | None] = {
    "global_active_power": None,
    "sub_metering_1": (0.0, 1000.0),
    "global_intensity": (0.0, 500.0),
}


@dataclass(frozen=True)
class Attribute:
    """A determinant in the search: a field in steps; null where it can't tell anything. A field may have several, finest first."""

    name: str
    field: str
    value: Column


@dataclass(frozen=True)
class Dependency:
    """Attributes that determine a target, with the share of complete records that contradict it."""

    target: str
    attributes: tuple[str, ...]
    error: float

    @property
    def name(self) -> str:
        return "+".join(self.attributes)


def missing(column: str, meters: Mapping[str, tuple[float, float] | None] = METERS) -> Column:
    """Null, NaN or, where the meter's range is known, a number outside it."""
    c = F.col(column)
    out = c.isNull() | F.isnan(c)
    if meters.get(column):
        low, high = meters[column]
        out = out | (c < low) | (c > high)
    return out


def cleaned(column: str, meters: Mapping[str, tuple[float, float] | None] = METERS) -> Column:
    return F.when(~missing(column, meters), F.col(column))


def step_of(column: str, ratio: float, least: float) -> Column:
    """Number of the step that a value lies in: steps of ``ratio`` above ``least``, of ``least`` * (ratio - 1) below."""
    c = F.col(column)
    return F.when(F.abs(c) < least, F.floor(c / (least * (ratio - 1.0)))).otherwise(
        F.signum(c) * (F.floor(F.log(F.greatest(F.abs(c), F.lit(least)) / least) / F.log(F.lit(ratio))) + F.lit(10_000))
    ).cast("int")


#: Fields, steps by ratio, and the value below which steps are even: what counts as the same reading.
STEPS: dict[str, tuple[float, float]] = {"global_active_power": (1.05, 0.2), "sub_metering_1": (1.05, 20.0), "global_intensity": (1.05, 1.0)}


def household_attributes() -> list[Attribute]:
    """Fields of a meter's record in steps, fine and coarse. Which of them determine what is left to the search."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return [
        Attribute("intensity", "global_intensity", F.round(some("global_intensity"), 1)),
        Attribute("intensity_band", "global_intensity", F.floor(F.log(F.round(some("global_intensity"), 1)) * 10)),
        Attribute("power", "global_active_power", F.floor(F.log(some("global_active_power")) * 25)),
        Attribute("power_band", "global_active_power", F.floor(F.floor(F.log(some("global_active_power")) * 25) / 2.5)),
        Attribute("circuit_1", "sub_metering_1", F.floor(F.col("sub_metering_1") / 5)),
        Attribute("circuit_2", "sub_metering_2", F.floor(F.col("sub_metering_2") / 5)),
        Attribute("circuit_3", "sub_metering_3", F.floor(F.col("sub_metering_3") / 5)),
    ]


def _name(attributes: Sequence[Attribute]) -> str:
    return "+".join(a.name for a in attributes)


def determinant(attributes: Sequence[Attribute], values: bool = False) -> Column:
    """The key of an attribute set, a hash of 64 bits, from columns named so or (``values``) from a record's fields.

    Null where an attribute is; the set of no attributes has one key.
    """
    parts = [a.value if values else F.col(a.name) for a in attributes]
    there = reduce(lambda x, y: x & y, [p.isNotNull() for p in parts], F.lit(True))
    return F.when(there, F.xxhash64(F.lit(_name(attributes)), *[p.cast("double") for p in parts]))


def stripped_partitions(cells: DataFrame, target: str, sets: Sequence[Sequence[Attribute]], support: int, purity: float) -> DataFrame:
    """(i, entity, key, n, agreeing, value, good) of each group of the i-th attribute set that has ``support`` records or more.

    ``agreeing`` is the largest number of a group's records whose target lies in two neighbouring steps, and ``value`` their
    mean; a group is good if they are the share ``purity`` of it. Groups of fewer records tell nothing and are left out.
    """
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("i"), determinant(s).alias("key")) for i, s in enumerate(sets)])
    t = F.col(f"t_{target}").cast("int")
    # each step counts for itself with the next above and the next below
    long = cells.select("entity", "n", F.col(f"s_{target}").alias("s"), F.explode(F.array(t, t - 1)).alias("pair"), keys.alias("keys"))
    long = long.select("entity", "n", "s", "pair", F.explode("keys").alias("a")).where("a.key is not null")
    pairs = long.groupBy("a.i", "entity", "a.key", "pair").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    groups = pairs.groupBy("i", "entity", "key").agg((F.sum("n") / 2).cast("long").alias("n"), F.max("n").alias("agreeing"), F.max_by("s", "n").alias("s"))
    return groups.where(F.col("n") >= support).select("i", "entity", "key", "n", "agreeing", (F.col("s") / F.col("agreeing")).alias("value"), (F.col("agreeing") >= purity * F.col("n")).alias("good"))


def mined_dependencies(
    complete: DataFrame, entity: str, targets: Sequence[str], attributes: Sequence[Attribute], support: int = 3, purity: float = 0.9,
    confidence: float = 0.5, settled: float = 0.05, gain: float = 0.35, largest: int = 3,
) -> dict[Dependency, DataFrame]:
    """The dependencies found in complete records, each with its dictionary (entity, key, value).

    A level-wise search over sets of attributes of different fields, within each entity. The error of a set is the share of
    the records in its good groups (``stripped_partitions``) that contradict their group; these have to hold the share
    ``confidence`` of all records. A set is kept if it has the share ``gain`` less error than
    the smaller ones kept before it, that of no attributes included; the search for a target ends once a set has an error of
    ``settled`` or less. Single attributes are the finest of their field, those of larger sets the coarsest, and of two fields
    that determine each other only one takes part. A dictionary has the good groups of those entities of whose
    records the share ``confidence`` lies in good groups.

    All sets of a level are counted in one pass over cells of equal records; the driver sees one row a set.
    """
    bins = [*[F.col(entity).alias("entity")], *[a.value.alias(a.name) for a in attributes], *[step_of(t, *STEPS.get(t, (1.05, 1.0))).alias(f"t_{t}") for t in targets]]
    values = [F.col(t).alias(f"v_{t}") for t in targets]
    keys = ["entity", *[a.name for a in attributes], *[f"t_{t}" for t in targets]]
    cells = checkpointed(complete.select(*bins, *values).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"v_{t}").alias(f"s_{t}") for t in targets]))
    found: dict[Dependency, DataFrame] = {}
    best = dict.fromkeys(targets, 1.0)
    settling: set[tuple[str, str]] = set()
    fields = list(dict.fromkeys(a.field for a in attributes))
    finest, coarsest = {a.field: a for a in reversed(attributes)}, {a.field: a for a in attributes}
    for size in range(1, largest + 1):
        for t in targets:
            if best[t] <= settled and any(d.target == t for d in found):
                continue
            # of two fields that determine each other the later tells nothing new
            twins = {b for a, b in combinations(fields, 2) if {(a, b), (b, a)} <= settling} if size > 1 else set()
            widths = finest if size == 1 else coarsest
            sets = list(combinations([widths[f] for f in fields if f != t and f not in twins], size))
            if not sets:
                continue
            groups = checkpointed(stripped_partitions(cells, t, [*sets, ()] if size == 1 else sets, support, purity))
            good = lambda c: F.sum(F.when(F.col("good"), F.col(c)))
            measured = groups.groupBy("i").agg(F.when(good("n") >= confidence * F.sum("n"), 1 - good("agreeing") / good("n")).alias("error")).where("error is not null")
            errors = {r["i"]: r["error"] for r in measured.collect()}
            best[t] = min(best[t], errors.pop(len(sets), 1.0))
            bar = (1 - gain) * best[t]
            whole = Window.partitionBy("entity")
            holds = F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).over(whole) >= confidence * F.sum("n").over(whole)
            for i, error in sorted(errors.items(), key=lambda x: x[1]):
                if error > bar:
                    break
                best[t] = min(best[t], error)
                if size == 1 and error <= settled:
                    settling.add((sets[i][0].field, t))
                book = groups.where(F.col("i") == i).withColumn("holds", holds).where("holds and good")
                found[Dependency(t, tuple(a.name for a in sets[i]), error)] = checkpointed(book.select("entity", "key", "value"))
    return found


def repeated_deliveries(clean: DataFrame, entity: str, ts: str, targets: Sequence[str], tolerance: float = 0.02, confidence: float = 0.7) -> DataFrame:
    """(entity, time, d_<target>): what another delivery of a reading that lacks a target has for it.

    Verified by entity: of the times at which several values came, the share ``confidence`` has them within ``tolerance``.
    """
    value = lambda t: F.when((F.col(f"b_{t}") - F.col(f"a_{t}")) <= F.abs(F.col(f"m_{t}")) * tolerance, F.col(f"m_{t}"))
    stats = [x for t in targets for x in (F.min(t).alias(f"a_{t}"), F.avg(t).alias(f"m_{t}"), F.max(t).alias(f"b_{t}"), F.count(t).alias(f"n_{t}"))]
    same = clean.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).groupBy(entity, ts).agg(F.count("*").alias("rows"), *stats).where("rows > 1")
    whole = Window.partitionBy(entity)
    share = lambda t: F.avg(F.when(F.col(f"n_{t}") > 1, value(t).isNotNull().cast("int"))).over(whole)
    lacking = reduce(lambda a, b: a | b, [F.col(f"n_{t}") < F.col("rows") for t in targets])
    return same.select(entity, ts, lacking.alias("lacking"), *[F.when(F.coalesce(share(t), F.lit(1.0)) >= confidence, value(t)).alias(f"d_{t}") for t in targets]).where("lacking").drop("lacking")


def step_medians(steps: DataFrame, keys: Sequence[str], targets: Sequence[str], prefix: str) -> DataFrame:
    """(keys, <prefix>_<target>): the median of the readings, to within a step, from counts by ``target``, step and finer keys."""
    counts = steps.groupBy("target", *keys, "step").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = Window.partitionBy("target", *keys)
    upto = F.sum("n").over(whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    half = counts.withColumns({"upto": upto, "all": F.sum("n").over(whole)}).where((F.col("upto") >= F.col("all") / 2) & (F.col("upto") - F.col("n") < F.col("all") / 2))
    return half.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == t, F.col("s") / F.col("n"))).alias(f"{prefix}_{t}") for t in targets])


def filled_readings(
    df: DataFrame, id_col: str, entity: str, ts: str, targets: Mapping[str, tuple[float, float] | None] = METERS,
    attributes: Sequence[Attribute] | None = None, slot_minutes: int = 30,
) -> DataFrame:
    """(id, entity, time, and for each target its value and ``<target>_source``).

    ``observed`` values stay. A missing one (null, NaN or a filler outside the meter's range) comes from the first that
    has one: another delivery of the reading (``fd:delivery``), the mined dependencies (``fd:<attributes>``), those with
    the least error first, the median of the entity's readings of that time of day (``group:slot``), of the entity
    (``group:entity``), of all entities at that time (``group:time``), else it stays null with source ``none``. Medians are
    those of the readings, to within a step of 5 %.

    Dependencies are mined in complete records. Only records that lack a value are joined with dictionaries; the others
    pass without a shuffle. Null entities and times match no dictionary: such a record can get only ``group:time`` or
    ``none``. Repeated rows each give a row. An empty table gives none. Extra columns are ignored.
    """
    attributes = household_attributes() if attributes is None else attributes
    names = list(targets)
    helpers = sorted({a.field for a in attributes} - set(names))
    clean = df.select(
        F.col(id_col), F.col(entity), F.col(ts), *[cleaned(t, targets).cast("double").alias(t) for t in names],
        *[(F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c)) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in helpers],
    )
    attributes = [a for a in attributes if a.field in df.columns]
    placed = F.col(entity).isNotNull() & F.col(ts).isNotNull()
    lacks = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in names])
    complete = clean.where(placed).na.drop(subset=list({*names, *[a.field for a in attributes]}))
    found = mined_dependencies(complete, entity, names, attributes)
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / slot_minutes)
    todo = clean.where(lacks).withColumn("_slot", slot)
    todo = todo.join(repeated_deliveries(clean, entity, ts, names), [entity, ts], "left")
    by_name = {a.name: a for a in attributes}
    sources: dict[str, list[tuple[str, Column]]] = {t: [(OBSERVED, F.col(t)), ("fd:delivery", F.col(f"d_{t}"))] for t in names}
    for i, (d, book) in enumerate(sorted(found.items(), key=lambda x: (x[0].error, -len(x[0].attributes)))):
        side = book.select(F.col("entity").alias(entity), F.col("key").alias("_key"), F.col("value").alias(f"_fd{i}"))
        key = determinant([by_name[a] for a in d.attributes], values=True)
        todo = lookup_join(todo.withColumn("_key", F.when(F.col(d.target).isNull(), key)), side, [entity, "_key"], id_col, 24).drop("_key")
        sources[d.target].append((f"fd:{d.name}", F.col(f"_fd{i}")))
    values = F.array(*[F.struct(F.lit(t).alias("target"), step_of(t, *STEPS.get(t, (1.05, 1.0))).alias("step"), F.col(t).alias("v")) for t in names])
    long = clean.where(placed).select(F.col(entity), slot.alias("_slot"), F.explode(values).alias("x")).where("x.v is not null")
    steps = checkpointed(long.groupBy("x.target", entity, "_slot", "x.step").agg(F.count("*").alias("n"), F.sum("x.v").alias("s")))
    for prefix, keys in (("slot", [entity, "_slot"]), ("entity", [entity]), ("time", ["_slot"])):
        todo = lookup_join(todo, checkpointed(step_medians(steps, keys, names, f"_{prefix}")), keys, id_col, 48)
        for t in names:
            sources[t].append((f"group:{prefix}", F.col(f"_{prefix}_{t}")))

    def filled(t: str) -> list[Column]:
        mark = reduce(lambda done, s: F.when(s[1].isNotNull(), F.lit(s[0])).otherwise(done), reversed(sources[t]), F.lit("none"))
        return [F.coalesce(*[v for _, v in sources[t]]).alias(t), mark.alias(f"{t}_source")]

    whole = [x for t in names for x in (F.col(t), F.lit(OBSERVED).alias(f"{t}_source"))]
    return clean.where(~lacks).select(id_col, entity, ts, *whole).unionByName(todo.select(id_col, entity, ts, *[x for t in names for x in filled(t)]))
