"""Mergeable percentiles with relative-rank compactors.

A sketch is a list of levels; an item of level h stands for 2**h values. A full level is sorted and part of its lower
items is compacted: every other one moves up a level with twice the weight. The upper items of a level are protected, and
more of them the rarer its compactions are due, so the rank error of a high percentile is in proportion to its distance
from the top: at 0.99 it is a hundredth of the error at 0.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = 1
#: Of the relative rank error, times k.
ERROR = 0.3


class TailSketch:
    """Relative-error sketch that protects the high tail. ``k`` (even) is the size of a section."""

    __slots__ = ("k", "n", "levels", "states", "sections", "low", "high")

    def __init__(self, k: int = 64):
        if k < 4 or k % 2:
            raise ValueError("k must be even and at least 4")
        self.k, self.n = k, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]
        self.sections: list[int] = [3]
        self.low, self.high = np.inf, -np.inf

    def capacity(self, h: int) -> int:
        return 2 * self.k * self.sections[h]

    def update(self, values: np.ndarray) -> None:
        values = values[~np.isnan(values)]
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        # in blocks, so that a level never grows far beyond its capacity
        step = max(self.capacity(0), 4096)
        for i in range(0, len(values), step):
            self.levels[0] = np.concatenate([self.levels[0], values[i : i + step]])
            self._compress()

    def merge(self, other: TailSketch) -> None:
        if other.k != self.k:
            raise ValueError("sketches of different k")
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self._grow()
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= other.states[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
        self._compress()

    def _grow(self) -> None:
        self.levels.append(np.empty(0))
        self.states.append(0)
        self.sections.append(3)

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= self.capacity(h):
                if h + 1 == len(self.levels):
                    self._grow()
                items, state = np.sort(self.levels[h]), self.states[h]
                # sections due: one more for each trailing 1 of the number of compactions so far
                due = 1 + (~state & (state + 1)).bit_length() - 1
                protect = max(self.capacity(h) // 2, self.capacity(h) - due * self.k)
                end = len(items) - protect
                end -= end % 2
                # which of each pair survives is a coin for every other compaction, and the other side for the next
                odd = (self._coin(items, h, state >> 1) + state) & 1
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[odd:end:2]])
                self.levels[h] = items[end:]
                self.states[h] = state + 1
                if self.states[h] >= 1 << (self.sections[h] - 1):  # the schedule is used up: protect more from here on
                    self.sections[h] *= 2
            h += 1

    def _coin(self, items: np.ndarray, h: int, turn: int) -> int:
        """A random bit, the same on every run: seeded by what is compacted, so sketches of different rows differ."""
        return zlib.crc32(np.array([items[0], items[-1], self.n, h, turn], dtype=np.float64).tobytes()) >> 7 & 1

    def rank_error(self, q: float) -> float:
        """What the rank of the q-quantile given here may be off by, as a share of n: 0 as long as nothing was compacted.

        Three standard deviations as measured (see the README) over all shapes and merges tested, in proportion to the
        distance from the top.
        """
        return 0.0 if len(self.levels) == 1 else min(1.0, ERROR / self.k * (1 - q) + 1 / self.n)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        return items[order], weights[order]

    def quantiles(self, qs: Sequence[float]) -> list[float]:
        """The least value whose rank reaches q n (nearest rank); exact below the capacity of a level."""
        if not self.n:
            return [float("nan")] * len(qs)
        items, weights = self._sorted()
        reach = np.cumsum(weights)
        total = int(reach[-1])
        at = [min(int(np.searchsorted(reach, max(1.0, np.ceil(q * total - 1e-9)))), len(items) - 1) for q in qs]
        return [self.low if q <= 0 else self.high if q >= 1 else float(items[i]) for q, i in zip(qs, at, strict=True)]

    def to_bytes(self) -> bytes:
        head = np.array([FORMAT, self.k, self.n, len(self.levels), *self.states, *self.sections, *map(len, self.levels)], dtype=np.int64)
        out = io.BytesIO()
        out.write(np.int64(len(head)).tobytes())
        out.write(head.tobytes())
        out.write(np.array([self.low, self.high]).tobytes())
        for x in self.levels:
            out.write(x.tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> TailSketch:
        size = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, size, 8).tolist()
        if head[0] != FORMAT:
            raise ValueError("unknown sketch format")
        _, k, n, count = head[:4]
        out = cls(k)
        out.n = n
        out.states, out.sections, lengths = head[4 : 4 + count], head[4 + count : 4 + 2 * count], head[4 + 2 * count :]
        ends = np.frombuffer(raw, np.float64, offset=8 + 8 * size)
        out.low, out.high = float(ends[0]), float(ends[1])
        out.levels = [x.copy() for x in np.split(ends[2:], np.cumsum(lengths)[:-1])]
        return out


def _schema(types: dict[str, str], keys: Sequence[str]) -> str:
    return ", ".join([*[f"`{c}` {types[c]}" for c in keys], "part int", "n bigint", "sketch binary"])


def _merged_runs(sketches: DataFrame, keys: Sequence[str], schema: str, by_part: bool) -> DataFrame:
    """One sketch for each key (and part). Sketches come in order and are merged one by one, so a task holds one at a time."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, head, sketch = None, None, None
        for pdf in batches:
            done = []
            for i, (of, part, raw) in enumerate(zip(pdf["_group"], pdf["part"], pdf["sketch"], strict=True)):
                if (of, part) == group:
                    sketch.merge(TailSketch.from_bytes(raw))
                    continue
                if sketch is not None:
                    done.append(head.assign(n=sketch.n, sketch=[sketch.to_bytes()]))
                group, head, sketch = (of, part), pdf.iloc[i : i + 1].drop(columns="_group"), TailSketch.from_bytes(raw)
            if done:
                yield pd.concat(done)
        if sketch is not None:
            yield head.assign(n=sketch.n, sketch=[sketch.to_bytes()])

    grouped = sketches.withColumn("_group", F.xxhash64(*keys) if keys else F.lit(0))
    if not by_part:
        grouped = grouped.withColumn("part", F.lit(0))
    return grouped.repartition("_group", "part").sortWithinPartitions("_group", "part").select(*keys, "part", "n", "sketch", "_group").mapInPandas(merge, schema)


def tail_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 64, merge_ways: int = 16, most_keys: int = 4096) -> DataFrame:
    """(keys, n, sketch): one mergeable sketch of ``value`` for each combination of ``keys``.

    Each task sketches its own rows, by group, before anything is shuffled, so a group of any size is spread over all
    tasks; it hands on what it has whenever ``most_keys`` groups are at hand. The few KB that come of a group and task are
    merged in ``merge_ways`` parts first and then once more, one after the other. Null and NaN values take no part; groups
    without any other value give no row; null keys are a group of their own; an empty table gives no rows. Of ``df`` only
    the keys and the value are read.
    """
    keys = list(keys)
    schema = _schema(dict(df.dtypes), keys)

    def rows(found: dict[tuple, TailSketch], part: int) -> pd.DataFrame:
        out = pd.DataFrame(list(found), columns=keys, dtype=object) if keys else pd.DataFrame(index=range(len(found)))
        return out.assign(part=part, n=[s.n for s in found.values()], sketch=[s.to_bytes() for s in found.values()])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, TailSketch] = {}
        part = 0
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            values = pdf[value].to_numpy(dtype=float)
            if not keys:
                found.setdefault((), TailSketch(k)).update(values)
                continue
            codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            heads = pdf[keys].iloc[order[starts]].astype(object).where(lambda x: x.notna(), None)
            for key, rows_of in zip(heads.itertuples(index=False, name=None), np.split(order, starts[1:]), strict=True):
                found.setdefault(key, TailSketch(k)).update(values[rows_of])
            if len(found) >= most_keys:
                yield rows(found, part)
                found = {}
        if found:
            yield rows(found, part)

    v = F.col(value).cast("double")
    source = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias(value), F.pmod(F.spark_partition_id(), F.lit(merge_ways)).alias("part"))
    return merge_sketches(source.mapInPandas(local, schema), keys)


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones: days into months, partitions into tables.

    A ``part`` column, if there is one, spreads the sketches of a group; else a hash of the sketch does.
    """
    keys = list(keys)
    schema = _schema(dict(sketches.dtypes), keys)
    part = F.col("part") if "part" in sketches.columns else F.pmod(F.xxhash64("sketch"), F.lit(16)).cast("int")
    parts = _merged_runs(sketches.select(*keys, part.alias("part"), "n", "sketch"), keys, schema, True)
    return _merged_runs(parts, keys, schema, False).select(*keys, "n", "sketch")


def percentiles(sketch: Column | str, qs: Sequence[float]) -> Column:
    """ARRAY<DOUBLE> of the percentiles of a sketch column."""
    qs = list(qs)

    @F.pandas_udf("array<double>")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else TailSketch.from_bytes(b).quantiles(qs))

    return read(sketch)


def rank_errors(sketch: Column | str, qs: Sequence[float]) -> Column:
    """ARRAY<DOUBLE> of what the rank of each percentile may be off by, as a share of n."""
    qs = list(qs)

    @F.pandas_udf("array<double>")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else [TailSketch.from_bytes(b).rank_error(q) for q in qs])

    return read(sketch)
