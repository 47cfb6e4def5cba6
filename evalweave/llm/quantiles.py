"""Problem 3: percentiles per group with bounded relative rank error, mergeable over days and partitions.

Method: relative-rank compactors.  Level h of a sketch holds items of weight
2^h in a buffer of 2 * sections * section_size places.  A full level sorts its
buffer and compacts only the part away from the protected tail: the schedule of
the level's state (trailing ones of its compaction count) tells how many
sections join; of the compacted part, every other item goes one level up.  The
protected side is the high tail, so that ranks near the maximum are exact or
almost so and the error at percentile p is about ERROR/k * (1 - p) of all rows.
Sketches of days or partitions merge level by level.

The coin that picks odd or even items is a bit of a hash of the compacted items,
fair and independent of their order, so that equal input gives equal results.
A buffer may be filled over its capacity by a batch or a merge; all that is over
is then compacted at once, which takes fewer compactions, hence less error, than
item by item, and leaves the protected part as it is.

The published analysis of this sketch with three first sections gives a standard
error of sqrt(0.0512 / 3) / k = 0.13 / k of the rows above the answer; the stated
bound, ``ERROR`` / k, is more than eleven of these.  Tests hold it against
adversarial orders and lopsided merges.

Defined results for odd input: null, not-a-number and negative values are left
out and counted; infinite values count as the largest; groups with no valid
value come out with count 0 and null percentiles; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 32
#: Stated bound: the rank of an answer is off by at most ERROR / k times the number of rows above it (plus one row).
ERROR = 1.5


class RelativeSketch:
    """Quantile sketch of relative rank error, accurate towards the largest values."""

    def __init__(self, k: int = K):
        self.k = max(4, k - k % 2)
        self.n = 0
        self.low = float("inf")
        self.high = float("-inf")
        self.levels: list[list[np.ndarray]] = [[]]
        self.sizes = [0]
        self.state = [0]
        self.sections = [3]
        self.width = [float(self.k)]

    def capacity(self, h: int) -> int:
        return 2 * self.sections[h] * self._even(self.width[h])

    @staticmethod
    def _even(x: float) -> int:
        return max(4, 2 * round(x / 2))

    def _grow(self) -> None:
        self.levels.append([])
        self.sizes.append(0)
        self.state.append(0)
        self.sections.append(3)
        self.width.append(float(self.k))

    def add(self, values: np.ndarray) -> None:
        """Add a batch of numbers without nan."""
        values = np.asarray(values, np.float64)
        if not len(values):
            return
        self.n += len(values)
        self.low = min(self.low, float(values.min()))
        self.high = max(self.high, float(values.max()))
        step = max(self.capacity(0), 4096)
        for lo in range(0, len(values), step):
            self._put(0, values[lo : lo + step])
            self._compress()

    def _put(self, h: int, values: np.ndarray) -> None:
        self.levels[h].append(values)
        self.sizes[h] += len(values)

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while self.sizes[h] >= self.capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        buf = np.sort(np.concatenate(self.levels[h]))
        ones = 0
        s = self.state[h]
        while s & 1:
            ones, s = ones + 1, s >> 1
        wide = self._even(self.width[h])
        keep = len(buf) // 2 if len(buf) <= self.capacity(h) + wide else self.capacity(h) // 2
        keep += max(0, self.sections[h] - 1 - ones) * wide if len(buf) <= 2 * self.capacity(h) else 0
        cut = max(2, len(buf) - keep)
        cut -= cut % 2
        part = buf[:cut]  # the low end; the high tail is protected
        if h + 1 == len(self.levels):
            self._grow()
        self._put(h + 1, part[xxhash.xxh64_intdigest(part.tobytes(), h) & 1 :: 2])
        self.levels[h] = [buf[cut:]]
        self.sizes[h] = len(buf) - cut
        self.state[h] += 1
        if self.state[h] >= 1 << (self.sections[h] - 1) and self._even(self.width[h] / 2**0.5) > 4:
            self.width[h] /= 2**0.5
            self.sections[h] *= 2

    def merge(self, other: RelativeSketch) -> None:
        while len(self.levels) < len(other.levels):
            self._grow()
        for h in range(len(other.levels)):
            if other.sizes[h]:
                self._put(h, np.concatenate(other.levels[h]))
            self.state[h] |= other.state[h]
            if other.sections[h] > self.sections[h]:
                self.sections[h], self.width[h] = other.sections[h], other.width[h]
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._compress()

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Items in order and the weight of all items up to each."""
        v = np.concatenate([x for lv in self.levels for x in lv] or [np.zeros(0)])
        w = np.concatenate([np.full(self.sizes[h], float(1 << h)) for h in range(len(self.levels))] or [np.zeros(0)])
        o = np.argsort(v, kind="stable")
        return v[o], np.cumsum(w[o])

    def quantiles(self, ps: list[float]) -> list[float | None]:
        """Value at rank ceil(p * n) for each p; ranks are counted from the protected high end."""
        if not self.n:
            return [None] * len(ps)
        v, up = self.weighted()
        total = up[-1]
        out: list[float | None] = []
        for p in ps:
            if p <= 0:
                out.append(self.low)
            elif p >= 1:
                out.append(self.high)
            else:
                above = self.n - max(1, int(np.ceil(p * self.n)))  # rows above the answer
                out.append(float(v[min(len(v) - 1, int(np.searchsorted(up, total - above, side="left")))]))
        return out

    def dump(self) -> bytes:
        head = struct.pack("<iqddi", self.k, self.n, self.low, self.high, len(self.levels))
        for h in range(len(self.levels)):
            head += struct.pack("<qqid", self.sizes[h], self.state[h], self.sections[h], self.width[h])
        return head + np.concatenate([x for lv in self.levels for x in lv] or [np.zeros(0)]).astype("<f8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> RelativeSketch:
        k, n, low, high, m = struct.unpack_from("<iqddi", data)
        s = cls(k)
        s.n, s.low, s.high = n, low, high
        at = struct.calcsize("<iqddi")
        s.levels, s.sizes, s.state, s.sections, s.width = [], [], [], [], []
        for _ in range(m):
            size, state, sections, width = struct.unpack_from("<qqid", data, at)
            at += struct.calcsize("<qqid")
            s.sizes.append(size), s.state.append(state), s.sections.append(sections), s.width.append(width)
        flat = np.frombuffer(data, "<f8", offset=at)
        at = 0
        for size in s.sizes:
            s.levels.append([flat[at : at + size].copy()] if size else [])
            at += size
        return s


def clean_group(col: Column) -> Column:
    """A group name in one spelling: trimmed, lower case, inner blanks and hyphens as _."""
    t = F.lower(F.regexp_replace(col, r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$", ""))
    return F.regexp_replace(t, r"[\s\p{IsWhite_Space}-]+", "_")


def distinct_calls(calls: DataFrame, group_cols: list[str], value_col: str, id_col: str, time_col: str | None = None) -> DataFrame:
    """One row per call: groups, ``day`` (with a time column) and ``value``; a call delivered twice counts once.

    Rows are spread by the call's id alone, which both copies share: a group of
    any size lies in all partitions alike, where the copies meet and the
    sketches are then built without a second shuffle.  Rows without an id
    cannot be told to be copies: each counts, in the partition where it is read.
    """
    day = [F.to_date(F.col(time_col)).alias("day")] if time_col else []
    src = calls.select(*[clean_group(F.col(c)).alias(c) for c in group_cols], *day, F.col(id_col).alias("_id"), F.col(value_col).cast("double").alias("value"))
    names = [*group_cols, *(["day"] if time_col else [])]
    once = src.where("_id is not null").repartition("_id").groupBy(*names, "_id").agg(F.max("value").alias("value")).drop("_id")
    return once.unionByName(src.where("_id is null").drop("_id"))


def build_sketches(rows: DataFrame, group_cols: list[str], value_col: str = "value", k: int = K) -> DataFrame:
    """Partial sketches per partition and group (``group_cols``): count, left-out count and binary sketch.

    Every partition folds its rows in batches; memory holds one sketch per
    group seen, never the rows of a group.
    """
    src = rows.select(*group_cols, F.col(value_col).cast("double").alias("_v"))
    types = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, RelativeSketch] = {}
        skipped: dict[tuple, int] = {}
        for pdf in batches:
            codes, keys = pd.factorize(pd.MultiIndex.from_frame(pdf[group_cols].astype(object).where(pdf[group_cols].notna(), None)) if len(group_cols) > 1 else pdf[group_cols[0]], use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            vals = pdf["_v"].to_numpy(np.float64, na_value=np.nan)[order]
            edges = np.searchsorted(codes[order], np.arange(len(keys) + 1))
            for j, key in enumerate(keys):
                key = tuple(None if x is None or x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                part = vals[edges[j] : edges[j + 1]]
                good = part[part >= 0]  # nan and negative values fail this
                skipped[key] = skipped.get(key, 0) + len(part) - len(good)
                held.setdefault(key, RelativeSketch(k)).add(good)
        out = [(*key, s.n, skipped[key], s.dump()) for key, s in held.items()]
        yield pd.DataFrame(out, columns=[*group_cols, "n", "n_left_out", "sketch"])

    schema = ", ".join(f"{c} {types[c]}" for c in group_cols) + ", n long, n_left_out long, sketch binary"
    return src.mapInPandas(run, schema)


def merge_sketches(parts: DataFrame, group_cols: list[str], fan_in: int = 64) -> DataFrame:
    """One sketch per group; groups with very many parts are merged in two steps."""
    if fan_in > 1:
        some = parts.withColumn("_part", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)).cast("int"))
        parts = _folded(some, [*group_cols, "_part"]).drop("_part")
    return _folded(parts, group_cols)


def _folded(parts: DataFrame, names: list[str]) -> DataFrame:
    """One sketch per group: each task holds one for every group it meets."""
    types = dict(parts.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            keys = pdf[names].astype(object).where(pdf[names].notna(), None)
            for key, data, n, left in zip(keys.itertuples(index=False, name=None), pdf["sketch"], pdf["n"], pdf["n_left_out"]):
                s = RelativeSketch.load(bytes(data))
                if key not in held:
                    held[key] = [s, int(n), int(left)]
                else:
                    one = held[key]
                    one[0].merge(s)
                    one[1] += int(n)
                    one[2] += int(left)
        yield pd.DataFrame([(*key, n, left, s.dump()) for key, (s, n, left) in held.items()], columns=[*names, "n", "n_left_out", "sketch"])

    return parts.repartition(*names).mapInPandas(fold, ", ".join(f"{c} {types[c]}" for c in names) + ", n long, n_left_out long, sketch binary")


def read_percentiles(sketches: DataFrame, group_cols: list[str], ps: dict[str, float]) -> DataFrame:
    """Percentile columns of each group, and per percentile the stated bound of its rank error (``<name>_rank_error``)."""
    types = dict(sketches.dtypes)
    names = list(ps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["sketch"]:
                s = RelativeSketch.load(bytes(data))
                rows.append([*s.quantiles([ps[x] for x in names]), *[rank_error(s.n, ps[x], s.k) for x in names]])
            yield pd.concat([pdf[[*group_cols, "n", "n_left_out"]].reset_index(drop=True), pd.DataFrame(rows, columns=[*names, *[f"{x}_rank_error" for x in names]])], axis=1)

    schema = ", ".join(f"{c} {types[c]}" for c in group_cols) + ", n long, n_left_out long, " + ", ".join(f"{x} double" for x in names) + ", " + ", ".join(f"{x}_rank_error double" for x in names)
    return sketches.mapInPandas(run, schema)


def rank_error(n: int, p: float, k: int = K) -> float:
    """Stated bound of the rank error of the value given for p, in rows."""
    return 1.0 + ERROR / k * (1 - p) * n
