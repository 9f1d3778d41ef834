"""Fixed-size arrays that all tasks build together: frequency sketches and membership filters.

A task makes one array and gives it away as sparse blocks; blocks of the same place are merged FAN at a time
in rounds, so no task ever holds more than FAN of them, however many tasks there are. What comes to the driver
is the one merged array, of a size that its maker states.

Edge cases: no rows give an array of zeros; null keys are left out; equal keys count each in a sketch and once in
a filter; a filter may say yes to a key it was not given, never no to one that it was.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Places in a block, and blocks merged at a time.
PLACES = 65536
FAN = 64
#: Places that the driver takes in, one block at a time.
DIRECT = 1 << 23
BLOCKS = "part int, block int, data binary"


def sparse(values: np.ndarray) -> bytes:
    """A block of counts as the places that aren't 0 and what they hold."""
    at = np.flatnonzero(values)
    return np.array([len(at)], "<u4").tobytes() + at.astype("<u2").tobytes() + values[at].astype("<u8" if len(at) and values.max() >> 32 else "<u4").tobytes()


def dense(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.zeros(PLACES, np.int64)
    if n:
        wide = (len(data) - 4 - 2 * n) // n
        out[np.frombuffer(data, "<u2", n, 4)] = np.frombuffer(data, f"<u{wide}", n, 4 + 2 * n)
    return out


def given_away(array: np.ndarray) -> pd.DataFrame:
    """A task's array (of a multiple of PLACES) as rows of BLOCKS; blocks of zeros are left out."""
    part = TaskContext.get().partitionId()
    rows = [(part, k, sparse(b)) for k, b in enumerate(array.reshape(-1, PLACES)) if b.any()]
    return pd.DataFrame(rows, columns=["part", "block", "data"]).astype({"part": "int32", "block": "int32"})


def merged(rows: DataFrame, size: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The one array of ``size`` places from what tasks gave away (rows of BLOCKS)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = dense(pdf["data"].iloc[0])
        for data in pdf["data"].iloc[1:]:
            out = join(out, dense(data))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "block": [int(pdf["block"].iloc[0])], "data": [sparse(out)]})

    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    # what few tasks gave away is merged as it comes to the driver, DIRECT places of it at most
    while parts * size > max(DIRECT, size):
        rows = saved(rows.groupBy("block", F.expr(f"part div {FAN}")).applyInPandas(run, BLOCKS), "merged")
        parts = -(-parts // FAN)
    out = np.zeros(size, np.int64)
    for r in rows.toLocalIterator():  # at most DIRECT / PLACES rows, or size / PLACES
        at = slice(r["block"] * PLACES, (r["block"] + 1) * PLACES)
        out[at] = join(out[at], dense(bytes(r["data"])))
    return out


class Members:
    """A filter of 64-bit keys: three bits a key."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, power: int) -> Iterator[np.ndarray]:
        x = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
                h = (x ^ (x >> np.uint64(31))) * np.uint64(m)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (h >> np.uint64(64 - power)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        power = int(math.log2(8 * len(self.bits)))
        out = np.ones(len(keys), bool)
        for p in self.places(keys, power):
            out &= (self.bits[p >> 3] >> (p & 7) & 1).astype(bool)
        return out


#: Bits of the largest filter: 64 MB. With more keys it says yes oftener, which costs work and loses nothing.
MOST_BITS = 29


def members(keys: DataFrame, most: int) -> Broadcast | None:
    """A broadcast filter of the one long column of ``keys``, of which there are at most ``most`` (None: of none)."""
    (name,) = keys.columns
    if not most:
        return None
    keys = keys.where(F.col(name).isNotNull())
    power = min(MOST_BITS, max(19, math.ceil(math.log2(16 * most))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, any_ = np.zeros(1 << (power - 3), np.uint8), False
        for b in batches:
            for p in Members.places(b[name].to_numpy(np.int64), power):
                np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
                any_ = True
        if any_:
            yield given_away(bits)

    bits = merged(saved(keys.mapInPandas(run, BLOCKS), "bits"), 1 << (power - 3), np.bitwise_or).astype(np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Members(bits)) if bits.any() else None


def among(filter_: Broadcast | None, key: Column) -> Column:
    """Whether a key may be one of the filter's."""
    if filter_ is None:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def has(keys: pd.Series) -> pd.Series:
        return pd.Series(filter_.value.has(keys.to_numpy(np.int64)))

    return has(key)
