"""FNV-1a over many strings at once: one step a byte position for a whole Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# FNV-1a's start and prime, and the steps of the linear congruential generator.
FNV_START, FNV_PRIME = 2166136261, 16777619
LCG_A, LCG_C = 1664525, 1013904223


def fnv1a_all(texts: list[str | None], start: np.ndarray | None = None) -> np.ndarray:
    """32-bit hashes of the texts' UTF-8 bytes, as signed 64-bit numbers; null hashes as empty.

    ``start``: hashes to go on from. Long texts are finished one by one: a vector step a byte is for many texts.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")  # longest first: those still open are a prefix
    first = np.zeros(len(raw), np.int64)
    np.cumsum(size[:-1], out=first[1:]) if len(raw) > 1 else None
    data = np.frombuffer(b"".join(raw), np.uint8)
    first, size = first[order], size[order]
    h = np.full(len(raw), FNV_START, np.uint64) if start is None else start.astype(np.uint64)[order]
    open_ = len(raw)
    for k in range(int(size[0]) if len(raw) else 0):
        open_ = int(np.searchsorted(-size[:open_], -k, side="left"))
        if open_ < 8:
            for i in range(open_):
                x = int(h[i])
                for b in raw[order[i]][k:]:
                    x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFF
                h[i] = x
            break
        h[:open_] = ((h[:open_] ^ data[first[:open_] + k]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(raw), np.int64)
    out[order] = h.astype(np.int64)
    return out


@F.pandas_udf(LongType())
def fnv1a(texts: pd.Series) -> pd.Series:
    return pd.Series(fnv1a_all(texts.tolist()))


def hex8(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def lcg(number: Column) -> Column:
    return (number * F.lit(LCG_A).cast("long") + F.lit(LCG_C)).bitwiseAND(F.lit(0xFFFFFFFF))


def shuffled(n: int, seed: int) -> list[int]:
    """0 .. n-1 in the order of a downward exchange shuffle driven by the generator."""
    order = list(range(n))
    state = seed & 0xFFFFFFFF
    for last in range(n - 1, 0, -1):
        state = (state * LCG_A + LCG_C) & 0xFFFFFFFF
        pick = state % (last + 1)
        order[last], order[pick] = order[pick], order[last]
    return order
