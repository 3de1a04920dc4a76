"""Hash mixing, hash families, and bucket signatures.

Fixed values: the additive and multiplicative constants and the shifts of the
two mixers decide every bucket, so they are part of the results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinal.options import HashFamily, LshOptions

GOLDEN_32, MUL_32 = 0x9E3779B9, (0x21F0AAAD, 0x735A2D97)
SHIFTS_32 = (16, 15, 15)
GOLDEN_64, MUL_64 = 0x9E3779B97F4A7C15, 0xE9846AF9B1A615D
SHIFTS_64 = (32, 32, 28)
MASK = 0xFFFFFFFF


def hash_combine_u32(seed: Column, value: Column) -> Column:
    """Mixes a value into a seed; both are BIGINT holding 0..2**32-1.

    Factors stay below 2**31, so no product leaves 63 bits.
    """
    step = lambda f: lambda x: F.transform(F.array(x), f)[0]  # noqa: E731  binds x once
    s1, s2, s3 = SHIFTS_32
    x = seed.cast("bigint") + F.lit(GOLDEN_32) + value.cast("bigint")
    x = x.bitwiseAND(F.lit(MASK))
    x = step(lambda y: (y.bitwiseXOR(F.shiftrightunsigned(y, s1)) * F.lit(MUL_32[0])).bitwiseAND(F.lit(MASK)))(x)
    x = step(lambda y: (y.bitwiseXOR(F.shiftrightunsigned(y, s2)) * F.lit(MUL_32[1])).bitwiseAND(F.lit(MASK)))(x)
    return step(lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, s3)))(x)


def combine_u32(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """hash_combine_u32 for arrays of uint32."""
    x = seed.astype(np.uint32) + np.uint32(GOLDEN_32) + value.astype(np.uint32)
    for shift, factor in zip(SHIFTS_32, (*MUL_32, 1), strict=True):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x


def combine_u64(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The 64-bit mixer, for arrays of uint64 that wrap around."""
    x = seed.astype(np.uint64) + np.uint64(GOLDEN_64) + value.astype(np.uint64)
    for shift, factor in zip(SHIFTS_64, (MUL_64, MUL_64, 1), strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def hash_combine_u64(seed: Column, value: Column) -> Column:
    """The 64-bit mixer on BIGINTs taken as unsigned; Spark's products may not wrap, so batches go through NumPy."""

    @F.pandas_udf("bigint")
    def mixed(s: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(combine_u64(s.to_numpy(np.int64).view(np.uint64), v.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return mixed(seed.cast("bigint"), value.cast("bigint"))


@dataclass
class HashFunctions:
    """A pool of functions and the choice of one for every (table, slot)."""

    options: LshOptions
    coeffs: np.ndarray  # (pool, dims)
    offsets: np.ndarray  # (pool,)
    choice: np.ndarray  # (tables, slots)
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (pool or tables, cut-off points - 1)

    @property
    def needs_cuts(self) -> bool:
        return self.options.family is not HashFamily.RANDOM_PROJECTIONS


def draw_functions(options: LshOptions, dims: int) -> HashFunctions:
    """Draws the pool and the choice with NumPy from the options' seed.

    Projections with an offset have coefficients |N(0,1)| and an offset from
    [0, w); entropy-based ones have N(0,1) and none.
    """
    rng = np.random.default_rng(options.seed)
    coeffs = rng.standard_normal((options.hash_pool_size, dims))
    offsets = rng.uniform(0, options.w, options.hash_pool_size)
    if options.family is HashFamily.ENTROPY_BASED:
        offsets[:] = 0
    else:
        coeffs = np.abs(coeffs)
    choice = rng.integers(0, options.hash_pool_size, (options.num_hash_tables, options.num_hash_functions))
    return HashFunctions(options, coeffs, offsets, choice)


def project(x: np.ndarray, coeffs: np.ndarray) -> np.ndarray:
    """Dot products (rows, functions), added in the order of the dimensions as a fold over the array does."""
    out = np.zeros((len(x), len(coeffs)))
    for d in range(coeffs.shape[1]):
        out += x[:, d : d + 1] * coeffs[:, d]
    return out


def slots(x: np.ndarray, fns: HashFunctions) -> np.ndarray:
    """Segment numbers (rows, pool) of the families with an offset, as signed integers."""
    v = (fns.offsets + project(x, fns.coeffs)) / fns.options.w
    return (np.floor(v) if fns.options.rounding == "floor" else np.trunc(v)).astype(np.int64)


def table_sums(x: np.ndarray, fns: HashFunctions) -> np.ndarray:
    """Sums of a table's segment numbers (rows, tables), the mixed family's value."""
    s = slots(x, fns)
    return np.stack([s[:, c].sum(1) for c in fns.choice], 1)


def cut_values(x: np.ndarray, fns: HashFunctions) -> np.ndarray:
    """What the cut-off points divide: projections of the pool, or sums of the tables."""
    return table_sums(x, fns).astype(float) if fns.options.family is HashFamily.MIXED else project(x, fns.coeffs)


def signatures(x: np.ndarray, fns: HashFunctions) -> np.ndarray:
    """Bucket numbers (rows, tables)."""
    o = fns.options
    if o.family is HashFamily.MIXED:
        sums = table_sums(x, fns)
        return np.stack([np.searchsorted(c, sums[:, t], side="left") for t, c in enumerate(fns.cuts)], 1) % o.buckets
    if o.family is HashFamily.ENTROPY_BASED:
        p = project(x, fns.coeffs)
        values = np.stack([np.searchsorted(c, p[:, f], side="left") for f, c in enumerate(fns.cuts)], 1)
    else:
        values = slots(x, fns) & MASK
    out = np.zeros((len(x), o.num_hash_tables), np.int64)
    for t, own in enumerate(fns.choice):
        h = np.full(len(x), o.num_hash_functions, np.uint32)
        for f in own:
            h = combine_u32(h, values[:, f])
        out[:, t] = h.astype(np.int64) % o.buckets
    return out


def cut_ranks(n: int, options: LshOptions) -> list[int]:
    """0-based ranks of the cut-off points among n sorted values.

    The mixed family spreads the remainder over the first parts; the
    entropy-based one leaves it to the last.
    """
    c = options.num_cut_off_points
    if options.family is HashFamily.MIXED:
        return [(i + 1) * (n // c) + min(i + 1, n % c) for i in range(c - 1)]
    return [(i + 1) * (n // c) for i in range(c - 1)]
