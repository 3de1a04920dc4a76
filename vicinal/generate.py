"""Synthetic vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ramp(spark: SparkSession, n: int, dims: int) -> DataFrame:
    """(id, vec) holding the numbers 0, 1, ... modulo n, row by row."""
    at = lambda j: F.pmod(F.col("id") * dims + j, F.lit(n)).cast("float")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at).alias("vec"))


def centres(dims: int, clusters: int = 3, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).uniform(-10, 10, (clusters, dims))


def _uniform(*parts: object) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def blobs(spark: SparkSession, n: int, dims: int, clusters: int = 3, std: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, vec, cluster): normal clouds around centres drawn from [-10, 10), the same however rows are partitioned."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres(dims, clusters, seed)])
    base = spark.range(n).withColumn("cluster", F.pmod("id", F.lit(clusters)).cast("int"))
    key = F.col("id").cast("string")
    noise = F.array(*[F.sqrt(-2 * F.ln(_uniform(seed, key, j, "r"))) * F.cos(F.lit(6.283185307179586) * _uniform(seed, key, j, "a")) for j in range(dims)])  # Box and Muller
    vec = F.zip_with(table[F.col("cluster")], noise, lambda c, z: (c + z * std).cast("float"))
    return base.select("id", vec.alias("vec"), "cluster")


def minmax_scaled(points: DataFrame) -> DataFrame:
    """(id, vec) with every dimension scaled to [0, 1]; a constant dimension becomes 0."""
    spans = points.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    table = spans.agg(F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("s"))  # one row of as many entries as dimensions
    scale = lambda x, s: F.when(s["hi"] > s["lo"], (x.cast("double") - s["lo"]) / (s["hi"] - s["lo"])).otherwise(F.lit(0.0)).cast("float")
    return points.crossJoin(F.broadcast(table)).select("id", F.zip_with("vec", "s", scale).alias("vec"))
