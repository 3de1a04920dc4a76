"""Vectors as ARRAY<FLOAT> columns: checks, expressions, and conversions to NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.errors import VectorError


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, added from left to right."""
    gap = lambda x, y: x.cast("double") - y.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: gap(x, y) * gap(x, y)), F.lit(0.0), lambda s, v: s + v)


def as_points(df: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The table as (id BIGINT, vec ARRAY<FLOAT>)."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def attributes(points: DataFrame) -> DataFrame:
    """One row (total_size, dims), with the checks that a fit needs: (bad, min_dims)."""
    odd = F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.col("id").isNull()
    return points.agg(
        F.count("*").alias("total_size"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dims"),
        F.coalesce(F.min(F.size("vec")), F.lit(0)).alias("min_dims"), F.coalesce(F.sum(odd.cast("bigint")), F.lit(0)).alias("bad"),
    )


def checked_attributes(points: DataFrame) -> tuple[int, int]:
    """(rows, dimensions); raises VectorError unless all vectors are whole and equally long."""
    r = attributes(points).first()
    if r["total_size"] == 0:
        raise VectorError("the data set is empty")
    if r["bad"] or r["dims"] < 1 or r["min_dims"] != r["dims"]:
        raise VectorError(f"vectors must be complete, finite and of one length (lengths {r['min_dims']} to {r['dims']}, {r['bad']} bad rows)")
    return r["total_size"], r["dims"]


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
