"""The approximate nearest-neighbour estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.errors import InvalidOptionError, NotFittedError, VectorError
from vicinal.functions.hashing import HashFunctions, cut_ranks, cut_values, draw_functions, signatures
from vicinal.functions.vectors import checked_attributes, to_matrix
from vicinal.operators import search as searching
from vicinal.operators.metrics import KnnResult
from vicinal.options import HashFamily, LshOptions
from vicinal.profiling import Profiler

#: Bins of about equally many values, in the first pass over what cut-off points divide; their edges are quantiles of this accuracy.
CUT_BINS, ACCURACY = 1024, 10_240


def values_of(points: DataFrame, fns: HashFunctions, edges: np.ndarray | None = None) -> DataFrame:
    """(fn, value, bin) of all points: what the cut-off points of function or table fn divide, and between which edges it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = cut_values(to_matrix(b.column(0)).astype(float), fns)
                bins = np.zeros(v.shape, np.int32)
                if edges is not None:
                    for f in range(v.shape[1]):
                        bins[:, f] = np.searchsorted(edges[f], v[:, f])
                yield pa.RecordBatch.from_pydict({"fn": pa.array(np.tile(np.arange(v.shape[1], dtype=np.int32), len(v))), "value": pa.array(v.reshape(-1)), "bin": pa.array(bins.reshape(-1))})

    return points.select("vec").mapInArrow(run, "fn int, value double, bin int")


def equi_depth_cuts(points: DataFrame, fns: HashFunctions, n: int) -> DataFrame:
    """Exact cut-off points (fn, cut_index, cut_value) without a global sort.

    Approximate quantiles cut the values of each function into bins of about
    equally many, whatever their distribution; exact counts find the bin of
    every wanted rank, and only those bins' own values, counted by value, are
    ranked.  A value that many points share is one row.
    """
    spark = points.sparkSession
    quantiles = F.percentile_approx("value", [i / CUT_BINS for i in range(1, CUT_BINS)], ACCURACY)
    rows = values_of(points, fns).groupBy("fn").agg(quantiles.alias("edges")).collect()  # one row for each function
    edges = np.array([r["edges"] for r in sorted(rows, key=lambda r: r["fn"])])
    binned = values_of(points, fns, edges).persist()
    counts = binned.groupBy("fn", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("fn").orderBy("bin"))  # CUT_BINS rows for each function at most
    placed = counts.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("n"))
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate(cut_ranks(n, fns.options))], "cut_index int, rank_at bigint")
    wanted = placed.join(F.broadcast(ranks), (F.col("begin") <= F.col("rank_at")) & (F.col("rank_at") < F.col("end"))).select("fn", "bin", "cut_index", (F.col("rank_at") - F.col("begin")).alias("inside"))
    held = binned.join(F.broadcast(wanted.select("fn", "bin").distinct()), ["fn", "bin"]).groupBy("fn", "bin", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("fn", "bin").orderBy("value"))
    held = held.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("n"))
    cuts = held.join(F.broadcast(wanted), ["fn", "bin"]).where("begin <= inside AND inside < end").select("fn", "cut_index", F.col("value").alias("cut_value"))
    found = [tuple(r) for r in cuts.collect()]  # functions times cut-off points
    binned.unpersist()
    return spark.createDataFrame(found, "fn int, cut_index int, cut_value double")


@dataclass
class FittedIndex:
    """Hash functions and signatures of a fitted data set."""

    options: LshOptions
    functions: HashFunctions
    points: DataFrame  # (id, sig, vec)
    total_size: int
    dims: int

    def signed(self, points: DataFrame) -> DataFrame:
        """Adds sig, the bucket of every table, to (id, vec)."""
        fns = self.functions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = signatures(to_matrix(b.column(1)).astype(float), fns)
                    offsets = pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(s.reshape(-1))), b.column(1)], names=["id", "sig", "vec"])

        return points.select("id", "vec").mapInArrow(run, "id bigint, sig array<bigint>, vec array<float>")

    @property
    def buckets(self) -> DataFrame:
        """(hash_table, bucket, id)."""
        return self.points.select(F.posexplode("sig").alias("hash_table", "bucket"), "id")

    def bucket_counts(self) -> DataFrame:
        """(hash_table, bucket, n) of all buckets that are not empty."""
        return self.buckets.groupBy("hash_table", "bucket").agg(F.count("*").alias("n"))

    def bucket_offsets(self) -> DataFrame:
        """(hash_table, bucket, n, offset): entries of the table before the bucket.  A table has at most its size in rows."""
        before = F.sum("n").over(Window.partitionBy("hash_table").orderBy("bucket")) - F.col("n")
        return self.bucket_counts().withColumn("offset", before)

    def keyed(self, signed: DataFrame) -> DataFrame:
        """(id, keys, vec): the buckets of all tables as one array of numbers."""
        number = "int" if self.options.num_hash_tables * self.options.buckets < 2**31 else "bigint"
        keys = F.transform("sig", lambda b, t: (t.cast("bigint") * F.lit(self.options.buckets) + b).cast(number))
        return signed.select("id", keys.alias("keys"), "vec")

    def members(self) -> DataFrame:
        """What searches find in each bucket, as (id, keys, vec); with overscan, entries past a bucket's end as well.

        Entries stand in the order (hash_table, bucket, id).  A bucket is read
        in strides of `overscan` entries from its start, so up to overscan - 1
        entries of what follows, in the next tables too, are candidates.
        """
        own, stride = self.keyed(self.points), self.options.overscan
        if stride < 2:
            return own
        n = self.total_size
        offsets = self.bucket_offsets()
        first = F.col("hash_table") * F.lit(n).cast("bigint") + F.col("offset")
        past = F.pmod(-F.col("n"), F.lit(stride))
        more = offsets.where(past > 0).select("hash_table", "bucket", F.explode(F.sequence(first + F.col("n"), first + F.col("n") + past - 1)).alias("at"))
        # only the first entries of a bucket are ever read so, those that what ends before it reaches
        inside = F.row_number().over(Window.partitionBy("hash_table", "bucket").orderBy("id"))
        placed = self.buckets.withColumn("inside", inside).where(F.col("inside") <= stride).join(offsets, ["hash_table", "bucket"]).select((first + F.col("inside") - 1).alias("at"), "id")
        key = (F.col("hash_table").cast("bigint") * F.lit(self.options.buckets) + F.col("bucket")).cast(own.schema["keys"].dataType.elementType)
        reached = more.join(placed, "at").groupBy("id").agg(F.collect_set(key).alias("more"))
        keys = F.when(F.col("more").isNull(), F.col("keys")).otherwise(F.array_union("keys", "more"))
        return own.join(reached, "id", "left").select("id", keys.alias("keys"), "vec")


class ApproxKNN:
    """k nearest neighbours by locality-sensitive hashing.

    >>> knn = ApproxKNN(LshOptions(num_hash_tables=4), k=10).fit(points)
    >>> knn.kneighbors().table          # (query_id, rank, neighbor_id, distance)

    Points are (id BIGINT, vec ARRAY<FLOAT>) with unique ids.  Distances are
    Euclidean; ties go to the smaller id.
    """

    def __init__(self, options: LshOptions | None = None, k: int = 5, profiler: Profiler | None = None, work_group_size: int = 512):
        if k < 1 or work_group_size < 1:
            raise InvalidOptionError("k and work_group_size must be 1 at least")
        self.options, self.k, self.profiler = options or LshOptions(), k, profiler or Profiler()
        self.work_group_size = work_group_size  # accepted; Spark sizes its own tasks
        self.index: FittedIndex | None = None

    def fit(self, points: DataFrame, functions: HashFunctions | None = None) -> ApproxKNN:
        """Draws (or takes) hash functions and signs all points."""
        with self.profiler.timed("fit", "total_runtime"):
            n, dims = checked_attributes(points)
            o = self.options
            fns = functions or draw_functions(o, dims)
            if fns.coeffs.shape[1] != dims:
                raise VectorError(f"hash functions have {fns.coeffs.shape[1]} dimensions, the points {dims}")
            if o.family is HashFamily.MIXED and n < o.num_cut_off_points:
                raise InvalidOptionError("the mixed family needs as many points as cut-off points")
            if fns.needs_cuts and not fns.cuts.size:
                rows = equi_depth_cuts(points, fns, n).collect()  # functions times cut-off points
                width = len(fns.choice) if o.family is HashFamily.MIXED else len(fns.coeffs)
                fns.cuts = np.zeros((width, o.num_cut_off_points - 1))
                for r in rows:
                    fns.cuts[r["fn"], r["cut_index"]] = r["cut_value"]
            index = FittedIndex(o, fns, points, n, dims)
            index.points = index.signed(points).persist()
            self.index = index
        self.profiler.add("fit", "total_size", n)
        self.profiler.add("fit", "dims", dims)
        return self

    def release(self) -> None:
        """Gives the fitted points' memory back; the estimator must be fitted again before a search."""
        if self.index is not None:
            self.index.points.unpersist()
            self.index = None

    def kneighbors(self, queries: DataFrame | None = None, k: int | None = None, return_distance: bool = True, exclude_same_id: bool | None = None) -> KnnResult:
        """Neighbours of the fitted points, or of other points.

        A point is no neighbour of itself; with other points as queries,
        equal ids are excluded only on demand.
        """
        if self.index is None:
            raise NotFittedError("call fit() first")
        k = self.k if k is None else k
        index = self.index
        n, dims = (index.total_size, index.dims) if queries is None else checked_attributes(queries)
        if dims != index.dims:
            raise VectorError(f"the index has {index.dims} dimensions, the queries {dims}")
        if k < 1 or k > n:
            raise InvalidOptionError(f"k ({k}) must be between 1 and the number of queries ({n})")
        signed = index.points if queries is None else index.signed(queries)
        same = queries is None if exclude_same_id is None else exclude_same_id
        table = searching.search(index.members(), index.keyed(signed), k, same, self.options.num_hash_tables, (index.total_size, n, dims))
        return KnnResult(table, signed.select("id"), k, n, return_distance, self.profiler)

    def candidate_counts(self, queries: DataFrame | None = None) -> DataFrame:
        """(hash_table, query_id, candidates): pairs that meet first in that table; each pair counts once."""
        if self.index is None:
            raise NotFittedError("call fit() first")
        signed = self.index.points if queries is None else self.index.signed(queries)
        return searching.count_candidates(self.index.points.select("id", "sig"), signed.select("id", "sig"), queries is None, self.options.num_hash_tables)
