"""Results of a search and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.errors import InvalidOptionError, VicinalError
from vicinal.profiling import Profiler

#: Distance of a slot without a neighbour: the largest float.
NOT_FOUND = 3.4028234663852886e38


class KnnResult:
    """Neighbours as a long table (query_id, rank, neighbor_id, distance); rank 1 is the nearest."""

    def __init__(self, table: DataFrame, ids: DataFrame, k: int, n_queries: int, has_distances: bool = True, profiler: Profiler | None = None):
        self._full, self.ids, self.k, self.n_queries, self.has_distances = table, ids, k, n_queries, has_distances
        self.profiler = profiler or Profiler()

    @property
    def table(self) -> DataFrame:
        return self._full if self.has_distances else self._full.drop("distance")

    def of(self, query_id: int) -> DataFrame:
        """One query's neighbours in order; the id must be one of the queries'."""
        if self.ids.where(F.col("id") == query_id).isEmpty():
            raise InvalidOptionError(f"{query_id} is no query's id")
        return self.table.where(F.col("query_id") == query_id).orderBy("rank")

    def padded(self) -> DataFrame:
        """k rows for every query; empty slots hold the query's own id at the largest float."""
        slots = self.ids.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(self.k))).alias("rank"))
        full = slots.join(self._full, ["query_id", "rank"], "left").select(
            "query_id", "rank", F.coalesce("neighbor_id", "query_id").alias("neighbor_id"), F.coalesce("distance", F.lit(NOT_FOUND)).alias("distance")
        )
        return full if self.has_distances else full.drop("distance")

    def wide(self) -> DataFrame:
        """One row for each query: (query_id, neighbors, distances), nearest first."""
        rows = self.padded().groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in ("neighbor_id", "distance") if c != "distance" or self.has_distances]))).alias("r"))
        out = rows.select("query_id", F.col("r.neighbor_id").alias("neighbors"), *([F.col("r.distance").alias("distances")] if self.has_distances else []))
        return out

    def save_indices(self, path: str) -> None:
        """Writes the neighbours' ids, k for each query in the order of their ids, as a binary matrix of 64-bit integers."""
        from vicinal.sources import write_knnbin

        rows = self.wide().persist()  # the writer reads its rows several times
        write_knnbin(rows, path, "long", "query_id", "neighbors")
        rows.unpersist()

    def save_distances(self, path: str) -> None:
        """Writes the distances likewise, as a binary matrix of doubles."""
        from vicinal.sources import write_knnbin

        if not self.has_distances:
            raise VicinalError("the search was made without distances")
        rows = self.wide().persist()
        write_knnbin(rows, path, "double", "query_id", "distances")
        rows.unpersist()

    def recall(self, truth: DataFrame) -> DataFrame:
        """One row (recall in percent, correct, total); the total is queries times k."""
        return recall(self._full, truth, self.n_queries, self.k)

    def error_ratio(self, truth: DataFrame) -> DataFrame:
        """One row (error_ratio, points_incomplete, neighbors_missing)."""
        if not self.has_distances:
            raise VicinalError("the search was made without distances")
        return error_ratio(self._full, truth, self.ids, self.k)


def recall(found: DataFrame, truth: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Share of the slots whose neighbour is among the query's true ones.

    The truth must hold k neighbours of every query, or the query fails.
    """
    both = truth.select("query_id", "neighbor_id").join(found.select("query_id", "neighbor_id", F.lit(1).alias("hit")), ["query_id", "neighbor_id"], "left")
    total = n_queries * k
    fits = F.when(F.col("given") != total, F.raise_error(F.lit(f"the truth must have {total} rows: {k} for each of {n_queries} queries")))
    counts = both.agg(F.count("*").alias("given"), F.count("hit").alias("correct"))
    return counts.select(F.coalesce(fits.cast("double"), F.col("correct") * 100.0 / total).alias("recall"), "correct", F.lit(total).cast("bigint").alias("total"))


def error_ratio(found: DataFrame, truth: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Mean over complete queries of the mean ratio of found to true distances at equal ranks.

    A slot with a true distance of 0 counts as 1 if the found one is 0 too and
    not at all otherwise; queries with fewer than k neighbours are counted
    and left out.  Without any usable query the ratio is null.  The truth must
    hold k neighbours of every query, or the query fails.
    """
    order = Window.partitionBy("query_id").orderBy("distance")
    ranked = lambda df, name: df.select("query_id", F.row_number().over(order).alias("slot"), F.col("distance").alias(name))
    ratio = F.when(F.col("t") != 0, F.col("f") / F.col("t")).when(F.col("f") == 0, F.lit(1.0))
    slots = ranked(truth, "t").withColumn("true", F.lit(1)).join(ranked(found, "f").withColumn("hit", F.lit(1)), ["query_id", "slot"], "full")  # each side is searched once
    each = slots.groupBy("query_id").agg(F.avg(ratio).alias("ratio"), F.count("true").alias("given"), F.count("hit").alias("n"))
    counts = ids.select(F.col("id").alias("query_id")).join(each, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unlike = F.max(F.coalesce(F.col("given"), F.lit(0)) != k)
    fits = F.when(unlike, F.raise_error(F.lit(f"the truth must have {k} rows for each query")))
    return counts.agg(
        F.coalesce(fits.cast("double"), F.avg(F.when(F.col("n") >= k, F.col("ratio")))).alias("error_ratio"),
        F.coalesce(F.sum((F.col("n") < k).cast("bigint")), F.lit(0)).alias("points_incomplete"),
        F.coalesce(F.sum(F.greatest(F.lit(k) - F.col("n"), F.lit(0))), F.lit(0)).cast("bigint").alias("neighbors_missing"),
    )
