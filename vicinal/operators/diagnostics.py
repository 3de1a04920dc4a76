"""Distributions of bucket sizes and of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.index import ApproxKNN


def bucket_size_histogram(counts: DataFrame) -> DataFrame:
    """(hash_table, n, buckets): how many buckets of a table hold n points."""
    return counts.groupBy("hash_table", "n").agg(F.count("*").alias("buckets"))


def mean_bucket_sizes(counts: DataFrame) -> DataFrame:
    """(hash_table, used_buckets, mean_size, largest) over buckets that are not empty."""
    return counts.groupBy("hash_table").agg(F.count("*").alias("used_buckets"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"))


def candidate_totals(counts: DataFrame) -> DataFrame:
    """(query_id, candidates) summed over the tables."""
    return counts.groupBy("query_id").agg(F.sum("candidates").alias("candidates"))


def candidate_histogram(counts: DataFrame) -> DataFrame:
    """(hash_table, candidates, queries)."""
    return counts.groupBy("hash_table", "candidates").agg(F.count("*").alias("queries"))


def expected_pairs(counts: DataFrame) -> DataFrame:
    """One row (pairs): what a self-search would compare, to be known before it runs."""
    return counts.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("pairs"))


def _csv(path: str, header: str, cells: DataFrame) -> None:
    """One line for each key of the (key, at, n) cells, in order; the driver holds one partition at a time."""
    last = None
    with open(path, "w") as f:
        f.write(header)
        for r in cells.orderBy("key", "at").toLocalIterator():
            f.write(f",{r['n']}" if r["key"] == last else f"{'' if last is None else chr(10)}{r['key']},{r['n']}")
            last = r["key"]
        f.write("\n")


def write_bucket_csv(knn: ApproxKNN, path: str) -> None:
    """One line for each table with the sizes of all its buckets, after `# name: value` lines."""
    spark, size, o = knn.index.points.sparkSession, knn.index.options.buckets, knn.index.options
    every = spark.range(o.num_hash_tables * size).select((F.col("id") / size).cast("int").alias("hash_table"), (F.col("id") % size).alias("bucket"))
    cells = every.join(knn.index.bucket_counts(), ["hash_table", "bucket"], "left").select(F.col("hash_table").alias("key"), F.col("bucket").alias("at"), F.coalesce("n", F.lit(0)).alias("n"))
    _csv(path, o.describe("# ") + f"# num_data_points: {knn.index.total_size}\n", cells)


def write_candidate_csv(knn: ApproxKNN, path: str) -> None:
    """One line for each table with the candidates of every point, by ascending id."""
    o = knn.index.options
    every = knn.index.points.select(F.explode(F.sequence(F.lit(0), F.lit(o.num_hash_tables - 1))).alias("hash_table"), F.col("id").alias("query_id"))
    cells = every.join(knn.candidate_counts(), ["hash_table", "query_id"], "left").select(F.col("hash_table").alias("key"), F.col("query_id").alias("at"), F.coalesce("candidates", F.lit(0)).alias("n"))
    _csv(path, o.describe("# ") + f"# num_data_points: {knn.index.total_size}\n", cells)
