"""Command line: python -m vicinal [options] FILE K."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vicinal import sources
from vicinal.errors import VicinalError
from vicinal.functions.vectors import as_points
from vicinal.operators.index import ApproxKNN
from vicinal.options import FileFormat, LshOptions, Profiling
from vicinal.profiling import Profiler


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("vicinal", description="Approximate k nearest neighbours on Spark.")
    p.add_argument("file", help="vectors: binary, .arff, .csv, .libsvm, or a Parquet table (id, vec) or (vec_id, embedding)")
    p.add_argument("k", type=int)
    p.add_argument("--file_parser", default="binary")
    p.add_argument("--profiling_type", default="none")
    p.add_argument("--profiling_file")
    for name in ("indices_save_file", "distances_save_file", "indices_ground_truth_file", "distances_ground_truth_file"):
        p.add_argument(f"--{name}")
    p.add_argument("--work_group_size", type=int, default=512)
    p.add_argument("--hash_function", default="random_projections")
    for name, default in (("hash_pool_size", 32), ("num_hash_functions", 12), ("num_hash_tables", 8), ("hash_table_size", 105_613), ("num_cut_off_points", 6), ("seed", 42)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--w", type=float, default=1.0)
    return p


def load(spark: SparkSession, path: str, kind: FileFormat):
    if kind is FileFormat.ARFF or path.endswith(".arff"):
        return sources.read_arff(spark, path)
    if path.endswith(".csv"):
        return sources.read_vector_csv(spark, path)
    if path.endswith(".libsvm"):
        return sources.read_libsvm(spark, path)
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return as_points(df, *(("vec_id", "embedding") if "vec_id" in df.columns else ("id", "vec")))
    return sources.read_knnbin(spark, path)


def as_truth(df, name: str):
    """Rows of a ground-truth matrix as (query_id, rank, value)."""
    return df.select(F.col("id").alias("query_id"), F.posexplode("vec").alias("rank", name)).withColumn("rank", F.col("rank") + 1)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        kind = FileFormat.parse(args.file_parser)
        profiler = Profiler(Profiling.parse(args.profiling_type))
        options = LshOptions(args.hash_function, args.hash_pool_size, args.num_hash_functions, args.num_hash_tables, args.hash_table_size, args.w, args.num_cut_off_points, args.seed)
        spark = SparkSession.builder.appName("vicinal").getOrCreate()
        for line in options.describe().splitlines():
            profiler.add("options", *line.split(": ", 1))
        with profiler.timed("total", "total_runtime"):
            points = load(spark, args.file, kind)
            result = ApproxKNN(options, args.k, profiler, args.work_group_size).fit(points).kneighbors()
            with profiler.timed("nearest_neighbors", "total_runtime"):
                result._full = result._full.persist()
                result._full.count()
        profiler.add("data_set", "file", args.file)
        for name, save in (("indices_save_file", result.save_indices), ("distances_save_file", result.save_distances)):
            if path := getattr(args, name):
                with profiler.timed(name, "total_runtime"):
                    save(path)
                profiler.add(name, "file", path)
        if args.indices_ground_truth_file:
            truth = as_truth(sources.read_knnbin(spark, args.indices_ground_truth_file, "long"), "neighbor_id")
            r = result.recall(truth).first()
            profiler.add("recall", "recall", r["recall"])
            print(f"recall: {r['recall']:.4f} % ({r['correct']}/{r['total']})")
        if args.distances_ground_truth_file:
            truth = as_truth(sources.read_knnbin(spark, args.distances_ground_truth_file, "double"), "distance")
            e = result.error_ratio(truth).first()
            profiler.add("error_ratio", "error_ratio", e["error_ratio"])
            print(f"error ratio: {e['error_ratio']} ({e['points_incomplete']} points without {e['neighbors_missing']} neighbours)")
        if args.profiling_file:
            profiler.dump(args.profiling_file)
    except VicinalError as e:
        print(f"vicinal: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
