"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal import generate, tuning
from vicinal.functions.hashing import draw_functions, hash_combine_u32, hash_combine_u64
from vicinal.functions.vectors import as_points, attributes
from vicinal.operators import diagnostics
from vicinal.operators.index import ApproxKNN, equi_depth_cuts
from vicinal.operators.metrics import KnnResult
from vicinal.operators.search import exact_knn as exact
from vicinal.options import LshOptions
from vicinal.plans import oracles as sql
from vicinal.plans.classify import majority_vote
from vicinal.sources import read_knnbin, text, write_knnbin

K = 10
RP = LshOptions("random_projections", 32, 3, 4, 105_613, 1.0, seed=42)
RP_OVERSCAN = LshOptions("random_projections", 32, 3, 4, 105_613, 1.0, seed=42, overscan=10)
ENTROPY = LshOptions("entropy_based", 32, 2, 8, 105_613, num_cut_off_points=6, seed=42)
MIXED = LshOptions("mixed", 32, 4, 8, 105_613, 0.2, 16, seed=42)
SMALL = LshOptions("random_projections", 32, 3, 4, 101, 1.0, seed=42)
LINES = LshOptions("random_projections", 32, 6, 8, 105_613, 0.1, seed=42)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def fitted(spark: SparkSession, sf_dir: str, options: LshOptions, k: int = K) -> ApproxKNN:
    return ApproxKNN(options, k).fit(points(spark, sf_dir))


def data_set_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(points(spark, sf_dir)).select("total_size", "dims")


def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact(points(spark, sf_dir), K)


def hash_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", hash_combine_u32(F.col("o_orderkey"), F.col("o_custkey")).alias("mixed"))


def rp_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pool function's dot product with every point, computed with column functions."""
    from vicinal.functions.vectors import dot

    fns = draw_functions(RP, 64)
    pool = spark.createDataFrame([(f, fns.coeffs[f].tolist()) for f in sorted(set(fns.choice.ravel().tolist()))], "f int, a array<double>")
    return points(spark, sf_dir).crossJoin(F.broadcast(pool)).select("id", "f", dot(F.col("vec"), F.col("a")).alias("p"))  # 12 functions


def _buckets(options: LshOptions):
    return lambda spark, sf_dir: fitted(spark, sf_dir, options).index.buckets


def _cuts(options: LshOptions):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir)
        return equi_depth_cuts(p, draw_functions(options, 64), p.count())

    return query


def _knn(options: LshOptions):
    return lambda spark, sf_dir: fitted(spark, sf_dir, options).kneighbors().table


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, RP).index.bucket_counts()


def bucket_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, RP).index.bucket_offsets()


def bucket_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.bucket_size_histogram(fitted(spark, sf_dir, RP).index.bucket_counts())


def foreign_query_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point whose id is divisible by 100, searched among all points as a foreign query."""
    p = points(spark, sf_dir)
    queries = p.where("id % 100 = 0")
    return ApproxKNN(RP, 3).fit(p).kneighbors(queries, 3).table


def knn_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, RP).kneighbors().padded()


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, RP).candidate_counts()


def candidate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.candidate_totals(candidate_counts(spark, sf_dir))


def _result(spark: SparkSession, sf_dir: str) -> tuple[KnnResult, DataFrame]:
    return fitted(spark, sf_dir, RP).kneighbors(), exact_knn(spark, sf_dir)


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = _result(spark, sf_dir)
    return found.recall(truth).withColumn("recall", F.round("recall", 6))


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = _result(spark, sf_dir)
    return found.error_ratio(truth).withColumn("error_ratio", F.round("error_ratio", 6))


def minmax_scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.minmax_scaled(points(spark, sf_dir))


def debug_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.ramp(spark, 1000, 8)


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled (quantity, price, discount, tax) of all line items; ids are 60 bits of a hash of the unique key."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    ident = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    vec = F.array(*[F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return generate.minmax_scaled(lines.select(ident.alias("id"), vec.alias("vec")))


def lineitem_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item whose id is divisible by 100, searched among all."""
    p = line_points(spark, sf_dir)
    return ApproxKNN(LINES, K).fit(p).kneighbors(p.where("id % 100 = 0"), exclude_same_id=True).table


def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).persist()
    truth = exact(p, K).persist()
    trials = [RP, ENTROPY, MIXED, LshOptions("rp", 32, 2, 8, 105_613, 1.0)]
    return tuning.tune(p, truth, trials, K)


def shared_path(spark: SparkSession, suffix: str) -> str:
    """A new path in the shared folder; where spark.checkpoint.dir is unset, as in tests, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def mounted_path(spark: SparkSession, suffix: str) -> str:
    """Such a path for the binary format, whose files all nodes open in a file system that they mount."""
    path = shared_path(spark, suffix).removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points, written in the binary format and read again."""
    path = mounted_path(spark, ".bin")
    write_knnbin(points(spark, sf_dir), path)
    return read_knnbin(spark, path)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, ".csv")
    text.write_vector_csv(points(spark, sf_dir), path)
    return text.read_vector_csv(spark, path)


def arff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, ".arff")
    text.write_arff(points(spark, sf_dir), path)
    return text.read_arff(spark, path)


def libsvm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, ".libsvm")
    text.write_libsvm(points(spark, sf_dir), path)
    return text.read_libsvm(spark, path)


def ground_truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours' ids, saved as a binary matrix and read again."""
    p, path = points(spark, sf_dir), mounted_path(spark, ".truth")
    KnnResult(exact(p, K), p.select("id"), K, p.count()).save_indices(path)
    return read_knnbin(spark, path, "long").select(F.col("id").alias("query_id"), F.posexplode("vec").alias("rank", "neighbor_id")).withColumn("rank", F.col("rank") + 1)


def saved_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours' distances, saved and read again."""
    p, path = points(spark, sf_dir), mounted_path(spark, ".distances")
    KnnResult(exact(p, K), p.select("id"), K, p.count()).save_distances(path)
    rows = read_knnbin(spark, path, "double").select(F.col("id").alias("query_id"), F.posexplode("vec").alias("rank", "distance"))
    return rows.withColumn("rank", F.col("rank") + 1)


def _converted(kind: str):
    write = {"csv": text.write_vector_csv, "arff": text.write_arff, "libsvm": text.write_libsvm}[kind]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = shared_path(spark, f".{kind}"), mounted_path(spark, ".bin")
        write(points(spark, sf_dir), source)
        text.convert_to_knnbin(spark, source, target)
        return read_knnbin(spark, target)

    return query


def _diagnostic_csv(write, column: str, value: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = mounted_path(spark, ".txt")
        write(fitted(spark, sf_dir, SMALL), path)
        cells = F.split("value", ",").cast("array<bigint>")
        rows = spark.read.text(path).where("value NOT LIKE '#%'").select(cells.alias("c"))
        return rows.select(F.col("c")[0].cast("int").alias("hash_table"), F.posexplode(F.slice("c", 2, F.size("c"))).alias(column, value))

    return query


def candidate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.candidate_histogram(candidate_counts(spark, sf_dir))


def expected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.expected_pairs(fitted(spark, sf_dir, RP).index.bucket_counts())


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prime table sizes that the tuner chooses from."""
    return spark.createDataFrame([(p,) for p in tuning.primes(1000, 200_000)], "prime bigint")


def knn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each query, its padded neighbours joined in order."""
    return fitted(spark, sf_dir, RP).kneighbors().wide().select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


def mean_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.mean_bucket_sizes(fitted(spark, sf_dir, RP).index.bucket_counts())
    return out.withColumn("mean_size", F.round("mean_size", 6))


def hash_combine_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", hash_combine_u64(F.col("o_orderkey"), F.col("o_custkey")).alias("mixed"))


def gaussian_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated clouds, coordinate by coordinate."""
    return generate.blobs(spark, 1000, 3).select("id", "cluster", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 3))


def knn_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    return majority_vote(exact_knn(spark, sf_dir), labels)


QUERIES = {
    "data_set_attributes": data_set_attributes, "exact_knn": exact_knn, "hash_combine_u32": hash_combine,
    "rp_projection": rp_projection, "rp_bucket": _buckets(RP),
    "entropy_cutpoints": _cuts(ENTROPY), "entropy_bucket": _buckets(ENTROPY),
    "mixed_cutpoints": _cuts(MIXED), "mixed_bucket": _buckets(MIXED),
    "bucket_counts": bucket_counts, "bucket_offsets": bucket_offsets, "bucket_size_histogram": bucket_size_histogram,
    "rp_knn": _knn(RP), "entropy_knn": _knn(ENTROPY), "mixed_knn": _knn(MIXED), "rp_knn_overscan": _knn(RP_OVERSCAN),
    "foreign_query_knn": foreign_query_knn, "knn_padded": knn_padded,
    "candidate_counts": candidate_counts, "candidate_totals": candidate_totals, "recall": recall, "error_ratio": error_ratio,
    "minmax_scaled_vectors": minmax_scaled_vectors, "debug_ramp": debug_ramp, "lineitem_knn": lineitem_knn,
    "csv_roundtrip": csv_roundtrip, "arff_roundtrip": arff_roundtrip, "libsvm_roundtrip": libsvm_roundtrip, "ground_truth_files": ground_truth_files,
    "knn_wide": knn_wide, "mean_bucket_sizes": mean_bucket_sizes, "hash_combine_u64": hash_combine_64, "gaussian_blobs": gaussian_blobs,
    "saved_distances": saved_distances, "csv_to_binary": _converted("csv"), "arff_to_binary": _converted("arff"), "libsvm_to_binary": _converted("libsvm"),
    "bucket_csv": _diagnostic_csv(diagnostics.write_bucket_csv, "bucket", "n"), "candidate_csv": _diagnostic_csv(diagnostics.write_candidate_csv, "query", "candidates"),
    "candidate_histogram": candidate_histogram, "expected_pairs": expected_pairs, "table_sizes": table_sizes,
    "tune_grid": tune_grid, "binary_roundtrip": binary_roundtrip, "knn_majority_vote": knn_majority_vote,
}


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _oracles() -> dict[str, str]:
    rp, entropy, mixed = sql.buckets(RP), sql.buckets(ENTROPY), sql.buckets(MIXED)
    pts = f"pts AS ({sql.POINTS})"
    small = sql.buckets(SMALL)
    exact_cte = sql.neighbours(K, sql.ALL_PAIRS, "truth")
    columns = "SELECT query_id, rank, neighbor_id, distance FROM "
    bk = "SELECT hash_table::INT AS hash_table, bucket::BIGINT AS bucket, id FROM bk"
    knn = sql.neighbours(K, sql.SELF_PAIRS)
    counts = "cn AS (SELECT hash_table::INT AS hash_table, bucket, count(*) AS n FROM bk GROUP BY ALL)"
    offsets = f"{counts}, os AS (SELECT hash_table, bucket, n, (sum(n) OVER (PARTITION BY hash_table ORDER BY bucket) - n)::BIGINT AS \"offset\" FROM cn)"
    b = RP_OVERSCAN.overscan
    over = (
        f"{offsets}, nn AS (SELECT count(*) AS total FROM pts), "
        "pl AS (SELECT b.id, b.hash_table * total + \"offset\" + row_number() OVER (PARTITION BY b.hash_table, b.bucket ORDER BY b.id) - 1 AS pos FROM bk b JOIN os USING (hash_table, bucket), nn), "
        f"rg AS (SELECT hash_table, bucket, hash_table * total + \"offset\" AS a, hash_table * total + \"offset\" + ((n + {b - 1}) // {b}) * {b} AS e FROM os, nn), "
        "mb AS (SELECT hash_table, bucket, id FROM rg JOIN pl ON pos >= a AND pos < e)"
    )
    over_pairs = "SELECT DISTINCT x.id AS q, y.id AS c FROM bk x JOIN mb y USING (hash_table, bucket) WHERE x.id <> y.id"
    scaled = lambda src: (
        f"raw AS ({src}), un AS (SELECT id, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM raw), mm AS (SELECT d, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM un GROUP BY d), "
        "sc AS (SELECT id, list(CASE WHEN hi > lo THEN ((x::DOUBLE - lo) / (hi - lo))::FLOAT ELSE 0::FLOAT END ORDER BY d) AS vec FROM un JOIN mm USING (d) GROUP BY id)"
    )
    lines = (
        "SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT)), 1, 15))::BIGINT AS id, "
        "[l_quantity::FLOAT, l_extendedprice::FLOAT, l_discount::FLOAT, l_tax::FLOAT] AS vec FROM lineitem"
    )
    line_bk = sql.buckets(LINES, "SELECT * FROM sc", 4)
    line_pairs = "SELECT DISTINCT x.id AS q, y.id AS c FROM bk x JOIN bk y USING (hash_table, bucket) WHERE x.id <> y.id AND x.id % 100 = 0"
    foreign = "SELECT DISTINCT x.id AS q, y.id AS c FROM bk x JOIN bk y USING (hash_table, bucket) WHERE x.id % 100 = 0"
    padded = (
        "sl2 AS (SELECT id AS query_id, r::INT AS rank FROM pts, range(1, 11) t(r)) SELECT query_id, rank, coalesce(neighbor_id, query_id) AS neighbor_id, "
        f"coalesce(distance, {sql.NOT_FOUND}) AS distance FROM sl2 LEFT JOIN knn USING (query_id, rank)"
    )
    ratio = (
        "cnt AS (SELECT id AS query_id, count(neighbor_id) AS n FROM pts LEFT JOIN knn ON query_id = id GROUP BY id), "
        "ea AS (SELECT k.query_id, avg(CASE WHEN t.distance <> 0 THEN k.distance / t.distance WHEN k.distance = 0 THEN 1.0 END) AS r FROM knn k JOIN truth t USING (query_id, rank) GROUP BY k.query_id) "
        f"SELECT round(avg(CASE WHEN n >= {K} THEN r END), 6) AS error_ratio, (count(*) FILTER (WHERE n < {K}))::BIGINT AS points_incomplete, sum(greatest({K} - n, 0))::BIGINT AS neighbors_missing FROM cnt LEFT JOIN ea USING (query_id)"
    )
    return {
        "data_set_attributes": "SELECT count(*) AS total_size, max(len(embedding))::INT AS dims FROM embeddings",
        "exact_knn": _with(pts, exact_cte) + columns + "truth",
        "hash_combine_u32": f"SELECT o_orderkey, o_custkey, mixed FROM ({sql.combine_steps('orders', 'o_orderkey', 'o_custkey', 'mixed')})",
        "rp_projection": _with(sql.functions(RP), sql.projections(RP)) + "SELECT id, f::INT AS f, p FROM pr",
        "rp_bucket": _with(rp) + bk, "entropy_bucket": _with(entropy) + bk, "mixed_bucket": _with(mixed) + bk,
        "entropy_cutpoints": _with(entropy) + "SELECT fn::INT AS fn, cut_index, cut_value FROM cut",
        "mixed_cutpoints": _with(mixed) + "SELECT fn::INT AS fn, cut_index, cut_value FROM cut",
        "bucket_counts": _with(rp, counts) + "SELECT * FROM cn",
        "bucket_offsets": _with(rp, offsets) + "SELECT * FROM os",
        "bucket_size_histogram": _with(rp, counts) + "SELECT hash_table, n, count(*) AS buckets FROM cn GROUP BY ALL",
        "rp_knn": _with(rp, knn) + columns + "knn", "entropy_knn": _with(entropy, knn) + columns + "knn", "mixed_knn": _with(mixed, knn) + columns + "knn",
        "rp_knn_overscan": _with(rp, over, sql.neighbours(K, over_pairs)) + columns + "knn",
        "foreign_query_knn": _with(rp, sql.neighbours(3, foreign)) + columns + "knn",
        "knn_padded": _with(rp, knn, padded),
        "candidate_counts": _with(rp, sql.first_pairs()) + "SELECT hash_table::INT AS hash_table, query_id, count(*) AS candidates FROM fp GROUP BY ALL",
        "candidate_totals": _with(rp, sql.first_pairs()) + "SELECT query_id, count(*) AS candidates FROM fp GROUP BY ALL",
        "recall": _with(rp, knn, exact_cte) + f"SELECT round(count(*) * 100.0::DOUBLE / any_value(n), 6) AS recall, count(*) AS correct, any_value(n)::BIGINT AS total FROM (SELECT count(*) * {K} AS n FROM pts), knn SEMI JOIN truth USING (query_id, neighbor_id)",
        "error_ratio": _with(rp, knn, exact_cte, ratio),
        "minmax_scaled_vectors": _with(scaled(sql.POINTS)) + "SELECT id, vec FROM sc",
        "debug_ramp": "SELECT i AS id, list_transform(range(0, 8), lambda j: ((i * 8 + j) % 1000)::FLOAT) AS vec FROM range(0, 1000) t(i)",
        "lineitem_knn": _with(scaled(lines), line_bk, sql.neighbours(K, line_pairs)) + columns + "knn",
        "binary_roundtrip": sql.POINTS, "csv_roundtrip": sql.POINTS, "arff_roundtrip": sql.POINTS, "libsvm_roundtrip": sql.POINTS,
        "csv_to_binary": sql.POINTS, "arff_to_binary": sql.POINTS, "libsvm_to_binary": sql.POINTS,
        "saved_distances": _with(pts, exact_cte) + "SELECT query_id, rank, distance FROM truth",
        "bucket_csv": _with(small, f"cells AS (SELECT t AS hash_table, b AS bucket FROM range(0, {SMALL.num_hash_tables}) x(t), range(0, {SMALL.buckets}) y(b))") + "SELECT hash_table::INT AS hash_table, bucket::INT AS bucket, count(id) AS n FROM cells LEFT JOIN bk USING (hash_table, bucket) GROUP BY ALL",
        "candidate_csv": _with(small, sql.first_pairs(), f"cells AS (SELECT t AS hash_table, id AS query_id FROM range(0, {SMALL.num_hash_tables}) x(t), pts)") + "SELECT hash_table::INT AS hash_table, (row_number() OVER (PARTITION BY hash_table ORDER BY query_id) - 1)::INT AS query, candidates FROM (SELECT c.hash_table, c.query_id, count(fp.query_id) AS candidates FROM cells c LEFT JOIN fp USING (hash_table, query_id) GROUP BY ALL)",
        "candidate_histogram": _with(rp, sql.first_pairs()) + "SELECT hash_table, candidates, count(*) AS queries FROM (SELECT hash_table::INT AS hash_table, query_id, count(*) AS candidates FROM fp GROUP BY ALL) GROUP BY ALL",
        "expected_pairs": _with(rp, counts) + "SELECT sum(n * (n - 1))::BIGINT AS pairs FROM cn",
        "table_sizes": "SELECT n AS prime FROM range(1000, 200001) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 448) d(i) WHERE n % i = 0 AND i < n)",
        "ground_truth_files": _with(pts, exact_cte) + "SELECT query_id, rank, neighbor_id FROM truth",
        "knn_wide": _with(rp, knn, padded.partition(" SELECT ")[0]) + "SELECT query_id, string_agg(coalesce(neighbor_id, query_id)::VARCHAR, ',' ORDER BY rank) AS neighbors FROM sl2 LEFT JOIN knn USING (query_id, rank) GROUP BY query_id",
        "mean_bucket_sizes": _with(rp, counts) + "SELECT hash_table, count(*) AS used_buckets, round(avg(n), 6) AS mean_size, max(n) AS largest FROM cn GROUP BY hash_table",
        "hash_combine_u64": sql.combine_u64("orders", "o_orderkey", "o_custkey"),
        "gaussian_blobs": sql.blobs(generate.centres(3).tolist(), 1000),
        "knn_majority_vote": _with(pts, exact_cte) + "SELECT query_id, label, votes FROM (SELECT query_id, label, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS place FROM truth JOIN embeddings ON vec_id = neighbor_id WHERE label IS NOT NULL GROUP BY query_id, label) WHERE place = 1",
    }


ORACLES = _oracles()
