import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import generate, sources
from vicinal.errors import FileFormatError, InvalidOptionError, NotFittedError, VectorError, VicinalError
from vicinal.functions import hashing
from vicinal.operators.index import ApproxKNN, equi_depth_cuts
from vicinal.operators.metrics import NOT_FOUND, KnnResult, error_ratio, recall
from vicinal.operators.search import exact_knn
from vicinal.options import HashFamily, LshOptions, Profiling
from vicinal.profiling import Profiler

MIXES = [(0, 0, 1684164658), (12, 0, 419258560), (12, 1, 3560017290), (2, 4294967295, 1580013426), (4294967295, 4294967295, 3474236918)]
LINE = [(0, [0.0, 0.1]), (1, [0.2, 0.3]), (2, [0.4, 0.5]), (3, [0.6, 0.7])]


def points(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


def test_hash_combine(spark):
    df = spark.createDataFrame([m[:2] for m in MIXES], "a bigint, b bigint")
    got = [r[0] for r in df.coalesce(1).select(hashing.hash_combine_u32(F.col("a"), F.col("b"))).collect()]
    assert got == [m[2] for m in MIXES]
    a, b = np.array([m[0] for m in MIXES]), np.array([m[1] for m in MIXES])
    assert hashing.combine_u32(a, b).tolist() == got
    h = np.array([3])
    for v in range(3):
        h = hashing.combine_u32(h, np.array([v]))
    assert h[0] == 899978539 and h[0] % 105613 == 50166


def mix64_by_hand(seed, value):
    m = 2**64 - 1
    x = (seed + 0x9E3779B97F4A7C15 + value) & m
    x = ((x ^ (x >> 32)) * 0x0E9846AF9B1A615D) & m
    x = ((x ^ (x >> 32)) * 0x0E9846AF9B1A615D) & m
    return x ^ (x >> 28)


def test_hash_combine_u64(spark):
    pairs = [(5, 7), (0, 0), (2**63 - 1, 1), (-1, -1), (12, -5)]
    want = [mix64_by_hand(a % 2**64, b % 2**64) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").coalesce(1)
    assert [r[0] % 2**64 for r in df.select(hashing.hash_combine_u64(F.col("a"), F.col("b"))).collect()] == want


def test_cut_ranks():
    e, m = LshOptions("entropy", num_cut_off_points=4), LshOptions("mixed", num_cut_off_points=4)
    assert hashing.cut_ranks(10, e) == [2, 4, 6] and hashing.cut_ranks(10, m) == [3, 6, 8]
    assert hashing.cut_ranks(3, e) == [0, 0, 0]


@pytest.mark.parametrize("family", ["entropy", "mixed"])
def test_cut_points_equal_a_sort(spark, family):
    o = LshOptions(family, 4, 2, 3, 100, 0.3, 5)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((57, 3)), 1).astype(np.float32)
    fns = hashing.draw_functions(o, 3)
    rows = equi_depth_cuts(points(spark, [(i, v.tolist()) for i, v in enumerate(x)]), fns, len(x)).collect()
    want = np.sort(hashing.cut_values(x.astype(float), fns), 0)
    assert {(r["fn"], r["cut_index"]): r["cut_value"] for r in rows} == {(f, i): want[k, f] for f in range(want.shape[1]) for i, k in enumerate(hashing.cut_ranks(57, o))}


@pytest.mark.parametrize("draw", [lambda r, n: np.append(r.standard_normal(n - 1) * 1e-9, 1e9), lambda r, n: np.zeros(n), lambda r, n: np.repeat([1.0, 2.0], n // 2)])
def test_cut_points_of_skewed_values(spark, draw):
    o = LshOptions("entropy", 2, 1, 2, 100, 1.0, 7)
    x = draw(np.random.default_rng(4), 4000).astype(np.float32)[:, None]
    fns = hashing.draw_functions(o, 1)
    rows = equi_depth_cuts(points(spark, [(i, v.tolist()) for i, v in enumerate(x)]), fns, len(x)).collect()
    want = np.sort(hashing.cut_values(x.astype(float), fns), 0)
    assert {(r["fn"], r["cut_index"]): r["cut_value"] for r in rows} == {(f, i): want[k, f] for f in range(want.shape[1]) for i, k in enumerate(hashing.cut_ranks(len(x), o))}


def test_exact_line(spark):
    got = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in exact_knn(points(spark, LINE), 3).collect()}
    assert got[0, 1][0] == 1 and got[0, 3][0] == 3 and got[3, 1][0] == 2
    assert math.isclose(got[0, 1][1], math.sqrt(0.08), rel_tol=1e-6)


def test_one_bucket_equals_exact_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(1)
    p = points(spark, [(i, v.tolist()) for i, v in enumerate(rng.integers(0, 4, (90, 3)).astype(float))])  # many ties and duplicates
    truth = sorted(map(tuple, exact_knn(p, 5).collect()))
    assert sorted(map(tuple, exact_knn(p, 5, block_rows=16).collect())) == truth
    assert sorted(map(tuple, exact_knn(p.repartition(7), 5, block_rows=7).collect())) == truth
    one = ApproxKNN(LshOptions("rp", 1, 1, 1, 1), 5).fit(p).kneighbors()
    assert sorted(map(tuple, one.table.collect())) == truth
    assert one.recall(exact_knn(p, 5)).first()[0] == 100.0


def test_ramp(spark):
    rows = [r.vec for r in generate.ramp(spark, 6, 2).orderBy("id").collect()]
    assert rows == [[0, 1], [2, 3], [4, 5], [0, 1], [2, 3], [4, 5]]


def test_more_tables_never_lose_candidates(spark):
    p = generate.blobs(spark, 200, 4, seed=5).select("id", "vec")
    few, many = (ApproxKNN(LshOptions("rp", 16, 3, t, 1009, 2.0), 3).fit(p).candidate_counts().agg(F.sum("candidates")).first()[0] for t in (2, 4))
    assert 0 < few <= many


def test_error_ratio_and_recall(spark):
    name = "query_id bigint, rank int, neighbor_id bigint, distance double"
    make = lambda d: spark.createDataFrame([(q, i + 1, 100 + i, x) for q, xs in d.items() for i, x in enumerate(xs)], name)
    found = make({0: [1.0, 2.0], 1: [2.0, 2.0], 2: [0.0, 1.0], 3: [1.0, 1.0], 4: [1.0]})
    truth = make({0: [1.0, 2.0], 1: [1.0, 2.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [1.0, 2.0]})
    r = error_ratio(found, truth, spark.range(5), 2).first()
    assert math.isclose(r["error_ratio"], 1.125) and (r["points_incomplete"], r["neighbors_missing"]) == (1, 1)
    rows = lambda x: spark.createDataFrame([(q, i + 1, n, 1.0) for q, i, n in x], name)
    r = recall(rows([(0, 0, 1), (0, 1, 2), (1, 0, 0)]), rows([(0, 0, 1), (0, 1, 3), (1, 0, 0), (1, 1, 2)]), 2, 2).first()
    assert (r["recall"], r["correct"], r["total"]) == (50.0, 2, 4)


def test_padding_and_views(spark):
    p = points(spark, [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [900.0, 900.0])])
    res = ApproxKNN(LshOptions("rp", 4, 3, 1, 105_613, 0.5), 2).fit(p).kneighbors()
    rows = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in res.padded().collect()}
    assert len(rows) == 6 and rows[0, 1] == (1, 0.0) and rows[2, 2] == (2, NOT_FOUND)
    assert {r.query_id: r.neighbors for r in res.wide().collect()}[2] == [2, 2]
    assert [r.neighbor_id for r in res.of(0).collect()] == [1]
    bare = ApproxKNN(LshOptions(), 1).fit(p).kneighbors(return_distance=False)
    assert "distance" not in bare.table.columns
    with pytest.raises(VicinalError):
        bare.error_ratio(res.table)


@pytest.mark.parametrize("rows", [[], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(0, None)], [(0, [])], [(0, [None])]])
def test_bad_points(spark, rows):
    with pytest.raises(VectorError):
        ApproxKNN().fit(points(spark, rows))


def test_bad_options(spark):
    for name in ("hash_pool_size", "num_hash_functions", "num_hash_tables", "hash_table_size", "w", "num_cut_off_points"):
        with pytest.raises(InvalidOptionError):
            LshOptions(**{name: 0})
    with pytest.raises(InvalidOptionError):
        ApproxKNN(k=0)
    with pytest.raises(NotFittedError):
        ApproxKNN().kneighbors()
    knn = ApproxKNN(LshOptions("rp", 2, 1, 1, 10)).fit(points(spark, LINE))
    for k in (0, 5):
        with pytest.raises(InvalidOptionError):
            knn.kneighbors(k=k)
    with pytest.raises(VectorError):
        knn.kneighbors(points(spark, [(9, [1.0])]), 1)
    with pytest.raises(InvalidOptionError):
        ApproxKNN(LshOptions("mixed", num_cut_off_points=9)).fit(points(spark, LINE))


def test_names():
    assert HashFamily.parse("Entropy-Based") is HashFamily.parse("1") is HashFamily.parse("entropy") is HashFamily.ENTROPY_BASED
    assert LshOptions("mixed", num_cut_off_points=6).buckets == 6
    assert "w:" not in LshOptions("entropy").describe() and "cut_off" not in LshOptions().describe()


def test_binary_files(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    sources.write_knnbin(points(spark, LINE).repartition(3), path)
    with open(path, "rb") as f:
        assert struct.unpack("<QQQ", f.read(24)) == (4, 4, 2)
    got = sources.read_knnbin(spark, path).orderBy("id").collect()
    assert [(r.id, r.vec) for r in got] == [(r.id, r.vec) for r in points(spark, LINE).orderBy("id").collect()]
    with pytest.raises(Exception, match="bytes"):
        sources.read_knnbin(spark, path, "double").count()
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(FileFormatError):
        sources.knnbin.header(path, "float")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2\n3\n1,2,3\n4,5,6\n")
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute x numeric\n@DATA\n1, 2\n% c\n3,4\n")
    (tmp_path / "a.libsvm").write_text("1 1:5 3:7\n-1 2:2.5\n")
    vecs = lambda df: [r.vec for r in df.orderBy("id").collect()]
    assert vecs(sources.read_vector_csv(spark, str(tmp_path / "a.csv"))) == [[1, 2, 3], [4, 5, 6]]
    assert vecs(sources.read_arff(spark, str(tmp_path / "a.arff"))) == [[1, 2], [3, 4]]
    assert vecs(sources.read_libsvm(spark, str(tmp_path / "a.libsvm"))) == [[5, 0, 7], [0, 2.5, 0]]


def test_profile(tmp_path):
    p = Profiler(Profiling.RUNTIMES)
    with p.timed("fit", "total_runtime"):
        p.add("fit", "dims", 3)
    p.dump(str(tmp_path / "p.yaml"))
    text = (tmp_path / "p.yaml").read_text()
    assert text.startswith("---\n") and "fit:\n  dims: 3\n" in text
    Profiler().dump(str(tmp_path / "q.yaml"))
    assert not (tmp_path / "q.yaml").exists()


def test_stream(spark, tmp_path):
    from vicinal.streaming import answer_stream

    knn = ApproxKNN(LshOptions("rp", 1, 1, 1, 1), 1).fit(points(spark, LINE))
    points(spark, [(100, [0.0, 0.0])]).write.parquet(str(tmp_path / "in"))
    got = []
    q = answer_stream(knn, spark.readStream.schema("id bigint, vec array<float>").parquet(str(tmp_path / "in")), lambda df, n: got.extend(df.collect()))
    q.processAllAvailable()
    q.stop()
    assert [(r.query_id, r.neighbor_id) for r in got] == [(100, 0)]


def test_truth_of_another_shape_is_refused(spark):
    p = generate.blobs(spark, 40, 3).select("id", "vec")
    res = ApproxKNN(LshOptions("rp", 4, 2, 2, 1009, 2.0), 3).fit(p).kneighbors()
    for bad in (exact_knn(p, 2), exact_knn(p, 3).where("query_id <> 7")):
        for check in (res.recall, res.error_ratio):
            with pytest.raises(Exception, match="the truth must have"):
                check(bad).collect()
    assert res.recall(exact_knn(p, 3)).first()["total"] == 120
    with pytest.raises(InvalidOptionError):
        res.of(40)


def test_saved_results(spark, tmp_path):
    p = generate.blobs(spark, 50, 3).select((F.col("id") * 7 + 3).alias("id"), "vec")
    res = ApproxKNN(LshOptions("rp", 4, 2, 2, 1009, 2.0), 3).fit(p).kneighbors()
    res.save_indices(str(tmp_path / "i"))
    res.save_distances(str(tmp_path / "d"))
    wide = {r.query_id: r for r in res.wide().collect()}
    order = sorted(wide)
    got = sources.read_knnbin(spark, str(tmp_path / "i"), "long").orderBy("id").collect()
    assert [r.vec for r in got] == [wide[q].neighbors for q in order] and [r.id for r in got] == list(range(50))
    assert [r.vec for r in sources.read_knnbin(spark, str(tmp_path / "d"), "double").orderBy("id").collect()] == [wide[q].distances for q in order]
    with pytest.raises(VicinalError):
        ApproxKNN(LshOptions(), 1).fit(p).kneighbors(return_distance=False).save_distances(str(tmp_path / "x"))


def test_binary_writer_refuses_uneven_rows(spark, tmp_path):
    with pytest.raises(Exception, match="different lengths"):
        sources.write_knnbin(points(spark, [(0, [1.0]), (1, [1.0, 2.0])]), str(tmp_path / "u"))
    assert not list(tmp_path.iterdir())
    sources.write_knnbin(points(spark, []), str(tmp_path / "empty"))
    assert sources.knnbin.header(str(tmp_path / "empty"), "float") == (0, 0)


@pytest.mark.parametrize("kind", ["csv", "arff", "libsvm"])
def test_text_round_trips_and_conversion(spark, tmp_path, kind):
    p = points(spark, [(i, [float(i % 3), 0.1 * i, -2.5]) for i in range(60)]).repartition(4)
    path = str(tmp_path / f"v.{kind}")
    {"csv": sources.write_vector_csv, "arff": sources.write_arff, "libsvm": sources.write_libsvm}[kind](p, path)
    want = [(r.id, r.vec) for r in p.orderBy("id").collect()]
    read = {"csv": sources.read_vector_csv, "arff": sources.read_arff, "libsvm": sources.read_libsvm}[kind]
    assert [(r.id, r.vec) for r in read(spark, path).orderBy("id").collect()] == want
    sources.convert_to_knnbin(spark, path, str(tmp_path / "v.bin"))
    assert [(r.id, r.vec) for r in sources.read_knnbin(spark, str(tmp_path / "v.bin")).orderBy("id").collect()] == want
    with pytest.raises(FileFormatError):
        sources.convert_to_knnbin(spark, "v.txt", "x")


def test_blobs_are_normal_clouds(spark):
    x = generate.blobs(spark, 3000, 2, std=0.5).toPandas()
    v = np.array(x.vec.tolist()) - generate.centres(2)[x.cluster]
    assert abs(v.mean()) < 0.03 and abs(v.std() - 0.5) < 0.02
    again = generate.blobs(spark, 3000, 2, std=0.5).repartition(5).orderBy("id").toPandas()
    assert again.vec.tolist() == x.sort_values("id").vec.tolist()


def test_diagnostics_files(spark, tmp_path):
    from vicinal.operators import diagnostics

    p = generate.blobs(spark, 30, 2).select("id", "vec")
    knn = ApproxKNN(LshOptions("rp", 4, 2, 3, 11, 2.0), 2).fit(p)
    diagnostics.write_bucket_csv(knn, str(tmp_path / "b"))
    diagnostics.write_candidate_csv(knn, str(tmp_path / "c"))
    for name, width, total in (("b", 11, 30), ("c", 30, None)):
        lines = (tmp_path / name).read_text().splitlines()
        rows = [[int(v) for v in line.split(",")] for line in lines if not line.startswith("#")]
        assert "# num_data_points: 30" in lines and [r[0] for r in rows] == [0, 1, 2] and all(len(r) == width + 1 for r in rows)
        assert total is None or all(sum(r[1:]) == total for r in rows)
    made = {(r.hash_table, r.query_id): r.candidates for r in knn.candidate_counts().collect()}
    assert all(rows[t][1 + q] == made.get((t, q), 0) for t in range(3) for q in range(30))
    sizes = {r.hash_table: r for r in diagnostics.mean_bucket_sizes(knn.index.bucket_counts()).collect()}
    assert all(math.isclose(r.mean_size * r.used_buckets, 30) for r in sizes.values())
    assert sum(r.queries for r in diagnostics.candidate_histogram(knn.candidate_counts()).collect()) == len(made)


def test_tuner(spark, tmp_path):
    from vicinal import tuning

    assert tuning.primes(10, 30) == [11, 13, 17, 19, 23, 29]
    rng, best = np.random.default_rng(1), lambda x: -((x - 0.3) ** 2).sum()
    tried, scores = np.zeros((0, 3)), np.zeros(0)
    for _ in range(60):
        x = tuning.suggest(tried, scores, rng, 3)
        tried, scores = np.concatenate([tried, x[None]]), np.append(scores, best(x))
    assert scores[30:].mean() > scores[:8].mean() and scores.max() > -0.02
    p = generate.blobs(spark, 40, 2).select("id", "vec").persist()
    out = tuning.tune(p, exact_knn(p, 2).persist(), [LshOptions("rp", 4, 2, t, 101, 2.0) for t in (1, 2, 4)], 2, top=2).collect()
    assert len(out) == 2 and out[0].recall >= out[1].recall and out[0].runtime > 0
    space = tuning.Space("mixed", 1 << 20)
    assert space.options(np.zeros(6)).num_cut_off_points == 256 and space.options(np.full(6, 0.999999)).hash_pool_size == 4096


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from vicinal import __main__ as cli

    p = generate.blobs(spark, 40, 3).select("id", "vec")
    path = lambda n: str(tmp_path / n)
    sources.write_knnbin(p, path("v.bin"))
    truth = exact_knn(p, 3)
    from vicinal.operators.metrics import KnnResult

    whole = KnnResult(truth, p.select("id"), 3, 40)
    whole.save_indices(path("ti"))
    whole.save_distances(path("td"))
    args = [path("v.bin"), "3", "--hash_table_size", "1", "--num_hash_tables", "1", "--indices_save_file", path("i"), "--distances_save_file", path("d")]
    args += ["--indices_ground_truth_file", path("ti"), "--distances_ground_truth_file", path("td"), "--profiling_type", "runtimes", "--profiling_file", path("p.yaml")]
    assert cli.main(args) == 0
    out = capsys.readouterr().out
    assert "recall: 100.0000 % (120/120)" in out and "error ratio: 1.0" in out
    assert (tmp_path / "i").read_bytes() == (tmp_path / "ti").read_bytes()
    assert "indices_save_file" in (tmp_path / "p.yaml").read_text()
    for bad in ([path("v.bin"), "0"], [path("v.bin"), "3", "--hash_function", "nonsense"], [path("v.bin"), "3", "--w", "0"]):
        assert cli.main(bad) == 1 and "vicinal: " in capsys.readouterr().err


def test_majority_vote(spark):
    from vicinal.plans.classify import majority_vote

    knn = spark.createDataFrame([(0, 1, 10, 1.0), (0, 2, 11, 2.0), (0, 3, 12, 3.0), (1, 1, 12, 1.0), (1, 2, 10, 1.0)], "query_id bigint, rank int, neighbor_id bigint, distance double")
    labels = spark.createDataFrame([(10, 5), (11, 5), (12, 4)], "id bigint, label int")
    assert {r.query_id: (r.label, r.votes) for r in majority_vote(knn, labels).collect()} == {0: (5, 2), 1: (4, 1)}


def shuffled(spark, df):
    """Bytes that running df writes for shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = total()
    rows = df().count()
    return total() - before, rows


@pytest.mark.parametrize("kind", ["exact", "one bucket", "saved"])
def test_shuffle_grows_as_the_points_do(spark, tmp_path, kind):
    def run(n):
        p = points(spark, spark.sparkContext.parallelize([(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(5).standard_normal((n, 4)))], 4)).persist()
        if kind == "exact":
            return exact_knn(p, 3)
        if kind == "one bucket":
            return ApproxKNN(LshOptions("rp", 1, 1, 2, 1), 3).fit(p).kneighbors().table
        KnnResult(exact_knn(p, 3), p.select("id"), 3, n).save_indices(str(tmp_path / f"{n}"))
        return p

    (small, _), (large, rows) = shuffled(spark, lambda: run(2500)), shuffled(spark, lambda: run(10_000))
    assert rows == (10_000 if kind == "saved" else 30_000) and large < 5.5 * small


def test_shuffle_does_not_grow_with_the_tables(spark):
    p = generate.blobs(spark, 4000, 4).select("id", "vec").persist()
    few, many = (shuffled(spark, lambda t=t: ApproxKNN(LshOptions("rp", 8, 2, t, 1009, 2.0), 3).fit(p).kneighbors(p.where("id % 2 = 0"), exclude_same_id=True).table)[0] for t in (1, 8))
    assert many < 2.5 * few


@pytest.mark.parametrize("tables", [3, 7])
def test_candidates_by_hand_and_without_vectors(spark, tables):
    p = generate.blobs(spark, 300, 3).select("id", "vec")
    knn = ApproxKNN(LshOptions("rp", 8, 2, tables, 97, 1.0), 3).fit(p)
    signs = {r.id: r.sig for r in knn.index.points.collect()}
    for queries, ids in ((None, list(signs)), (p.where("id % 7 = 0"), [i for i in signs if i % 7 == 0])):
        want = {}
        for q in ids:
            for c in signs:
                first = next((t for t in range(tables) if signs[q][t] == signs[c][t]), None)
                if first is not None and (queries is not None or q != c):
                    want[first, q] = want.get((first, q), 0) + 1
        rows = knn.candidate_counts(queries).collect()
        assert {(r.hash_table, r.query_id): r.candidates for r in rows} == want and len(rows) == len(want)


def test_many_equal_points_and_few_queries(spark):
    x = np.repeat(np.arange(12.0), 40)[:, None] * [1.0, 0.5]
    p = points(spark, [(i * 3, v.tolist()) for i, v in enumerate(x)])
    got = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in exact_knn(p, 45, block_rows=50).collect()}
    for q in (0, 3 * 200, 3 * 479):
        d = ((x - x[q // 3]) ** 2).sum(1)
        order = [i for i in np.lexsort((np.arange(480), d)) if i * 3 != q][:45]
        assert [got[q, r + 1] for r in range(45)] == [(i * 3, math.sqrt(d[i])) for i in order]
    knn = ApproxKNN(LshOptions("rp", 4, 2, 5, 1009, 0.5), 4).fit(p)
    every = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in knn.kneighbors().table.collect()}
    few = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in knn.kneighbors(p.where("id % 60 = 0"), exclude_same_id=True).table.collect()}
    assert few and few == {k: v for k, v in every.items() if k[0] % 60 == 0}
