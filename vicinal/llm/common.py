"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker turns into Python objects at once; Spark bounds its Arrow batches by bytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of the data folder through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that few texts are Python objects at a time; no setting of the session is touched."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vicinal-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Fewer rows in the Arrow batches of the actions inside; the session's own setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a reader of it.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    A reader of such a table is returned as it is.
    """
    if getattr(df, "_vicinal_path", None):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vicinal_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_vicinal_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: rows (id, component), component the smallest id.

    Alternates large-star and small-star steps; every step is a grouped
    minimum and a join, and the edges between steps are written to the
    shared folder.  Vertices without an edge do not appear.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )
    sums = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first())
    prev, last = None, sums(cur)
    for _ in range(max_rounds):
        # large star: every larger neighbour is linked to the smallest neighbour
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour is linked to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        new = materialize(small, "cc")
        if prev is not None:
            discard(prev)
        prev, cur, before, last = cur, new, last, sums(new)
        if before == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(cur.select(F.col("v"), F.col("v")).distinct())


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of all white-space separated words of a batch of texts, without a Python loop.

    Texts are joined in UTF-8 with A-Z lower-cased.  A word's hash is a
    polynomial over substituted bytes, read off prefix sums modulo 2**64 and
    scrambled together with the word's length.
    """

    def __init__(self, seed: int = 20240607, symbols: int = 256):
        rng = np.random.default_rng(seed)
        self.sub = rng.integers(1, 2**63, symbols, dtype=np.uint64)
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.pw = self.inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pw) < n:
            n = max(n, 1 << 18)
            for name, b in (("pw", self.base), ("inv", pow(self.base, -1, 2**64))):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Returns (bytes, starts, ends, doc) of all words in order; doc is the index of the text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = self.low[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        sp = self.space[buf]
        change = np.flatnonzero(sp[1:] != sp[:-1]) + 1
        if len(sp) and not sp[0]:
            change = np.concatenate([[0], change])
        starts, ends = change[0::2], change[1::2]
        bounds = np.cumsum([len(r) + 1 for r in raw])
        return buf, starts, ends, np.searchsorted(bounds, starts, side="right")

    def hashes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches of buf, whose values are bytes or other symbols."""
        self._grow(len(buf) + 1)
        pre = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.sub[buf] * self.pw[: len(buf)], out=pre[1:])
        h = (pre[ends] - pre[starts]) * self.inv[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def chunks_by_bytes(texts: list, limit: int = 1 << 20):
    """Yields (first, last) index ranges whose texts hold about limit characters, one text at least."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= limit:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
