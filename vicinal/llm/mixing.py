"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log k! for k = 0..99; a chunk's mean is 16 at most, so later terms are below 1e-40.
LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(100)]
CHUNK_MEAN = 16.0
#: Up to so many sources the table of rates is broadcast; beyond, it is joined on salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64
SCALE = float(2**52)


def unit_hash(*parts) -> F.Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(SCALE)


def source_rates(docs: DataFrame, source: str = "source", alpha: float = 0.5, weights: dict | None = None, total: float = 1.0) -> DataFrame:
    """Mean repetitions of each source's documents: rows (source, n_docs, rate, n_chunks, cdf).

    The target share of a source is its weight in `weights`, or else its
    number of documents to the power alpha, over the sum of all; the rate
    brings the expected size of the mix to `total` times the input.  A source
    without a weight has none; weights that fit no source leave nothing.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        given = F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast("double")
        counts = counts.withColumn("w", F.coalesce(given, F.lit(0.0)))
    sums = counts.agg(F.sum("w").alias("all_w"), F.sum("n_docs").alias("all_n"))
    logs = F.array(*[F.lit(x) for x in LOG_FACTORIALS])
    lam = F.col("rate") / F.col("n_chunks")
    pmf = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.exp(k * F.ln(lam) - lam - F.element_at(logs, k + 1)))
    return (
        counts.crossJoin(F.broadcast(sums))  # one row
        .where("all_w > 0")
        .withColumn("rate", F.round(F.col("w") / F.col("all_w") * F.col("all_n") * F.lit(float(total)) / F.col("n_docs"), 9))
        .where("rate > 0")
        .withColumn("n_chunks", F.ceil(F.col("rate") / F.lit(CHUNK_MEAN)).cast("int"))
        .withColumn("pmf", pmf)
        .withColumn("cdf", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.aggregate(F.slice("pmf", 1, k), F.lit(0.0), lambda a, x: a + x)))
        .select("source", "n_docs", "rate", "n_chunks", "cdf")
    )


def poisson_mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", alpha: float = 0.5, weights: dict | None = None, total: float = 1.0, seed: int = 17) -> DataFrame:
    """Replicates every document a Poisson number of times and shuffles the copies globally.

    A source's rate is cut into chunks of mean 16 at most; for each chunk a
    hash of (seed, id, text, chunk) is inverted through the Poisson
    distribution, and the counts are added, which is exact for any rate.
    Copies are dealt by a hash of (document, copy) and sorted by it inside
    each partition: a uniform random order over all partitions.

    Returns the input's columns, then copy_no (1..n_copies), n_copies, rate
    and shuffle_key.  A null source is a source of its own; null ids and
    texts hash as empty; equal rows (same id and text) draw equal counts and
    the same places in the order, so they lie side by side; input columns with
    the names of the added ones are dropped; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    added = ["copy_no", "n_copies", "rate", "shuffle_key"]
    keep = [c for c in docs.columns if c not in added]
    rates = source_rates(docs, source, alpha, weights, total).select(F.col("source").alias("__src"), "rate", "n_chunks", "cdf")
    schema = rates.schema
    rows = rates.limit(BROADCAST_SOURCES + 1).collect()
    base = docs.select(*keep).withColumn("__id", F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))))
    if len(rows) <= BROADCAST_SOURCES:
        joined = base.join(F.broadcast(spark.createDataFrame(rows, schema)), F.col(source).eqNullSafe(F.col("__src")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("__s", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(
            salted, F.col(source).eqNullSafe(F.col("__src")) & (F.col("__s") == F.col("__salt"))
        )
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("n_chunks")), F.lit(0),
        lambda acc, j: acc + F.size(F.filter("cdf", lambda c: c <= unit_hash(seed, F.col("__id"), j.cast("string")))),
    )
    return (
        joined.withColumn("n_copies", drawn).where("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.col("__id"), F.col("copy_no").cast("string"))), 1, 13), 16, 10).cast("bigint"))
        .select(*keep, *added)
        .repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    )


def oracle(columns: str = "doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5", alpha: float = 0.5, seed: int = 17) -> str:
    """The same mix of `documents` as DuckDB SQL."""
    logs = "[" + ", ".join(f"{x!r}::DOUBLE" for x in LOG_FACTORIALS) + "]"
    return f"""
WITH c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {alpha!r}) AS w FROM documents GROUP BY source),
s AS (SELECT sum(w) AS all_w, sum(n) AS all_n FROM c),
r AS (SELECT source, round(w / all_w * all_n / n, 9) AS rate FROM c, s),
m AS (SELECT source, rate, ceil(rate / 16.0::DOUBLE)::INT AS k, rate / ceil(rate / 16.0::DOUBLE) AS lam FROM r),
p AS (SELECT m.*, i, exp(i * ln(lam) - lam - {logs}[(i + 1)::INT]) AS pm FROM m, range(0, 100) t(i)),
q AS (SELECT source, i, sum(pm) OVER (PARTITION BY source ORDER BY i) AS cum FROM p),
cdf AS (SELECT source, list(cum ORDER BY i) AS cdf FROM q GROUP BY source),
d AS (SELECT d.*, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS id FROM documents d),
u AS (SELECT d.*, m.rate, j, cdf.cdf,
        ('0x' || substr(md5('{seed}|' || id || '|' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source, LATERAL (SELECT unnest(range(1, m.k + 1)) AS j)),
n AS (SELECT doc_id, lang, source, n_chars, text, id, rate, sum(len(list_filter(cdf, lambda x: x <= u)))::INT AS n_copies
      FROM u GROUP BY ALL)
SELECT {columns}, copy_no::INT AS copy_no, n_copies, rate,
  ('0x' || substr(md5('{seed}s|' || id || '|' || copy_no::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy_no)
"""
