"""Quality classifier by compression with zstandard dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import crc_mod, small_batches

CHUNK = 512  # bytes compressed at once, so that the dictionary, not the text's own past, decides
DICT_BYTES = 112_640
LEVEL = 3


@dataclass
class CompressionModel:
    """Dictionaries of bad and good text, and the calibration of the difference."""

    dictionaries: tuple[bytes, bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def pieces(text: str | None) -> list[bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    return [b[i : i + CHUNK] for i in range(0, len(b), CHUNK)] or [b""]


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


FEATURES = 3


def features(text: str | None, both: list[zstandard.ZstdCompressor]) -> list[float]:
    """A bias, the normalised difference of the compressed sizes over the whole text, and the log length that it is judged at."""
    ps = pieces(text)
    bad, good = (sum(len(c.compress(p)) for p in ps) for c in both)
    return [1.0, (bad - good) / (bad + good), float(np.log(sum(map(len, ps)) + 1))]


def fit(docs: DataFrame, labels: DataFrame, holdout: int = 5, per_class: int = 2000, longest: int = 50_000, total_chars: int = 24_000_000, seed: int = 3) -> CompressionModel:
    """Learns from a bounded sample of labelled rows outside the held-out fold.

    The sample: of each label the `per_class` documents first in a hash order,
    those with more than `longest` characters left out, `total_chars`
    characters in all.  Half the texts of each label make the dictionaries;
    the others calibrate the score by ridge logistic regression.  Without
    documents of both labels the model scores 0.5 throughout.

    Ids may be of any type.  Ids that are null, or that have both labels, are
    left out; a label given twice counts once; of rows with one id the first
    text in order counts.  Empty tables are as no labels.
    """
    spark = docs.sparkSession
    own = labels.where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), holdout) != 0) & F.col("quality").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("__high")).where("quality = __high").select("doc_id", "quality")
    ids = []
    for label in (0, 1):
        ids += own.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class).collect()
    chosen = spark.createDataFrame(ids, own.schema)
    texts = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id", F.lit(seed + 1)), "text", "quality").collect()
    texts.sort(key=lambda r: (r[0], r[1]))
    by: tuple[list[str], list[str]] = ([], [])
    n = 0
    for r in texts:
        n += len(r[1])
        if n > total_chars:
            break
        by[r[2]].append(r[1])
    bad, good = by
    if len(bad) < 8 or len(good) < 8:
        return CompressionModel((b"", b""), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES))
    train, test = (bad[::2], good[::2]), (bad[1::2], good[1::2])
    made = []
    for ts in train:
        samples = [p for t in ts for p in pieces(t)]
        try:
            made.append(zstandard.train_dictionary(DICT_BYTES, samples).as_bytes())
        except zstandard.ZstdError:  # too little text for a trained dictionary: the text itself serves
            made.append(b"".join(samples)[:DICT_BYTES])
    both = compressors((made[0], made[1]))
    x = np.array([features(t, both) for ts in test for t in ts])
    y = np.repeat([0.0, 1.0], [len(ts) for ts in test])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    return CompressionModel((made[0], made[1]), mean, scale, w)


def classify(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, higher: good likelier) and predicted (score >= threshold) to every row.

    The whole text counts, cut in chunks of 512 bytes; a null text scores as
    an empty one; equal rows give equal rows; an empty table gives an empty
    one.  Existing columns named score or predicted are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = compressors(model.dictionaries)
        for b in small_batches(batches):
            x = np.array([features(t, both) for t in b.column(at).to_pylist()]).reshape(-1, len(model.weights))
            s = 1 / (1 + np.exp(-np.clip((x - model.mean) / model.scale @ model.weights, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    src = docs.select(*keep)
    return src.mapInArrow(run, src.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
