"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import arrow_rows, mix64, small_batches

DIM = 1024
#: A trigram's code has 21 bits, a code point, for each letter; 0 is any run of other characters.
BITS = 21
#: Gram vectors are made and multiplied in blocks of so many; a worker keeps so many.
BLOCK, KEPT = 4096, 24_576
#: Cosines of unrelated random vectors mostly lie below so many standard deviations (1 / sqrt(DIM)).  Three would drop
#: clean texts of four words: of 51,282 documents the lowest cosine of a clean one is 0.082, and 3 / sqrt(1024) is 0.094.
DEVIATIONS = 2.0


def letter_vectors(points: np.ndarray, dim: int = DIM, seed: int = 5) -> np.ndarray:
    """A random +1/-1 vector for each code point: the bits of a hash of (seed, point, place)."""
    words = np.arange(-(-dim // 64), dtype=np.uint64) + np.uint64(1)
    h = mix64(mix64(points.astype(np.uint64) + np.uint64(seed << 32))[:, None] + words[None, :] * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1)[:, :dim]
    return (bits.astype(np.int8) << 1) - np.int8(1)


def gram_vectors(codes: np.ndarray, dim: int = DIM, seed: int = 5) -> np.ndarray:
    """Trigram vectors: the letters' vectors, rotated by 2, 1 and 0 places, bound by multiplication."""
    mask = (1 << BITS) - 1
    parts = np.stack([codes >> (2 * BITS), (codes >> BITS) & mask, codes & mask])
    points, at = np.unique(parts, return_inverse=True)
    letters, at = letter_vectors(points, dim, seed), at.reshape(parts.shape)
    return np.roll(letters, 2, 1)[at[0]] * np.roll(letters, 1, 1)[at[1]] * letters[at[2]]


_TABLE: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Every letter's own code point, A-Z lower-cased; 0 for all other characters."""
    if not _TABLE:
        t = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                t[c] = c
        t[65:91] = t[97:123]
        _TABLE.append(t)
    return _TABLE[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts, each code's text, and which texts hold a letter.

    Texts are lower-cased; a run of other characters counts as one space, and
    a space stands before and after each text.
    """
    low = [(t or "").lower() for t in texts]
    joined = " " + "  ".join(low) + " "
    sym = symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 2 for t in low])
    doc = np.repeat(np.arange(len(low), dtype=np.int32), np.diff(ends, prepend=0))
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    letters = np.bincount(doc[sym > 0], minlength=len(low)) > 0
    code = (sym[:-2] << (2 * BITS)) | (sym[1:-1] << BITS) | sym[2:]
    ok = doc[:-2] == doc[2:]
    return code[ok], doc[:-2][ok], letters


class GramVectors:
    """Vectors of the trigrams seen last."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.forget()

    def forget(self) -> None:
        self.codes, self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.rows = np.empty((KEPT + BLOCK, self.dim), np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of at most BLOCK distinct codes in ascending order."""
        place = np.searchsorted(self.codes, codes)
        new = self.codes[np.minimum(place, len(self.codes) - 1)] != codes if len(self.codes) else np.ones(len(codes), bool)
        if new.any():
            if self.n > KEPT:
                self.forget()
                return self.of(codes)
            fresh = codes[new]
            self.rows[self.n : self.n + len(fresh)] = gram_vectors(fresh, self.dim, self.seed)
            where = place[new]
            self.codes, self.at = np.insert(self.codes, where, fresh), np.insert(self.at, where, np.arange(self.n, self.n + len(fresh)))
            self.n += len(fresh)
            place = np.searchsorted(self.codes, codes)
        return self.rows[self.at[place]]


def learn_prototypes(docs: DataFrame, lang: str = "lang", text: str = "text", dim: int = DIM, seed: int = 5) -> dict[str, np.ndarray]:
    """Bundles the trigram vectors of all given documents of each language: {lang: vector of length 1}.

    Each task counts trigrams and adds their vectors, in whole numbers, so
    the sums are exact and any order gives the same; one vector for each task
    and language is summed, and the driver gets one for each language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name: str) -> None:
            code, n = counts.pop(name)
            total = sums.setdefault(name, np.zeros(dim))
            for i in range(0, len(code), BLOCK):
                total += n[i : i + BLOCK].astype(float) @ gram_vectors(code[i : i + BLOCK], dim, seed).astype(float)

        for b in small_batches(batches):
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            code, doc, _ = trigrams(texts)
            for name in sorted(set(langs)):
                own, n = np.unique(code[(langs == name)[doc]], return_counts=True)
                if name in counts:
                    old, m = counts[name]
                    both, inv = np.unique(np.concatenate([old, own]), return_inverse=True)
                    own, n = both, np.bincount(inv, np.concatenate([m, n]), len(both)).astype(np.int64)
                counts[name] = (own, n)
                if len(own) > 200_000:
                    add(name)
        for name in list(counts):
            add(name)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "vector": [np.sum(np.stack(pdf.vector.to_list()), axis=0)]})

    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    kind = "lang string, vector array<double>"
    each = known.mapInArrow(bundle, kind).withColumn("salt", (F.spark_partition_id() / 128).cast("int"))
    some = each.groupBy("lang", "salt").applyInPandas(lambda p: total(p), kind)
    with arrow_rows(docs.sparkSession):
        rows = some.groupBy("lang").applyInPandas(total, kind).collect()
    made = {r["lang"]: np.array(r["vector"]) for r in sorted(rows, key=lambda r: r["lang"])}
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in made.items()}


def predict(texts: list[str | None], names: list[str], protos: np.ndarray, grams: GramVectors) -> tuple[list[str], np.ndarray]:
    """Language and cosine of each text; `und` and 0 for a text without a letter."""
    code, doc, has = trigrams(texts)
    if not names or not len(code):
        return ["und"] * len(texts), np.zeros(len(texts))
    used, at = np.unique(code, return_inverse=True)
    own = np.zeros((len(texts), grams.dim), np.float32)
    for i in range(0, len(used), BLOCK):  # whatever the number of trigrams, a block of vectors at a time
        part = used[i : i + BLOCK]
        mine = slice(None) if len(used) <= BLOCK else (at >= i) & (at < i + len(part))
        counts = np.bincount(doc[mine].astype(np.int64) * len(part) + (at[mine] - i), minlength=len(texts) * len(part)).reshape(len(texts), -1)
        own += counts.astype(np.float32) @ grams.of(part).astype(np.float32)
    norm = np.linalg.norm(own, axis=1)
    cos = (own @ protos.T.astype(np.float32)) / np.where(norm > 0, norm, 1)[:, None]
    best = cos.argmax(1)
    score = np.where(has, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0)
    return [names[i] if h else "und" for i, h in zip(best, has, strict=True)], score


def resembles(dim: int = DIM) -> float:
    """A cosine that unrelated random vectors seldom reach (one in 44): texts below it resemble no learned language."""
    return DEVIATIONS / dim**0.5


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM, seed: int = 5) -> DataFrame:
    """Adds lang_pred and score (cosine with the best prototype, 0 to 1) to every row.

    A null text or one without a letter gives `und` and 0; so does every text
    if no language was learned.  Equal cosines go to the first name in order.
    Texts of any length count whole; equal rows give equal rows; an empty
    table gives an empty one.  Existing columns named lang_pred or score are
    replaced.
    """
    names = sorted(prototypes)
    protos = np.array([prototypes[n] for n in names]).reshape(len(names), dim)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = keep.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = GramVectors(dim, seed)
        for b in small_batches(batches):
            texts = b.column(at).to_pylist()
            lang, value = [], []
            for i in range(0, len(texts), 64):
                x, y = predict(texts[i : i + 64], names, protos, grams)
                lang += x
                value.append(y)
            cols = [*b.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(value) if value else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    src = docs.select(*keep)
    schema = src.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return src.mapInArrow(score, schema)
