"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import WordHasher, arrow_rows, chunks_by_bytes, components, discard, materialize, mix64, small_batches

#: Document frequencies are counted in so many hash buckets: a fixed size, whatever the corpus.
DF_BITS = 20
DF_PART = 1 << 14
#: A text that agrees in all samples of one of so many bands with a text of smaller number is not counted in document frequencies.
THIN_BANDS, THIN_ROWS = 6, 4
#: Up to so many 8-byte numbers a filter of needed texts is broadcast; beyond, texts are filtered by a shuffled join.
BROADCAST_KEYS = 200_000
#: Buckets are split by further samples, in so many orders of them, until so many texts or fewer are left to pair.
ORDERS, LEAF, TREES = 2, 16, 64
#: Pairs that agree in fewer of 24 samples are not verified: at a similarity of 0.8 one pair in 50,000.
AGREE = 11
U21 = np.uint64((1 << 21) - 1)


def shingle_sets(hasher: WordHasher, texts: list[str | None], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes and their counts for each text.

    A text with fewer words than `size` has one shingle of all its words;
    one without words has none.
    """
    buf, starts, ends, doc = hasher.words(texts)
    w = hasher.hashes(buf, starts, ends)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(w) - size + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = w[:n].copy()
        for i in range(1, size):
            rolled *= np.uint64(0x9DDFEA08EB382D69)
            rolled ^= w[i : i + n]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            h, tf = np.unique(rolled[a : b - size + 1], return_counts=True)
        elif b > a:
            x = np.uint64(b - a)
            for v in w[a:b]:
                x = mix64(np.array([x], np.uint64))[0] ^ v
            h, tf = mix64(np.array([x], np.uint64)), np.ones(1, np.int64)
        else:
            h, tf = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out.append((h, tf))
    return out


def copies(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of the texts of (id, text) that are like one of smaller number, and of those in several rows.

    Likeness is read from plain min-hashes of the shingle sets: a text of
    Jaccard similarity 0.85 to a group's usual text is found with a chance
    of 0.99.  Nothing else is decided by it than which texts are counted.
    """
    rng = np.random.default_rng(29)
    seeds, odds = (rng.integers(1, 2**63, THIN_BANDS * THIN_ROWS, dtype=np.uint64) for _ in range(2))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in small_batches(batches):
            texts, keys = b.column(1).to_pylist(), []
            for i, j in chunks_by_bytes(texts):
                sets = [h for h, _ in shingle_sets(hasher, texts[i:j], size)]
                full = [k for k, h in enumerate(sets) if len(h)]
                own: list = [None] * len(sets)
                if full:
                    h = np.concatenate([sets[k] for k in full])
                    first = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
                    low = np.stack([np.minimum.reduceat((h ^ s) * (o | np.uint64(1)), first) for s, o in zip(seeds, odds, strict=True)], 1)
                    band = mix64(low[:, ::THIN_ROWS])
                    for r in range(1, THIN_ROWS):
                        band = mix64(band) ^ low[:, r::THIN_ROWS]
                    for k, row in zip(full, band.view(np.int64), strict=True):
                        own[k] = row
                keys += own
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "keys"])

    drawn = materialize(docs.mapInArrow(sketch, "id bigint, keys array<bigint>"), "sketches")
    bands = drawn.select("id", F.posexplode("keys").alias("level", "key"))
    lows = bands.groupBy("level", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    like = materialize(bands.join(lows, ["level", "key"]).where("id <> low").select("id").distinct(), "like")
    several = materialize(drawn.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    discard(drawn)
    return like, several


def bucket_frequencies(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, int]:
    """Number of documents with a shingle in each hash bucket, and the number of documents counted.

    Of equal texts and of groups of near copies (copies()) few are counted:
    otherwise what a group shares would weigh less the larger the group is,
    and its members would be the less alike.
    """
    src = docs.select(F.xxhash64(text).alias("id"), F.col(text).alias("text"))
    like, several = copies(src, size)
    skip, again = like.union(several).distinct(), several.join(like, "id", "left_anti")
    few = skip.count() <= BROADCAST_KEYS
    small = F.broadcast if few else lambda d: d
    single = src.join(small(skip), "id", "left_anti")
    once_each = src.join(small(again), "id", "left_semi").dropDuplicates(["id"])
    if few:
        once_each = once_each.coalesce(docs.sparkSession.sparkContext.defaultParallelism)  # each task of the count sends up to 8 MB
    counted = single.union(once_each)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, n, total = WordHasher(), np.zeros(1 << DF_BITS, np.int64), 0
        for b in small_batches(batches):
            texts = b.column(0).to_pylist()
            total += len(texts)
            for i, j in chunks_by_bytes(texts):
                sets = [h for h, _ in shingle_sets(hasher, texts[i:j], size)]
                n += np.bincount((np.concatenate(sets) & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=len(n))
        parts = n.reshape(-1, DF_PART)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"part": pa.array([*used, -1], pa.int32()), "n": pa.array([*(parts[p].tobytes() for p in used), np.int64(total).tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf.n.iloc[0], np.int64).copy()
        for x in pdf.n.iloc[1:]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "n": [total.tobytes()]})

    once = counted.select("text").mapInArrow(count, "part int, n binary")
    # two levels, so that one task adds the parts of some hundred tasks at most
    half = once.withColumn("salt", (F.spark_partition_id() / 128).cast("int")).groupBy("part", "salt").applyInPandas(lambda p: add(p), "part int, n binary")
    out, total = np.zeros((1 << DF_BITS) // DF_PART * DF_PART, np.int64).reshape(-1, DF_PART), 0
    with arrow_rows(docs.sparkSession):
        rows = half.groupBy("part").applyInPandas(add, "part int, n binary").collect()  # 64 parts of 128 kB
    for r in rows:
        if r["part"] < 0:
            total = int(np.frombuffer(r["n"], np.int64)[0])
        else:
            out[r["part"]] = np.frombuffer(r["n"], np.int64)
    discard(like, several)
    return out.reshape(-1), total


def idf_table(freq: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of a shingle by its bucket: log(1 + documents / documents with the bucket)."""
    return np.log1p(n_docs / np.maximum(freq, 1)).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray, n_samples: int, seed: int) -> np.ndarray:
    """Consistent weighted samples, one column each, for sets that start at `first` and are not empty.

    With r, c ~ Gamma(2, 1) and beta ~ U(0, 1) drawn from a hash of
    (shingle, sample): t = floor(ln w / r + beta), and the shingle with the
    smallest ln a = ln c - r (t - beta) - r is taken; the sample is (shingle, t).
    """
    seeds = np.random.default_rng(seed).integers(1, 2**63, n_samples, dtype=np.uint64)
    lw = np.log(weight).astype(np.float32)
    out = np.zeros((len(first), n_samples), np.uint64)
    block = 1 << 14
    la, ts = np.empty(len(h), np.float32), np.empty(len(h), np.float32)
    unit = lambda x: ((x & U21).astype(np.float32) + np.float32(0.5)) * np.float32(2**-21)
    counts = np.diff(np.append(first, len(h)))
    for j in range(n_samples):
        for i in range(0, len(h), block):
            at = slice(i, i + block)
            x = mix64(h[at] ^ seeds[j])
            y = mix64(x + np.uint64(0x9E3779B97F4A7C15))
            r = -np.log(unit(x) * unit(x >> np.uint64(21)))
            lc = np.log(-np.log(unit(y) * unit(y >> np.uint64(21))))
            beta = unit(y >> np.uint64(42))
            t = np.floor(lw[at] / r + beta)
            la[at], ts[at] = lc - r * (t - beta + 1), t
        low = np.minimum.reduceat(la, first)
        hits = np.flatnonzero(la == np.repeat(low, counts))
        best = hits[np.searchsorted(hits, first)]
        out[:, j] = mix64(h[best] ^ (ts[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def weighted_jaccard(a: tuple, b: tuple, idf: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger TF-IDF weights of two shingle sets."""
    (ha, ta), (hb, tb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    mask = np.uint64((1 << DF_BITS) - 1)
    wa, wb = ta * idf[(ha & mask).astype(np.int64)].astype(float), tb * idf[(hb & mask).astype(np.int64)].astype(float)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def pack(samples: np.ndarray) -> np.ndarray:
    """The lowest byte of every sample, eight in a 64-bit word: (rows, words); the last word is filled up with zeros."""
    low = samples.astype(np.uint8)
    return np.pad(low, ((0, 0), (0, -low.shape[1] % 8))).view(np.int64)


def parted_pairs(members: DataFrame, n_samples: int, orders: int = ORDERS, leaf: int = LEAF, least: int | None = None) -> DataFrame:
    """Pairs (a, b) of texts that share a bucket, lie in different parts and agree in `least` samples: from (level, key, id, part, words), all numbers.

    A bucket of more than `leaf` texts is split by two more samples at a
    time, in `orders` different orders of them, until its pieces are small;
    inside a piece all pairs of different parts are made.  Before a piece is
    split, all its texts meet one of them, another one in each piece: so a
    text that is like many of a large group, but not like its hub, joins it.
    Pieces of one text or one part are done.  So each text meets a bounded
    number of others in each piece, the likest ones, and no group is ever
    paired with itself.
    Of a text only its id and a byte of each sample (pack()) travel; that
    can make a pair that differs, which is verified like all others.
    """
    least = round(AGREE * n_samples / 24) if least is None else least
    rng = np.random.default_rng(23)
    perms = F.array(*[F.array(*[F.lit(int(i)) for i in rng.permutation(n_samples)]) for _ in range(TREES)])
    cur = members.select("level", F.col("key").alias("bucket"), "id", "part", "words", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("o"))
    cur = cur.select(F.xxhash64("level", "bucket", "o").alias("key"), F.pmod(F.xxhash64("level", "o"), F.lit(TREES)).cast("int").alias("tree"), "id", "part", "words")

    def byte(place: int) -> Column:
        at = F.get(F.get(perms, F.col("tree")), F.lit(place))
        return F.call_function("shiftrightunsigned", F.get("words", (at / 8).cast("int")), (at % 8 * 8).cast("int")).bitwiseAND(F.lit(255))

    unlike = "aggregate(zip_with(x.words, y.words, (p, q) -> p ^ q), 0, (n, v) -> n + bit_count((v | shiftrightunsigned(v, 1) | shiftrightunsigned(v, 2) | shiftrightunsigned(v, 3) | shiftrightunsigned(v, 4) | shiftrightunsigned(v, 5) | shiftrightunsigned(v, 6) | shiftrightunsigned(v, 7)) & 72340172838076673L))"
    pairs = F.expr(
        f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {leaf}), y -> y.part <> x.part AND {n_samples} - {unlike} >= {least}), "
        "y -> struct(least(x.id, y.id) AS a, greatest(x.id, y.id) AS b))))"
    )
    turn = F.xxhash64("key", "id")
    one = [F.max_by("id", turn).alias("hub"), F.max_by("part", turn).alias("hub_part"), *(F.max_by(F.get("words", F.lit(i)), turn).alias(f"hub_{i}") for i in range(-(-n_samples // 8)))]
    hub_words = F.array(*[F.col(f"hub_{i}") for i in range(-(-n_samples // 8))])
    with_hub = F.expr(f"{n_samples} - {unlike.replace('x.words', 'words').replace('y.words', 'hub_words')} >= {least}")
    made, before, steps = [], None, n_samples // 2
    for step in range(steps + 1):
        sizes = cur.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), *one).where("low <> high")
        sizes = sizes.select("key", "n", "hub", "hub_part", hub_words.alias("hub_words"))
        now = materialize(cur.join(sizes, "key"), "pieces")
        if before is not None:
            discard(before)
        before = now
        if step == steps:
            made.append(materialize(now.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs"))
            break
        met = now.where(F.col("n") > leaf).where("part <> hub_part").where(with_hub).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        small = now.where(F.col("n") <= leaf).groupBy("key").agg(F.collect_list(F.struct("id", "part", "words")).alias("l"))
        made.append(materialize(small.select(F.inline(pairs)).union(met).distinct(), "pairs"))
        large = now.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        cur = large.select(F.xxhash64("key", byte(2 * step), byte(2 * step + 1)).alias("key"), "tree", "id", "part", "words")
    found = made[0]
    for d in made[1:]:
        found = found.union(d)
    out = materialize(found.distinct(), "pairs")
    discard(before, *made)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 12, rows: int = 2, seed: int = 11) -> DataFrame:
    """Classes of near-duplicate documents: (doc_id, class_id, content) for every row.

    Words are split at ASCII white space with A-Z lower-cased; shingles of
    `size` words are weighted by term frequency times bucketed inverse
    document frequency, counted without copies.  Each distinct text (by MD5) gets bands * rows
    samples.  Of every bucket, each text is first linked with the text of the
    bucket whose own buckets are fullest, and with such a one of those that
    agree in the next band as well.  Buckets that hold texts not joined by that are split by further
    samples until all pairs of a piece can be compared.  Pairs with a
    weighted Jaccard similarity of `threshold` or more are joined; class_id
    is the smallest doc_id of a class.

    Null texts and texts without words form no class but that of equal texts:
    a null text stays alone (class_id is its own id).  A null id never names
    a class unless all ids are null.  Equal rows give equal rows; texts of any
    length count whole; an empty table gives an empty one.  Other columns are
    ignored.
    """
    spark, done = docs.sparkSession, []
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("content"))
    number = F.xxhash64("content").alias("id")  # names texts while candidates are sought; should two share one, both are verified
    freq, n_docs = bucket_frequencies(src, "text", size)
    weights = spark.sparkContext.broadcast(idf_table(freq, n_docs))  # 4 MB, whatever the corpus
    n_samples = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, idf = WordHasher(), weights.value
        for b in small_batches(batches):
            texts, keys, drawn_all = b.column(1).to_pylist(), [], []
            for i, j in chunks_by_bytes(texts):
                sets = shingle_sets(hasher, texts[i:j], size)
                full = [k for k, (h, _) in enumerate(sets) if len(h)]
                own: list = [None] * len(sets)
                kept: list = [None] * len(sets)
                if full:
                    h = np.concatenate([sets[k][0] for k in full])
                    w = np.concatenate([sets[k][1] for k in full]) * idf[(h & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)]
                    first = np.cumsum([0, *(len(sets[k][0]) for k in full[:-1])])
                    s = samples(h, w, first, n_samples, seed)
                    band = s[:, ::rows].copy()
                    for r in range(1, rows):
                        band = mix64(band) ^ s[:, r::rows]
                    pair = mix64(band) ^ np.roll(band, -1, 1)
                    both = np.concatenate([band, pair], 1).view(np.int64)
                    for k, row, drawn in zip(full, both, pack(s), strict=True):
                        own[k], kept[k] = row, drawn
                keys += own
                drawn_all += kept
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(drawn_all, pa.list_(pa.int64()))], names=["doc_id", "content", "keys", "words"])

    signed = materialize(src.mapInArrow(sign, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, content string, keys array<bigint>, words array<bigint>"), "signatures")
    texts = signed.where("keys IS NOT NULL").groupBy("content").agg(F.first("keys").alias("keys"), F.first("words").alias("words"))
    buckets = texts.select(number, F.posexplode("keys").alias("level", "key"))
    sizes = buckets.groupBy("level", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(buckets.join(sizes, ["level", "key"]), "crowded")
    # the text whose buckets hold the most texts is the one its copies were made from, or the likest to it; ties go by the number
    rank = crowded.groupBy("id").agg((F.least(F.sum("n"), F.lit(1 << 29)) * (1 << 34) + F.col("id").bitwiseAND(F.lit((1 << 34) - 1))).alias("rank"))
    hubs = crowded.join(rank, "id").groupBy("level", "key").agg(F.max_by("id", "rank").alias("low"))
    shared = materialize(crowded.drop("n").join(hubs, ["level", "key"]), "shared")
    discard(crowded)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, idf, last, kept = WordHasher(), weights.value, None, None
        for b in small_batches(batches):
            a_key, b_key, a_text, b_text = (c.to_pylist() for c in b.columns)
            good = []
            for i, j in chunks_by_bytes(a_text):
                for k, s in zip(range(i, j), shingle_sets(hasher, a_text[i:j], size), strict=True):
                    if b_key[k] != last:
                        last, kept = b_key[k], shingle_sets(hasher, [b_text[k]], size)[0]
                    if weighted_jaccard(s, kept, idf) >= threshold:
                        good.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a_key[k] for k in good], pa.string()), "b": pa.array([b_key[k] for k in good], pa.string())})

    def verified(links: DataFrame) -> DataFrame:
        """The pairs (a, b) of numbers whose texts reach the threshold, as MD5s."""
        needed = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
        if needed.count() <= BROADCAST_KEYS:
            needed = F.broadcast(needed)
        bodies = materialize(src.select(number, "content", "text").join(needed, "id", "left_semi").groupBy("id", "content").agg(F.first("text").alias("text")), "texts")
        done.append(bodies)
        pairs = links.join(bodies.toDF("a", "a_content", "a_text"), "a").join(bodies.toDF("b", "b_content", "b_text"), "b").select("a_content", "b_content", "a_text", "b_text")
        return pairs.mapInArrow(verify, "a string, b string")

    links = materialize(shared.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), "candidates")
    verified_links = materialize(verified(links), "verified")
    roots = components(verified_links)
    discard(*done, verified_links)
    done.clear()
    # two bands that agree are a bucket of each band as well, so the buckets of the bands hold all pairs
    parts = roots.select(F.xxhash64("id").alias("id"), F.xxhash64("component").alias("part"))
    members = shared.where(F.col("level") < bands).join(parts, "id", "left").select("level", "key", "id", F.coalesce("part", "id").alias("part"))
    members = materialize(members, "members")
    discard(shared)
    mixed = members.groupBy("level", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("level", "key")
    drawn = texts.select(number, "words")
    apart = materialize(members.join(mixed, ["level", "key"], "left_semi").join(drawn, "id"), "apart")
    discard(members)
    tried = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = parted_pairs(apart, n_samples)
    discard(apart)
    rest = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
    more = materialize(verified(rest), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    discard(*done, links, pairs, rest, more)
    first_ids = signed.where("content IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("low"))
    classes = first_ids.join(roots, F.col("content") == F.col("id"), "left").withColumn("component", F.coalesce("component", "content"))
    names = classes.groupBy("component").agg(F.min("low").alias("class_id"))
    by_content = classes.join(names, "component").select("content", "class_id")
    return signed.select("doc_id", "content").join(by_content, "content", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "content")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Keeps one row of each class of near_duplicates(), with all its columns: the one with the smallest id.

    Rows with a null text stay; of equal rows with that id one stays.
    """
    classes = near_duplicates(docs, doc_id, text, **options)
    keep = materialize(classes.where(F.col("content").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct(), "kept")
    null_text = docs.where(F.col(text).isNull())
    marked = docs.where(F.col(text).isNotNull()).withColumn("__md5", F.md5(text))
    found = marked.join(keep, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__content")), "left_semi")
    return found.dropDuplicates([doc_id, "__md5"]).drop("__md5").unionByName(null_text)
