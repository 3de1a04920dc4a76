"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Everything here is DataFrame and SQL functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import discard, materialize

BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
#: Bits of the five blocks of a 64-bit fingerprint.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints within so many bits are all found: one block then differs in RADIUS // 5 = 3 bits at most.
RADIUS = 19
#: Up to so many item shingles are broadcast (about 40 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SHINGLES = 200_000


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), BETWEEN_WORDS), "")


def once(value: Column | str, name: str) -> Column:
    """The value as a generated column, so that the optimizer can't copy its expression into later lambdas."""
    return F.explode(F.array(F.expr(value) if isinstance(value, str) else value)).alias(name)


def shingle_structs(col: str, size: int) -> str:
    """SQL of an array of (h, w): a shingle's hash and its weight, its number of characters.

    Fewer words than `size` make one shingle; no words make none.
    """
    piece = f"slice({col}, i, least({size}, size({col})))"
    return (
        f"transform(if(size({col}) = 0, array(), sequence(1, greatest(1, size({col}) - {size - 1}))), "
        f"i -> struct(xxhash64({piece}) AS h, length(array_join({piece}, '')) AS w))"
    )


def simhash(shingles: str) -> str:
    """SQL of the 64-bit SimHash of an array of (h, w)."""
    total = f"aggregate({shingles}, 0L, (s, x) -> s + if((shiftright(x.h, b) & 1L) = 1L, x.w, -x.w))"
    return f"aggregate(sequence(0, 63), 0L, (acc, b) -> if({total} > 0, acc | shiftleft(1L, b), acc))"


def overlap(a: str, b: str) -> str:
    """SQL of (lows, highs): summed weights of the smaller and larger counts of every shingle of both arrays."""
    count = "size(filter({0}, y -> y.h = x.h))"
    return (
        f"aggregate(array_distinct(concat({a}, {b})), struct(0L AS lows, 0L AS highs), (acc, x) -> struct("
        f"acc.lows + x.w * least({count.format(a)}, {count.format(b)}) AS lows, "
        f"acc.highs + x.w * greatest({count.format(a)}, {count.format(b)}) AS highs))"
    )


def block(col: str, i: int) -> str:
    """SQL of block i of a fingerprint."""
    return f"(shiftrightunsigned({col}, {sum(BLOCKS[:i])}) & {(1 << BLOCKS[i]) - 1}L)"


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 5) -> DataFrame:
    """Rows (item_id, len, shingles, fp) of all items that hold a word."""
    return (
        items.select(F.col(item_id).alias("item_id"), once(words(text), "words")).where("size(words) > 0")
        .select("item_id", F.size("words").alias("len"), once(shingle_structs("words", size), "shingles"))
        .select("item_id", "len", "shingles", once(simhash("shingles"), "fp"))
    )


def windows(docs: DataFrame, items: DataFrame, size: int = 5) -> DataFrame:
    """Item-sized windows of the texts, aligned with an item by a shared shingle: (doc_id, content, start, len, win).

    A window that is similar to an item shares a shingle with it, so no match
    is lost.  For each shared shingle the window starts where the item would
    (moved inside the text at its ends) and is as long as the item.
    """
    grams = items.select("len", F.posexplode("shingles").alias("at", "s")).select("len", "at", F.col("s.h").alias("h"), F.least(F.col("len"), F.lit(size)).alias("size")).distinct()
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # 1 to `size` numbers
    small = grams.count() <= BROADCAST_SHINGLES
    base = docs.select("doc_id", "content", once(words("text"), "words"))
    parts = []
    for n in sizes:
        hashes = F.expr(f"if(size(words) < {n}, array(), transform(sequence(1, size(words) - {n - 1}), i -> xxhash64(slice(words, i, {n}))))")
        own = grams.where(F.col("size") == n).select("h", "len", "at")
        rows = base.withColumn("hashes", hashes)
        if small:
            hits = rows.select("doc_id", "content", "words", F.posexplode_outer("hashes").alias("pos", "h")).join(F.broadcast(own), "h")
        else:
            found = rows.select("doc_id", "content", F.posexplode_outer("hashes").alias("pos", "h")).join(own, "h").select("content", "len", (F.col("pos") - F.col("at")).alias("diff")).distinct()
            hits = base.join(found, "content").withColumn("pos", F.col("diff")).withColumn("at", F.lit(0))
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("words") - F.col("len")))
        parts.append(hits.withColumn("start", start).select("doc_id", "content", "start", "len", F.expr("slice(words, start + 1, len)").alias("win")))
    if not parts:
        return base.select("doc_id", "content", F.lit(0).alias("start"), F.lit(0).alias("len"), F.col("words").alias("win")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5), radius: int = RADIUS) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, content, item_id, window_start, similarity), one row each pair.

    Distinct windows get a SimHash; five blocks of it are looked up among the
    items' fingerprints with up to radius // 5 flipped bits, which finds every
    fingerprint within the radius.  Candidates of the item's length are
    verified: weights of the shared over those of all shingles (counts kept,
    a shingle weighing its characters) must reach `threshold` (a fraction,
    compared in integers).  window_start counts words from 0, of the most
    similar window.

    Null, empty and wordless texts or items match nothing.  Equal rows give
    one row.  Items with equal texts are all reported.  An empty table of
    either kind gives none.  Other columns are ignored.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("content")).where("text IS NOT NULL")
    items = materialize(item_table(benchmark, item_id, item_text, size), "items")
    seen = materialize(windows(src, items, size).withColumn("key", F.md5(F.array_join("win", " "))), "windows")
    unique = seen.groupBy("key", "len").agg(F.first("win").alias("win"))
    unique = unique.select("key", "len", once(shingle_structs("win", size), "shingles")).select("key", "len", "shingles", once(simhash("shingles"), "fp"))
    unique = materialize(unique, "fingerprints")
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(block("fp", i)).alias("v")) for i in range(len(BLOCKS))])
    probes = unique.select("fp", "len").distinct().select("fp", "len", F.inline_outer(own))
    near = F.array(*[
        F.expr(f"transform(filter(sequence(0L, {(1 << n) - 1}L), m -> bit_count(m) <= {radius // len(BLOCKS)}), m -> struct({i} AS i, {block('item_fp', i)} ^ m AS v))")
        for i, n in enumerate(BLOCKS)
    ])
    index = items.select(F.col("fp").alias("item_fp"), "len").distinct().select("item_fp", "len", F.inline_outer(F.flatten(near)))
    close = (
        probes.join(index.hint("shuffle_hash"), ["len", "i", "v"]).where("bit_count(fp ^ item_fp) <= " + str(radius))
        .select("fp", "len", "item_fp").distinct()
    )
    a, b, (num, den) = "shingles", "item_shingles", threshold
    pairs = unique.join(close, ["fp", "len"]).join(items.select("item_id", "len", F.col("shingles").alias("item_shingles"), F.col("fp").alias("item_fp")), ["item_fp", "len"])
    good = (
        pairs.select("key", "len", "item_id", once(overlap(a, b), "o")).where(f"o.lows * {den} >= o.highs * {num}")
        .select("key", "len", "item_id", F.expr("o.lows / o.highs").alias("similarity"))
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    found = (
        seen.select("doc_id", "content", "start", "len", "key").join(good, ["key", "len"])
        .groupBy("doc_id", "content", "item_id").agg(best.alias("m"))
        .select("doc_id", "content", "item_id", F.expr("-m.start").alias("window_start"), F.expr("m.similarity").alias("similarity"))
    )
    found = materialize(found, "leaks")
    discard(items, seen, unique)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Drops every row whose text holds a benchmark item; rows with a null text stay."""
    bad = materialize(contaminated(docs, benchmark, doc_id, text, **options).select(F.col("content").alias("__content")).distinct(), "contaminated")
    return docs.withColumn("__md5", F.md5(text)).join(bad, F.col("__md5") == F.col("__content"), "left_anti").drop("__md5")


def oracle() -> str:
    """The matches as DuckDB SQL, by brute force over all item-sized windows at all starts that share a shingle with an item."""
    word = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    grams = "[array_to_string(list_slice({0}, i, i + 4), ' ') for i in range(1, greatest(1, len({0}) - 4) + 1)]"
    return f"""
WITH it AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, {word} AS ws FROM benchmark) WHERE len(ws) > 0),
ig AS (SELECT item_id, n, {grams.format('ws')} AS gs FROM it),
ip AS (SELECT DISTINCT n, unnest(gs) AS g FROM ig),
dw AS (SELECT doc_id, ws FROM (SELECT DISTINCT doc_id, {word} AS ws FROM documents) WHERE len(ws) > 0),
dp AS (SELECT doc_id, ws, generate_subscripts(gs, 1) - 1 AS pos, unnest(gs) AS g FROM (SELECT doc_id, ws, {grams.format('ws')} AS gs FROM dw)),
sh AS (SELECT DISTINCT doc_id, ws, n, pos FROM dp JOIN ip USING (g)),
st AS (SELECT DISTINCT doc_id, ws, n, start FROM sh, LATERAL (SELECT unnest(range(greatest(0, pos - n + 1), greatest(0, least(pos, len(ws) - n)) + 1)) AS start)),
win AS (SELECT doc_id, n, start, {grams.format('list_slice(ws, start + 1, start + n)')} AS gs FROM st),
wc AS (SELECT doc_id, n, start, g, count(*) AS c FROM (SELECT doc_id, n, start, unnest(gs) AS g FROM win) GROUP BY ALL),
wt AS (SELECT doc_id, n, start, sum(c * length(replace(g, ' ', ''))) AS tot FROM wc GROUP BY ALL),
ic AS (SELECT item_id, n, g, count(*) AS c FROM (SELECT item_id, n, unnest(gs) AS g FROM ig) GROUP BY ALL),
itot AS (SELECT item_id, n, sum(c * length(replace(g, ' ', ''))) AS tot FROM ic GROUP BY ALL),
lo AS (SELECT doc_id, n, start, item_id, sum(least(wc.c, ic.c) * length(replace(g, ' ', ''))) AS low FROM wc JOIN ic USING (n, g) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, low, (wt.tot + itot.tot - low) AS high FROM lo JOIN wt USING (doc_id, n, start) JOIN itot USING (item_id, n))
SELECT doc_id, item_id, arg_max(start, (low / high, -start))::INT AS window_start, round(max(low / high), 6) AS similarity
FROM sim WHERE low * 5 >= high * 4 GROUP BY doc_id, item_id
"""
