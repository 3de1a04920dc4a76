"""Near-duplicate embeddings: HNSW graphs per shard, audited range search, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import hnsw
from vicinal.llm.common import components, discard, materialize, small_batches

#: Distinct vectors of a shard, about; a label with more has several, and every vector queries all of them.
SHARD_ROWS = 8192
FIRST_BEAM, WIDEST_BEAM = 48, 192
AUDIT = 128
#: Found in single precision with this slack, then verified in double precision.
SLACK = 1e-4


def range_links(x: np.ndarray, layers: tuple, queries: np.ndarray, least: float, same: bool = False, beam: int = FIRST_BEAM) -> np.ndarray:
    """Which rows of x (columns) have a similarity of `least` or more with each query (rows), as found by the graph.

    With `same`, the queries are the rows of x themselves: each search starts
    at its own node too, and a vector's likeness to itself is no link.

    A query whose beam holds nothing below `least` searches again with a
    beam four times as wide.  Then 128 queries, those with links first, are
    compared with a full scan; while the graph misses a link, all beams start
    twice as wide.  Beyond 192 the next width is the whole shard, which is a
    scan: a query with so many links, or a shard whose audits still fail,
    costs one matrix product and loses nothing.
    """
    n = len(x)
    while True:
        out = np.zeros((len(queries), n), bool)
        if beam >= n:
            out[:] = queries @ x.T >= least
        for i in range(0, len(queries) if beam < n else 0, hnsw.BATCH):
            rows, width = np.arange(i, min(i + hnsw.BATCH, len(queries))), min(beam, n)
            while len(rows):
                step = max(8, min(hnsw.BATCH, 5000 // hnsw.expanded(width)))  # about 32 MB of gathered vectors
                for j in range(0, len(rows), step):
                    part = rows[j : j + step]
                    ids, sims = hnsw.search(x, layers, queries[part], width, part if same else None)
                    hit = (sims >= least) & (ids >= 0)
                    r, c = np.nonzero(hit)
                    out[part[r], ids[r, c]] = True
                    rows[j : j + len(part)] = np.where(hit.all(1), part, -1)
                rows = rows[rows >= 0] if width < n else rows[:0]
                if len(rows) and width >= WIDEST_BEAM:
                    out[rows] = queries[rows] @ x.T >= least
                    break
                width = min(width * 4, WIDEST_BEAM, n)
        if same:
            np.fill_diagonal(out, False)
        linked = out.any(1)
        audit = np.argsort(~linked, kind="stable")
        audit = np.unique(np.concatenate([audit[: AUDIT // 2], audit[np.linspace(0, len(audit) - 1, AUDIT // 2).astype(int)]]))
        truth = queries[audit] @ x.T >= least + SLACK / 2
        if same:
            truth[np.arange(len(audit)), audit] = False
        if not (truth & ~out[audit]).any() or beam >= n:
            return out
        beam *= 2
        if beam > WIDEST_BEAM:
            beam = n


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their norms, in double and in single precision."""
    big = x.astype(float)
    big /= np.abs(big).max(1, keepdims=True)  # norms of very large or small vectors neither overflow nor vanish
    big /= np.sqrt((big * big).sum(1, keepdims=True))
    return big, big.astype(np.float32)


def pack(members: list[np.ndarray], graphs: list[np.ndarray]) -> bytes:
    parts = [np.array([len(members)], np.int32), *(np.concatenate([[len(m)], m, g.ravel()]).astype(np.int32) for m, g in zip(members, graphs, strict=True))]
    return np.concatenate(parts).tobytes()


def unpack(raw: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    a = np.frombuffer(raw, np.int32).astype(np.int64)
    members, graphs, at = [], [], 1
    for _ in range(a[0]):
        n = int(a[at])
        members.append(a[at + 1 : at + 1 + n])
        graphs.append(a[at + 1 + n : at + 1 + n * (1 + hnsw.LINKS)].reshape(n, hnsw.LINKS))
        at += 1 + n * (1 + hnsw.LINKS)
    return members, graphs


def smallest_linked(adj: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each side's vectors within their components of one link matrix."""
    low_a, low_b = a_ids.copy(), b_ids.copy()
    turned, seen_a, seen_b = np.ascontiguousarray(adj.T), ~adj.any(1), np.zeros(len(b_ids), bool)
    for i in np.flatnonzero(~seen_a):  # breadth first; every row and column is read once
        if seen_a[i]:
            continue
        seen_a[i] = True
        rows, all_rows, all_cols = np.array([i]), [np.array([i])], []
        while len(rows):
            cols = np.flatnonzero(adj[rows].any(0) & ~seen_b)
            seen_b[cols] = True
            rows = np.flatnonzero(turned[cols].any(0) & ~seen_a)
            seen_a[rows] = True
            all_rows.append(rows)
            all_cols.append(cols)
        r, c = np.concatenate(all_rows), np.concatenate(all_cols)
        low_a[r] = low_b[c] = min(a_ids[r].min(), b_ids[c].min())
    return low_a, low_b


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links of cosine >= threshold inside labels: (vec_id, n_links, component_id, kept) for every row.

    Equal vectors of a label are counted once and stand for their number.
    Distinct ones are dealt to shards of about shard_rows; each shard gets a
    graph, and every shard's vectors query every shard of their label, both
    ways.  Links are verified in double precision.  A pair of shards gives
    counts and one smallest id for each linked vector, never the pairs.

    Null labels, and vectors that are null, empty, zero or hold a null or
    non-finite component, link with nothing and stay alone; so do vectors of
    unlike lengths.  Equal rows count as different vectors; rows with one id
    are one vertex.  An empty table gives an empty one; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    src = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    usable = src.where("ok AND vec_id IS NOT NULL").select("vec_id", "embedding", "label", F.size("embedding").alias("dim"))
    reps = materialize(usable.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct")
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(7)), "shards").cast("int"))

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        raw = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        layers = hnsw.build(unit(raw)[1])
        row = {c: [table.column(c)[0].as_py()] for c in ("label", "dim", "shard")}
        row |= {"ids": [table.column("rep").to_numpy().tobytes()], "counts": [table.column("n").to_numpy().tobytes()], "vectors": [raw.tobytes()], "graph": [pack(*layers)]}
        return pa.table(row, pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "vectors", "graph"))]))

    kind = "label string, dim int, shard int, ids binary, counts binary, vectors binary, graph binary"
    cols = [F.col(c) for c in ("label", "dim", "shard", "rep", "n", "embedding")]
    graphs = materialize(dealt.select(*cols).groupBy("label", "dim", "shard").applyInArrow(graph, kind), "graphs")
    keys = graphs.select("label", "dim", F.col("shard").alias("a"))
    pairs = keys.join(graphs.select("label", "dim", F.col("shard").alias("b")), ["label", "dim"]).where("a <= b")
    side = lambda s: graphs.select("label", "dim", F.col("shard").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "counts", "vectors", "graph")])
    work = pairs.join(side("a").hint("merge"), ["label", "dim", "a"]).join(side("b").hint("merge"), ["label", "dim", "b"])
    work = work.select("dim", (F.col("a") == F.col("b")).alias("same"), *[f"{s}_{c}" for s in "ab" for c in ("ids", "counts", "vectors", "graph")])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for row in batch.to_pylist():
                ids, counts, big, small, layers = {}, {}, {}, {}, {}
                for s in "ab":
                    ids[s], counts[s] = np.frombuffer(row[f"{s}_ids"], np.int64), np.frombuffer(row[f"{s}_counts"], np.int64)
                    big[s], small[s] = unit(np.frombuffer(row[f"{s}_vectors"], float).reshape(-1, row["dim"]))
                    layers[s] = unpack(row[f"{s}_graph"])
                adj = range_links(small["b"], layers["b"], small["a"], threshold - SLACK, bool(row["same"]))
                if row["same"]:
                    adj |= adj.T
                    np.fill_diagonal(adj, False)
                else:
                    adj |= range_links(small["a"], layers["a"], small["b"], threshold - SLACK).T
                for i in np.flatnonzero(adj.any(1)):  # in double precision, row by row
                    j = np.flatnonzero(adj[i])
                    adj[i, j] = big["b"][j] @ big["a"][i] >= threshold
                if row["same"]:
                    adj |= adj.T
                low_a, low_b = smallest_linked(adj, ids["a"], ids["b"])
                some = adj.any(1)
                out = [(ids["a"][some], adj[some] @ counts["b"], low_a[some])]
                if not row["same"]:
                    some = adj.any(0)
                    out.append((ids["b"][some], counts["a"] @ adj[:, some], low_b[some]))
                else:
                    out[0] = (*out[0][:2], np.minimum(low_a, low_b)[adj.any(1)])
                for a, n, low in out:
                    yield pa.RecordBatch.from_pydict({"rep": pa.array(a), "links": pa.array(n.astype(np.int64)), "low": pa.array(low)})

    found = materialize(work.mapInArrow(link, "rep bigint, links bigint, low bigint"), "links")
    discard(graphs)
    roots = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(totals, "rep", "left").join(roots, F.col("rep") == F.col("id"), "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = src.where("ok AND vec_id IS NOT NULL").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = src.where("NOT ok OR vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
