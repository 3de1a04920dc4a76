"""DuckDB SQL of the registered searches, with the drawn hash functions inlined."""

from __future__ import annotations

from vicinal.functions import hashing
from vicinal.functions.hashing import GOLDEN_32, MUL_32, SHIFTS_32, draw_functions
from vicinal.options import HashFamily, LshOptions

DIMS = 64
POINTS = "SELECT vec_id AS id, embedding AS vec FROM embeddings"
NOT_FOUND = "3.4028234663852886e38::DOUBLE"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def squared_distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def combine_steps(source: str, seed: str, value: str, out: str) -> str:
    """A query over the source with column `out`, the mix of the value into the seed; one level for each use of a value."""
    (s1, s2, s3), (m1, m2) = SHIFTS_32, MUL_32
    sql = f"SELECT *, (({seed}) + {GOLDEN_32} + ({value})) & 4294967295 AS {out}a FROM {source}"
    sql = f"SELECT * EXCLUDE ({out}a), (xor({out}a, {out}a >> {s1}) * {m1}) & 4294967295 AS {out}b FROM ({sql})"
    sql = f"SELECT * EXCLUDE ({out}b), (xor({out}b, {out}b >> {s2}) * {m2}) & 4294967295 AS {out}c FROM ({sql})"
    return f"SELECT * EXCLUDE ({out}c), xor({out}c, {out}c >> {s3}) AS {out} FROM ({sql})"


def functions(o: LshOptions, dims: int = DIMS) -> str:
    """CTEs fn (f, a, b) of the pool and ch (hash_table, slot, f) of the choice."""
    fns = draw_functions(o, dims)
    used = sorted({int(f) for f in fns.choice.ravel()}) if o.family is not HashFamily.ENTROPY_BASED else range(len(fns.coeffs))
    pool = ", ".join(f"({f}, [{', '.join(f'{x!r}::DOUBLE' for x in fns.coeffs[f].tolist())}], {float(fns.offsets[f])!r}::DOUBLE)" for f in used)
    choice = ", ".join(f"({t}, {s}, {int(f)})" for t, own in enumerate(fns.choice) for s, f in enumerate(own))
    return f"fn AS (SELECT * FROM (VALUES {pool}) v(f, a, b)), ch AS (SELECT * FROM (VALUES {choice}) v(hash_table, slot, f))"


def projections(o: LshOptions, points: str = POINTS) -> str:
    """CTEs pts (id, vec) and pr (id, f, p, e): projections and segment numbers."""
    return f"pts AS MATERIALIZED ({points}), pr AS (SELECT id, f, p, trunc((b + p) / {o.w!r}::DOUBLE)::BIGINT AS e FROM (SELECT id, f, b, {dot('vec', 'a')} AS p FROM pts, fn))"


def cut_points(o: LshOptions) -> str:
    """CTEs of the values to divide, val (id, fn, value), and of the cut-off points, cut (fn, cut_index, cut_value)."""
    c = o.num_cut_off_points
    if o.family is HashFamily.MIXED:
        val, rank = "SELECT id, hash_table AS fn, sum(e)::DOUBLE AS value FROM pr JOIN ch USING (f) GROUP BY ALL", f"(i + 1) * (n // {c}) + least(i + 1, n % {c})"
    else:
        val, rank = "SELECT id, f AS fn, p AS value FROM pr", f"(i + 1) * (n // {c})"
    return (
        f"val AS ({val}), srt AS (SELECT fn, value, row_number() OVER (PARTITION BY fn ORDER BY value, id) - 1 AS pos FROM val), "
        f"cut AS (SELECT fn, i::INT AS cut_index, value AS cut_value FROM srt, range(0, {c - 1}) r(i), (SELECT count(*) AS n FROM pts) WHERE pos = {rank})"
    )


def buckets(o: LshOptions, points: str = POINTS, dims: int = DIMS) -> str:
    """All CTEs up to bk (hash_table, bucket, id)."""
    head = f"{functions(o, dims)}, {projections(o, points)}"
    if o.family is HashFamily.MIXED:
        return f"{head}, {cut_points(o)}, bk AS (SELECT fn AS hash_table, (count(*) FILTER (WHERE value > cut_value)) % {o.buckets} AS bucket, id FROM val JOIN cut USING (fn) GROUP BY fn, id)"
    if o.family is HashFamily.ENTROPY_BASED:
        head += f", {cut_points(o)}"
        slot = "SELECT v.id, v.fn AS f, count(*) FILTER (WHERE value > cut_value) AS e FROM val v JOIN cut USING (fn) GROUP BY v.id, v.fn"
    else:
        slot = "SELECT id, f, e & 4294967295 AS e FROM pr"
    m = o.num_hash_functions
    wide = ", ".join(f"max(e) FILTER (WHERE slot = {s}) AS e{s}" for s in range(m))
    chain = "wd"
    for s in range(m):
        chain = f"({combine_steps(chain, str(m) if s == 0 else f'h{s - 1}', f'e{s}', f'h{s}')})"
    return (
        f"{head}, sl AS ({slot}), wd AS (SELECT id, hash_table, {wide} FROM sl JOIN ch USING (f) GROUP BY id, hash_table), "
        f"bk AS MATERIALIZED (SELECT hash_table, h{m - 1} % {o.buckets} AS bucket, id FROM {chain})"
    )


def neighbours(k: int, pairs: str, name: str = "knn") -> str:
    """CTE of the k nearest of the pairs (q, c)."""
    return (
        f"d_{name} AS (SELECT q, c, {squared_distance('a.vec', 'b.vec')} AS d2 FROM ({pairs}) JOIN pts a ON a.id = q JOIN pts b ON b.id = c), "
        f"{name} AS (SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY d2, c)::INT AS rank, c AS neighbor_id, sqrt(d2) AS distance FROM d_{name} QUALIFY rank <= {k})"
    )


SELF_PAIRS = "SELECT DISTINCT x.id AS q, y.id AS c FROM bk x JOIN bk y USING (hash_table, bucket) WHERE x.id <> y.id"
ALL_PAIRS = "SELECT x.id AS q, y.id AS c FROM pts x, pts y WHERE x.id <> y.id"


def first_pairs() -> str:
    """CTE fp (hash_table, query_id, c): the first table in which a pair meets."""
    return "fp AS (SELECT min(x.hash_table) AS hash_table, x.id AS query_id, y.id AS c FROM bk x JOIN bk y USING (hash_table, bucket) WHERE x.id <> y.id GROUP BY x.id, y.id)"


def combine_u64(table: str, seed: str, value: str) -> str:
    """The 64-bit mixer in HUGEINT arithmetic modulo 2**64, read as signed."""
    m = "18446744073709551616::HUGEINT"
    wrap = lambda x: f"(({x}) % {m})"
    out = f"SELECT {seed}, {value}, {wrap(f'{seed}::HUGEINT + {hashing.GOLDEN_64}::HUGEINT + {value}::HUGEINT')} AS x0 FROM {table}"
    for i, (shift, factor) in enumerate(zip(hashing.SHIFTS_64, (hashing.MUL_64, hashing.MUL_64, 1), strict=True)):
        out = f"SELECT {seed}, {value}, {wrap(f'xor(x{i}, x{i} // {1 << shift}) * {factor}::HUGEINT')} AS x{i + 1} FROM ({out})"
    return f"SELECT {seed}, {value}, (CASE WHEN x3 >= 9223372036854775808::HUGEINT THEN x3 - {m} ELSE x3 END)::BIGINT AS mixed FROM ({out})"


def blobs(centres: list[list[float]], n: int, seed: int = 1) -> str:
    """Coordinates of the generated clouds (id, cluster, dim, x)."""
    u = lambda tag: f"((('0x' || substr(md5('{seed}|' || id || '|' || dim || '|{tag}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    table = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in c) + "]" for c in centres) + "]"
    return (
        f"SELECT id, cluster::INT AS cluster, dim::INT AS dim, round((({table}[cluster + 1])[dim + 1] + sqrt(-2 * ln({u('r')})) * cos(6.283185307179586::DOUBLE * {u('a')}))::FLOAT::DOUBLE, 3) AS x "
        f"FROM (SELECT i AS id, i % {len(centres)} AS cluster, d AS dim FROM range(0, {n}) t(i), range(0, {len(centres[0])}) s(d))"
    )
