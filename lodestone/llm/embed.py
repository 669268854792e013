"""Near-duplicate embeddings by shared keys and a pairwise collision count over projections.

Every vector is projected on many random directions, in blocks of an orthonormal basis each. Sorted
by size, the largest projection of a block says which way the vector points; the directions that
come first in ``k`` blocks are the vector's key in a table. Vectors that share a key in one of the
tables are compared there by collision counting: a block of them is sorted along each of further
projections, a window centred on each vector is a run of that order, a pair's count is in how many
windows the other one falls, and pairs whose count reaches a bound are verified by cosine in double
precision. Window and bound are set so that a pair exactly at the threshold passes with the wanted
recall, as is the number of tables; the probabilities are measured on random pairs at the threshold.

Windows over all vectors would hold a fixed share of all pairs; the tables make them sparse, so the
work grows as a small power above the input and not as its square. n vectors of one key still cost
n^2 counts, and that many links have to be counted where they are near copies. A pair is judged in the first
table where it meets and only there. Links are not written out as pairs: a block of vectors emits
counts for each vector, and of its links a forest that connects the same vectors.

A key shared by thousands of vectors is cut into blocks; each pair of blocks is compared once, by
the task that holds both. Nothing is capped.

Defined results: null, zero and empty vectors and those with null or non-finite components link
with nothing; vectors of different length don't link; rows with the same vector are linked with one
another and count as other vectors, repeats of an id too; a row without an id links but is no
component's name if others have one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import apart, checkpoint, connected_components, table

THRESHOLD = 0.95
#: Wanted chance that a pair at the threshold shares a key in some table, and passes the count.
TABLE_RECALL, COUNT_RECALL = 0.9995, 0.99999
#: Windows that are counted, and half their width in standard deviations at the threshold.
WINDOWS, WIDTH = 64, 2.0
SEED = 5
#: Vectors of a block, and open pairs from which a block is sorted along its projections.
BLOCK, FEW = 1024, 4096


@dataclass(frozen=True)
class Plan:
    """How many tables of keys from how many blocks each, the windows' half width and the bound on the count."""

    dim: int
    k: int
    tables: int
    half: float
    bound: int


@lru_cache(maxsize=64)
def basis(dim: int, block: int) -> np.ndarray:
    """A random orthonormal basis."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, block]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """The unit directions of the windows."""
    g = np.random.default_rng([SEED, dim]).standard_normal((dim, WINDOWS))
    return g / np.linalg.norm(g, axis=0)


def first(x: np.ndarray, block: int) -> np.ndarray:
    """Which of the 2 * dim signed directions of a block a vector points along most."""
    p = x @ basis(x.shape[1], block)
    at = np.abs(p).argmax(axis=1)
    return 2 * at + (p[np.arange(len(p)), at] > 0)


@lru_cache(maxsize=64)
def plan(dim: int, n: int, threshold: float = THRESHOLD) -> Plan:
    """Enough blocks in a key that few of n random vectors share one, and tables for the wanted recall."""
    rng = np.random.default_rng([SEED, dim, 1])
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * np.divide(away, norm, out=np.zeros_like(away), where=norm > 0)
    met = min(0.999, float(np.mean([(first(x, b) == first(y, b)).mean() for b in range(4)])))
    k = max(1, math.ceil(math.log(max(n, 2)) / math.log(max(2 * dim, 2))))
    tables = max(1, math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - met**k)))
    gaps = np.abs((x - y) @ directions(dim))
    half = WIDTH * float(np.sqrt((gaps**2).mean())) + 1e-12
    inside = min(1 - 1e-9, float((gaps <= half).mean()))
    bound, tail = WINDOWS, inside**WINDOWS
    while bound > 1 and tail < COUNT_RECALL:
        bound -= 1
        tail += math.comb(WINDOWS, bound) * inside**bound * (1 - inside) ** (WINDOWS - bound)
    return Plan(dim, k, tables, half, bound)


def keys(x: np.ndarray, p: Plan) -> np.ndarray:
    """One integer for each vector and table."""
    out = np.empty((len(x), p.tables), np.int64)
    for t in range(p.tables):
        key = np.zeros(len(x), np.int64)
        for i in range(p.k):
            key = key * (2 * p.dim) + first(x, t * p.k + i)
        out[:, t] = key
    return out


def units(column: pa.Array) -> np.ndarray:
    rows = np.array([v.as_py() for v in column], np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def classes(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with (key, c), c a hash of a usable vector or null; and one row (c, vector, dim, n, least) for each."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = df.select(key, F.when(usable, v).alias("_v")).withColumn("c", F.when(F.col("_v").isNotNull(), F.xxhash64("_v")))
    reps = rows.where("c is not null").groupBy("c", "_v").agg(F.count("*").alias("n"), F.min(key).alias("least")).withColumn("dim", F.size("_v"))
    return rows.select(key, "c"), reps


def collisions(za: np.ndarray, zb: np.ndarray, half: float, orders: np.ndarray) -> np.ndarray:
    """In how many windows centred on each row of za each row of zb falls; orders sorts zb along each projection."""
    counts = np.zeros((len(za), len(zb)), np.uint8)
    kind = np.uint16 if len(zb) < 2**16 else np.uint32
    rank = np.empty(len(zb), kind)
    for t in range(za.shape[1]):
        rank[orders[:, t]] = np.arange(len(zb), dtype=kind)
        line = zb[orders[:, t], t]
        first, behind = (np.searchsorted(line, za[:, t] + side, side=way).astype(kind) for side, way in ((-half, "left"), (half, "right")))
        counts += rank[None, :] - first[:, None] < (behind - first)[:, None]  # unsigned: ranks before the window are far behind it
    return counts


def _compare(a, b, same: bool, table_at: int, p: Plan, threshold: float):
    """Links between two blocks that first meet in this table: indices into a and b.

    Where few pairs of a block are open, as under a key of few vectors, each is held against the
    windows by itself, which is the same count.
    """
    pairs_a, pairs_b, orders = [], [], None
    for at in range(0, len(a["x"]), 256):
        xa, ka, za = a["x"][at : at + 256], a["keys"][at : at + 256], a["z"][at : at + 256]
        open_ = np.ones((len(xa), len(b["x"])), bool)
        if same:
            open_ &= np.arange(at, at + len(xa))[:, None] < np.arange(len(b["x"]))[None, :]
        for t in range(table_at):
            open_ &= ka[:, t, None] != b["keys"][None, :, t]
        few = np.count_nonzero(open_) <= max(FEW, open_.size // 8)
        if not few:
            orders = np.argsort(b["z"], axis=0, kind="stable") if orders is None else orders
            open_ &= collisions(za, b["z"], p.half, orders) >= p.bound
        i, j = np.nonzero(open_)
        for cut in range(0, len(i), 200_000):
            ii, jj = i[cut : cut + 200_000], j[cut : cut + 200_000]
            if few:
                passed = (np.abs(za[ii] - b["z"][jj]) <= p.half).sum(axis=1) >= p.bound
                ii, jj = ii[passed], jj[passed]
            cosine = np.einsum("ij,ij->i", xa[ii], b["x"][jj])
            linked = cosine >= threshold
            pairs_a.append(ii[linked] + at)
            pairs_b.append(jj[linked])
    none = np.zeros(0, np.int64)
    return np.concatenate(pairs_a or [none]), np.concatenate(pairs_b or [none])


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, fewer than there are vectors."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[rx] = ry
            out.append((int(ids[x]), int(ids[y])))
    return out


def links(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(c, n, other): how many vectors a class is linked with (other null), and edges of forests (n null)."""
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    plans = {d: plan(d, 1 << max(1, (n - 1).bit_length()), threshold) for d, n in sizes.items()}

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist(), np.int64)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(keys(units(part.column(2)), plans[d])), pa.list_(pa.int64()))], names=["c", "dim", "keys"])

    filed = checkpoint(reps.select("c", "dim", "_v").mapInArrow(file, "c long, dim int, keys array<long>"))
    met = filed.select("c", "dim", F.posexplode("keys").alias("t", "key"))
    shared = checkpoint(met.groupBy("dim", "t", "key").agg(F.count("*").alias("members")).where("members > 1"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    seats = met.join(shared, ["dim", "t", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c", "t"), F.col("blocks")).cast("int"))
    # Block i meets every block j >= i in the task (i, j).
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    seated = seats.select("c", "dim", "t", "key", "own", F.explode(pairs).alias("m")).select("c", "dim", "t", "key", "own", "m.*")
    vectors = reps.select("c", F.col("_v").alias("v"), "n").join(filed.select("c", "keys"), "c")
    dealt = seated.join(vectors, "c").repartition("dim", "t", "key", "i", "j").sortWithinPartitions("dim", "t", "key", "i", "j", "own")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def done():
            d, t, _, i, j = group
            p = plans[d]
            sides = [[r for r in held if r[0] == side] for side in ((i,) if i == j else (i, j))]
            made = []
            for side in sides:
                x = np.array([r[2] for r in side], np.float64).reshape(len(side), d)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                made.append({"ids": np.array([r[1] for r in side], np.int64), "n": np.array([r[3] for r in side], np.int64), "keys": np.array([r[4] for r in side], np.int64).reshape(len(side), p.tables), "x": x, "z": x @ directions(d)})
            a, b = made[0], made[-1]
            if not len(a["ids"]) or not len(b["ids"]):
                return
            ia, ib = _compare(a, b, i == j, t, p, threshold)
            if not len(ia):
                return
            both = a["ids"] if i == j else np.concatenate([a["ids"], b["ids"]])
            shift = 0 if i == j else len(a["ids"])
            other = np.bincount(ia, weights=b["n"][ib], minlength=len(both)) + np.bincount(ib + shift, weights=a["n"][ia], minlength=len(both))
            for at in np.nonzero(other)[0]:
                yield int(both[at]), int(other[at]), None
            for x, y in _forest(both, ia, ib + shift):
                yield x, None, y

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["c", "n", "other"])

        for batch in batches:
            rows = []
            for c, d, t, key, own, i, j, v, n, ks in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if (d, t, key, i, j) != group:
                    if len(held) > 1:
                        rows += done()
                    group, held = (d, t, key, i, j), []
                held.append((own, c, v, n, ks))
            if rows:
                yield batch_of(rows)
        if len(held) > 1 and (rows := list(done())):
            yield batch_of(rows)

    columns = dealt.select("c", "dim", "t", "key", "own", "i", "j", "v", "n", "keys")
    return columns.mapInArrow(judge, "c long, n long, other long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of the input."""
    rows, reps = classes(df, key, vector)
    rows, reps = checkpoint(rows), checkpoint(reps)
    found = checkpoint(links(reps, threshold))
    counts = found.where("n is not null").groupBy("c").agg(F.sum("n").alias("more"))
    nodes = connected_components(found.where("other is not null"), "c", "other").withColumnsRenamed({"node": "c", "root": "r"})
    # Cut off and dealt apart, so that the joins with a large component and a frequent vector can be split.
    placed = checkpoint(reps.select("c", "n", "least").join(nodes, "c", "left").withColumn("r", F.coalesce("r", "c")))
    named = apart(placed.groupBy("r").agg(F.min("least").alias("component_id")), "r")
    known = placed.join(named, "r").join(counts, "c", "left").select("c", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    joined = rows.join(checkpoint(known), "c", "left").select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.when(F.col("c").isNull(), F.col(key))).alias("component_id"))
    return joined.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", ("vec_id", "embedding")))


#: The query in SQL, by all pairs, for ids that are not repeated.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id"""
