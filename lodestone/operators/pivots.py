"""An index for exact nearest neighbours of one query: partitions around pivots, most of which a query can skip.

Each vector goes to the pivot that it makes the smallest angle with, and there to a ring of angles.
By the triangle inequality of angles, a vector in a ring from a to b around a pivot that the query
makes the angle t with is no nearer to the query than max(0, t - b, a - t). With the largest length
in the ring that bounds every inner product in it. A search reads the rings with the largest bounds
first, and in the end those whose bound reaches its k-th best product; no other row can be among the
first k, so the result is that of a scan.

Pivots are chosen in a bounded sample, each as far as can be from those before it; that decides how
much a search reads, never what it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import vectors as V
from lodestone.operators import knn as K

#: Pivots, rings around each, vectors that pivots are chosen from, and tasks that write a ring.
PIVOTS, RINGS, SAMPLE, SALTS = 64, 16, 4096, 8
#: The part of vectors that every search reads, as they have no angle.
ODD = -1
#: What bounds are raised by, for the rounding of products.
SLACK = 1e-9


def chosen(sample: np.ndarray, count: int) -> np.ndarray:
    """At most so many of the unit vectors, each the farthest from those chosen before."""
    at, nearest, out = 0, np.full(len(sample), -2.0), []
    for _ in range(min(count, len(sample))):
        out.append(sample[at])
        nearest = np.maximum(nearest, sample @ sample[at])
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-12:
            break
    return np.array(out).reshape(len(out), sample.shape[1])


def placed(vectors: np.ndarray, pivots: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part, angle and length of each vector."""
    length = np.linalg.norm(vectors, axis=1)
    there = np.isfinite(length) & (length > 0)
    unit = np.divide(vectors, length[:, None], out=np.zeros_like(vectors), where=there[:, None])
    cosine = unit @ pivots.T
    pivot = cosine.argmax(axis=1)
    angle = np.arccos(np.clip(cosine[np.arange(len(unit)), pivot], -1, 1))
    ring = np.minimum((angle / (math.pi / 2) * rings).astype(np.int64), rings - 1)
    return np.where(there, pivot * rings + ring, ODD).astype(np.int32), angle, length


@dataclass(frozen=True)
class Part:
    """What a ring holds: rows, their angles and their lengths."""

    part: int
    rows: int
    angles: tuple[float, float]
    lengths: tuple[float, float]


@dataclass(frozen=True)
class Index:
    """An index in a folder: rows by part, the pivots and what each part holds."""

    spark: SparkSession
    path: str
    vector: str
    schema: T.StructType
    pivots: np.ndarray
    rings: int
    parts: tuple[Part, ...]

    @classmethod
    def build(cls, rows: DataFrame, path: str, vector: str = "vector", pivots: int = PIVOTS, rings: int = RINGS) -> Index:
        """Write an index of the rows that have a vector to a new folder; all vectors have one length. No column may be named part."""
        there = rows.where(F.col(vector).isNotNull())
        v = F.col(vector).cast("array<double>")
        finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        some = there.where(finite & V.is_nonzero(v)).select(v.alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE).collect()  # SAMPLE rows at most
        sample = np.array([r["v"] for r in some], np.float64).reshape(len(some), -1 if some else 1)
        own = chosen(sample / np.linalg.norm(sample, axis=1, keepdims=True), pivots) if some else sample
        plain = F.when(finite, v)

        @F.pandas_udf("part int, angle double, length double")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vectors in batches:
                part, angle, length = np.full(len(vectors), ODD, np.int32), np.zeros(len(vectors)), np.zeros(len(vectors))
                at = np.array([i for i, x in enumerate(vectors) if x is not None], np.int64)
                if len(at) and len(own):
                    part[at], angle[at], length[at] = placed(np.array([vectors[i] for i in at], np.float64), own, rings)
                yield pd.DataFrame({"part": part, "angle": angle, "length": length})

        found = there.withColumn("_at", place(plain)).select(*rows.columns, "_at.*")
        dealt = found.repartition("part", F.pmod(F.xxhash64(vector), F.lit(SALTS)))
        dealt.write.partitionBy("part").parquet(f"{path}/rows")
        spark, schema = rows.sparkSession, T.StructType([*rows.schema, *(T.StructField(c, T.DoubleType()) for c in ("angle", "length")), T.StructField("part", T.IntegerType())])
        held = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("angle", "length") for f in (F.min, F.max)])
        parts = [Part(r["part"], r["rows"], (r["min_angle"], r["max_angle"]), (r["min_length"], r["max_length"])) for r in held.collect()]  # a row for each ring
        return cls(spark, path, vector, schema, own, rings, tuple(sorted(parts, key=lambda p: p.part)))

    def rows(self, parts: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        every = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return (every if parts is None else every.where(F.col("part").isin(list(parts)))).drop("angle", "length", "part")

    def bound(self, query: np.ndarray, part: Part) -> float:
        """What no inner product with a row of the part exceeds."""
        if part.part == ODD:
            return math.inf
        size = float(np.linalg.norm(query))
        if not size:
            return 0.0
        t = math.acos(max(-1.0, min(1.0, float(query @ self.pivots[part.part // self.rings]) / size)))
        c = math.cos(min(math.pi, max(0.0, t - part.angles[1], part.angles[0] - t)))
        return size * (c * (part.lengths[1] if c > 0 else part.lengths[0]) + SLACK * part.lengths[1])

    def needed(self, query: Sequence[float], k: int) -> list[int]:
        """The parts that can hold one of the k nearest rows: read from the largest bound on, twice as many each time."""
        q = np.array(query, np.float64)
        bounds = sorted(((self.bound(q, p), p) for p in self.parts), key=lambda x: (-x[0], x[1].part))
        best, at, step = [], 0, 1
        while at < len(bounds) and (len(best) < k or bounds[at][0] >= best[-1]):
            to, rows = at, 0
            while to < len(bounds) and (to - at < step or rows < k):
                rows, to = rows + bounds[to][1].rows, to + 1
            sims = self.rows([p.part for _, p in bounds[at:to]]).select(V.dot(F.col(self.vector), F.array(*[F.lit(float(x)) for x in q])).alias("sim"))
            best = sorted(best + [r["sim"] for r in sims.where("sim is not null").orderBy(F.desc("sim")).limit(k).collect()], reverse=True)[:k]  # k numbers
            at, step = to, 2 * step
        least = best[-1] if len(best) == k else -math.inf
        return [p.part for b, p in bounds if not b < least]

    def nearest(self, query: Sequence[float], k: int = 10, key: str = "id") -> DataFrame:
        """The k rows with the largest inner product, ties by key, as (…, sim)."""
        return K.nearest(self.rows(self.needed(query, k)), query, k, key, self.vector)
