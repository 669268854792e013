"""Exact nearest neighbours by inner product: one query, or a set of queries and a corpus in a grid of blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import vectors as V
from lodestone.functions.topk import Best

#: Queries of a block and values in it, at most; rows of the corpus in a cell, about; tasks that a grid is dealt to, at most; products that a task holds at once.
BLOCK_ROWS, BLOCK_VALUES, CELL_ROWS, MOST_TASKS, PRODUCTS = 4096, 4_000_000, 100_000, 20_000, 1_000_000


def nearest(corpus: DataFrame, query: Sequence[float], k: int = 10, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows with the largest inner product, ties by key, as (…, sim). Partial top-k, then one small merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return corpus.withColumn("sim", V.dot(F.col(vector), q)).orderBy(F.desc("sim"), key).limit(k)


def within(found: DataFrame, distance: float) -> DataFrame:
    """Of neighbours already found those within a distance of 1 minus similarity."""
    return found.where(1 - F.col("sim") <= distance)


def ranked(found: DataFrame, key: str = "id") -> DataFrame:
    """Neighbours with their rank, few enough for one task."""
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("sim"), key)))


def nearest_each(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "qid", key: str = "id", vector: str = "vector", block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(qid, key, sim, rank): for every query the k nearest rows, ties by key.

    Queries and corpus are dealt into blocks, and each two of them meet in a cell of a grid, which
    is one task's work: it holds the queries of its block and multiplies them with the corpus as that
    streams by, sorted by key, a few rows at once, keeping k hits of each query. What cells have kept is merged by one
    window whose limit also holds below its shuffle. Nothing is gathered on the driver but two
    counts, and a task holds one block of queries, whatever the size of either side.

    Null vectors, and those with a null component, match nothing; vectors of different length don't
    either. Equal rows of the queries are one query.
    """
    whole = lambda df, name: df.select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").where(~F.exists("v", lambda x: x.isNull()))
    asked, rows = whole(queries, qid).distinct(), whole(corpus, key)
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n // max(1, min(block_rows, BLOCK_VALUES // max(width, 1)))))
    parallel = corpus.sparkSession.sparkContext.defaultParallelism
    pieces = max(1, -(-rows.count() // cell_rows), -(-parallel // blocks))
    place = lambda count: F.pmod(F.xxhash64("name", "v"), F.lit(count)).cast("long")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    id_type, q_type = corpus.schema[key].dataType, queries.schema[qid].dataType
    # The hash of a query tells it from others of its id.
    left = asked.select(F.size("v").alias("n"), place(blocks).alias("block"), every(pieces).alias("piece"), F.lit(0).alias("side"), F.col("name").alias("q"), F.lit(None).cast(id_type).alias("c"), "v", F.xxhash64("name", "v").alias("h"))
    right = rows.select(F.size("v").alias("n"), every(blocks).alias("block"), place(pieces).alias("piece"), F.lit(1).alias("side"), F.lit(None).cast(q_type).alias("q"), F.col("name").alias("c"), "v", F.lit(None).cast("long").alias("h"))
    cell = ["n", "block", "piece"]
    named = left.unionByName(right).repartition(max(parallel, min(blocks * pieces, MOST_TASKS)), *cell).sortWithinPartitions(*cell, "side", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, held = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                row, value, score = best.held()
                hashes, ids = [h for hs, _, _ in held for h in hs], [i for _, ids, _ in held for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array([hashes[r] for r in row], pa.int64()), pa.array([ids[r] for r in row], schema[1]), pa.array(value.tolist(), schema[2]), pa.array(score)], names=["h", "q", "c", "sim"])

        for batch in batches:
            schema = [None, batch.schema.field("q").type, batch.schema.field("c").type]
            marks = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(axis=1))[0] + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(marks[a, :3]) != at:
                    yield from done()
                    at, best, held, matrix = tuple(marks[a, :3]), None, [], None
                vectors = part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(marks[a, 0]))
                if marks[a, 3] == 0:
                    held.append((part.column(7).to_pylist(), part.column(4).to_pylist(), vectors))
                elif held:
                    if best is None:
                        matrix = np.concatenate([m for _, _, m in held])
                        best = Best(len(matrix), k)
                    values = np.empty(b - a, object)
                    values[:] = part.column(5).to_pylist()
                    step = max(1, PRODUCTS // len(matrix))
                    for i in range(0, b - a, step):
                        best.add(matrix @ vectors[i : i + step].T, values[i : i + step])
        yield from done()

    found = named.select(*cell, "side", "q", "c", "v", "h").mapInArrow(run, T.StructType([T.StructField("h", T.LongType()), T.StructField("q", q_type), T.StructField("c", id_type), T.StructField("sim", T.DoubleType())]))
    best = W.partitionBy("h", "q").orderBy(F.desc("sim"), "c")
    ranked_ = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked_.select(F.col("q").alias(qid), F.col("c").alias(key), "sim", "rank")


def usable(corpus: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and not all zero."""
    return corpus.where(F.col(vector).isNotNull() & V.is_nonzero(F.col(vector)))
