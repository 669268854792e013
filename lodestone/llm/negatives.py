"""Hard negatives for contrastive training, by blocked dense products.

Anchors go out in waves of bounded size, each broadcast to all tasks; a task multiplies the wave,
block by block, with the batches of candidates where these lie, in float64, which is exact for
integers below 2^53. It keeps the first few rows of each anchor, and these short lists are all that
is shuffled and merged. The first pass over the candidates finds each anchor's positives, which are
few and so come back to the driver; their scores span the windows of the second pass, which finds
the negatives. A wave's result is written to the shared folder before the next wave begins, so
neither the plan nor the driver grows with the number of waves.

Work is anchors times rows, as the task asks; no row is left out and nothing is sampled.

Defined results: rows with a null id or label, a null vector or any null or non-finite component
take no part. Vectors of different length have no score with one another, two of length zero have
score 0. Repeated rows are rows of their own among positives and negatives; equal anchor rows (id,
label and vector) are one anchor, and rows of one id that differ are several. Scores are whole
numbers; one beyond 2^53 either way counts as 2^53. An empty table, or one without anchors, gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import shared_folder, stored, table

#: Positives of an anchor, negatives of each positive, and the window of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Anchors of a wave and values in it, at most; anchors of a block.
WAVE_ROWS, WAVE_VALUES, BLOCK = 16_384, 4_000_000, 1024
#: Whole numbers up to here are exact as float64.
EXACT = 2**53
#: Steps of a unit when components are made whole.
STEPS = 256

_NO_ID = np.iinfo(np.int64).max


class Best:
    """For each of n rows the first k of the hits seen so far, by score and then by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), _NO_ID)

    @property
    def least(self) -> np.ndarray:
        """The score below which a row takes no hit."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        better = (scores > self.scores[rows, -1]) | (ids < self.ids[rows, -1])
        rows, scores, ids = rows[better], scores[better], ids[better]
        if not len(rows):
            return
        own = np.unique(rows)
        rows, scores, ids = np.concatenate([rows, np.repeat(own, self.k)]), np.concatenate([scores, self.scores[own].ravel()]), np.concatenate([ids, self.ids[own].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.scores[rows[kept], place[kept]], self.ids[rows[kept], place[kept]] = scores[kept], ids[kept]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers, exact up to EXACT and no larger."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -EXACT, EXACT).astype(np.float64)


@dataclass
class Wave:
    """Anchors: ids, labels, and for each length of vector the places of those that have it and their matrix."""

    ids: np.ndarray
    labels: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: pa.Table) -> Wave:
        rows = rows.combine_chunks()
        return cls(rows["id"].to_numpy(), rows["label"].to_numpy(), dict(_by_length(rows["v"])))


def _by_length(vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(length, (places, matrix)) for each length of vector that occurs."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0) if vectors.num_chunks else pa.array([], pa.list_(pa.float64()))
    lengths = np.diff(vectors.offsets.to_numpy())
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        part = vectors if len(at) == len(lengths) else vectors.take(pa.array(at))
        yield int(n), (at, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(n)))


def _met(wave: Wave, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of a block of anchors, ids, whether labels are equal, scores) of a batch (id, label, v) with every block."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for length, (at, rows) in _by_length(batch.column(2)):
        if length in wave.by_length:
            places, anchors = wave.by_length[length]
            for cut in range(0, len(places), BLOCK):
                block = places[cut : cut + BLOCK]
                yield block, ids[at], wave.labels[block][:, None] == labels[at][None, :], products(anchors[cut : cut + BLOCK], rows)


def _emitted(best: Best, **columns: np.ndarray) -> pa.RecordBatch:
    """What is held, as (row, columns of that row, id, score)."""
    row, place = np.nonzero(best.ids != _NO_ID)
    made = {"row": row} | {c: v[row] for c, v in columns.items()} | {"id": best.ids[row, place], "score": best.scores[row, place].astype(np.int64)}
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in made.items()})


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k hits of each row, with their rank; the limit also holds below the shuffle."""
    order = W.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, wave: Wave, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, id, score) of the first rows of each anchor's label but the anchor itself."""
    sent = rows.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, best = sent.value, Best(len(sent.value.ids), most + 1)  # one more, as an anchor meets itself
        for batch in batches:
            for block, ids, same, scores in _met(wave, batch):
                r, c = np.nonzero(same & (scores >= best.least[block][:, None]))
                best.add(block[r], scores[r, c], ids[c])
        yield _emitted(best)

    found = _first(rows.mapInArrow(run, "row long, id long, score long"), most + 1).toArrow()  # most + 1 rows an anchor
    sent.destroy()
    at, ids, scores = (found[c].to_numpy().astype(np.int64) for c in ("row", "id", "score"))
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    own = np.empty(len(wave.ids))
    for places, anchors in wave.by_length.values():
        own[places] = [products(a[None], a[None])[0, 0] for a in anchors]
    itself = np.nonzero((ids == wave.ids[at]) & (scores == own[at]))[0]
    others = np.delete(np.arange(len(at)), itself[np.unique(at[itself], return_index=True)[1]])
    place = np.arange(len(others)) - np.searchsorted(at[others], at[others])
    kept = others[place < most]
    return at[kept], ids[kept], scores[kept]


def _negatives(rows: DataFrame, wave: Wave, positives: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score, rank) of a wave; reads the rows when it is run."""
    at, ids, scores = positives
    # Each anchor's windows side by side; those that it lacks are empty.
    place = np.arange(len(at)) - np.searchsorted(at, at)
    wide = int(place.max(initial=-1)) + 1
    lo, hi, row = np.full((len(wave.ids), wide), np.inf), np.full((len(wave.ids), wide), -np.inf), np.zeros((len(wave.ids), wide), np.int64)
    lo[at, place], hi[at, place], row[at, place] = -(-low * scores // 100), high * scores // 100, np.arange(len(at))
    sent = rows.sparkSession.sparkContext.broadcast((wave, lo, hi, row, wave.ids[at], ids, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, lo, hi, row, anchor_ids, positive_ids, positive_scores = sent.value
        best = Best(len(positive_ids), k)
        for batch in batches:
            for block, ids, same, scores in _met(wave, batch):
                for w in range(lo.shape[1]):
                    rows = row[block, w]
                    least = np.where(lo[block, w] <= hi[block, w], np.maximum(lo[block, w], best.least[rows]), np.inf)
                    r, c = np.nonzero((scores >= least[:, None]) & (scores <= hi[block, w][:, None]) & ~same)
                    best.add(rows[r], scores[r, c], ids[c])
        yield _emitted(best, anchor_id=anchor_ids, positive_id=positive_ids, positive_score=positive_scores)

    if not len(at):
        rows = rows.where("false")
    found = _first(rows.mapInArrow(run, "row long, anchor_id long, positive_id long, positive_score long, id long, score long"), k)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Vectors hold whole numbers. An anchor's positives are the first other rows of its label by inner
    product; a positive's negatives are the first rows of other labels whose score lies from low to
    high hundredths of the positive's. Ties go by the smaller id.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~F.exists(v, bad)).withColumn("_is_anchor", is_anchor)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"), "_is_anchor")
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    anchors = stored(rows.where("_is_anchor").select("id", "label", "v").distinct(), f"{folder}/anchors")
    n, values = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    waves = max(1, -(-n // WAVE_ROWS), -(-values // WAVE_VALUES))
    rows = rows.drop("_is_anchor")
    for i in range(waves):
        wave = Wave.of(anchors.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(waves)) == i).toArrow())  # a wave, which has a bounded size
        _negatives(rows, wave, _positives(rows, wave, positives), negatives, low, high).write.parquet(f"{folder}/wave={i}")
    return spark.read.parquet(*[f"{folder}/wave={i}" for i in range(waves)])


def whole(df: DataFrame, vector: str = "embedding", steps: int = STEPS) -> DataFrame:
    """The frame with each component x of the vector as floor(steps * x); null and non-finite ones stay, so that they can be told."""
    scaled = lambda x: x * F.lit(float(steps))
    made = lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(F.floor(scaled(x)).cast("double"))
    return df.withColumn(vector, F.transform(F.col(vector).cast("array<double>"), made))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector among all of them; each seventh counts under the next label."""
    rows = table(spark, sf_dir, "embeddings", ("vec_id", "embedding", "label"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(whole(moved), F.col("vec_id") % 50 == 0)


#: The query in SQL, by all pairs, for ids that are not repeated and vectors of one length.
SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
