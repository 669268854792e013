"""Quality classifier by compression with class dictionaries.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut
into pieces of ``PIECE`` bytes, each compressed with either dictionary; how many bytes the good one
saves over the bad one, taken over the whole text and normalised by the compressed size and by the
text's own size, goes through a logistic calibration to a score. Pieces keep a long text from
becoming its own dictionary.

The dictionaries and the calibration are fitted on a bounded sample of labelled rows: at most
``ROWS`` of each label, those with the smallest hashes of their ids, with ``PIECES`` evenly spaced
pieces of each text for the dictionaries and whole texts for the calibration. Classes weigh as often
as they are among all labelled rows. Only the text enters a score.

Defined results: null and empty texts have no difference and get the score of zero difference;
labels that are null, or not 0 or 1, aren't used; of an id's several texts one is learned from; a row without an id is never held out; repeated
rows each give their row; if either label is missing, every score is the share of label 1 (0.5
without any); an empty table gives no rows; other columns are ignored (query) or kept (stage).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, free, table

PIECE, LEVEL, DICTIONARY = 512, 3, 49_152
ROWS, PIECES, SEED = 4_000, 16, 6
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
#: Weight of the squared coefficients in the calibration.
RIDGE = 1e-2


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


@dataclass
class Model:
    """Dictionaries as bytes, and the calibration; share alone if there is no contrast to learn."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float = 0.5

    def scorer(self):
        if not self.good:
            return lambda texts: np.full(len(texts), self.share)
        sizes = measure(self.good, self.bad)
        return lambda texts: self.calibrated(np.array([sizes(t) for t in texts], float).reshape(len(texts), 2))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design((x - self.mean) / self.scale) @ self.weights, -35, 35)))


def measure(good: bytes, bad: bytes):
    """A function from a text's bytes to the two normalised size differences."""

    def compressor(content: bytes):
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdCompressionDict(content, dict_type=kind)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    by_good, by_bad = compressor(good), compressor(bad)

    def sizes(text: bytes) -> tuple[float, float]:
        g = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            g += len(by_good(piece))
            b += len(by_bad(piece))
        return ((b - g) / (b + g), (b - g) / len(text)) if text else (0.0, 0.0)

    return sizes


def design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    a, b = z[:, 0], z[:, 1]
    return np.column_stack([np.ones(len(z)), a, b, a * a, a * b, b * b])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, halved until the loss falls."""
    beta = np.zeros(x.shape[1])
    penalty = RIDGE * w.sum() / 100 * np.eye(x.shape[1])

    def loss(b):
        m = x @ b
        return float(w @ (np.logaddexp(0, m) - y * m) + b @ penalty @ b / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (w * (p - y)) + penalty @ beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), gradient)
        t, now = 1.0, loss(beta)
        while t > 1e-6 and loss(beta - t * step) > now:
            t /= 2
        beta = beta - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return beta


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, _t, _y) of at most ROWS labelled documents of each label, one row for an id, and how many there are of each.

    An id that repeats with different texts gives the one of the smallest hash, picked where the rows
    lie, so that however often an id repeats, one row of it reaches the model.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").where(~held_out(F.col("_id")))
    totals = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = [usable.where(F.col("_y") == y).dropDuplicates(["_id"]).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(ROWS) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])  # at most 2 * ROWS ids, so it may be broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_t")).where("length(_t) > 0").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))
    return checkpoint(one.select("doc_id", "_t", "_y")), totals


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that aren't held out."""
    rows, totals = sample(docs, labels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n = -(-len(text) // PIECE)
                out.append(sorted(text[at * PIECE : (at + 1) * PIECE] for at in {n * i // PIECES for i in range(PIECES)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "y", "pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()  # 2 * ROWS rows at most, of PIECES pieces
    by = {0: [], 1: []}
    for r in sorted(rows.mapInArrow(cut, f"doc_id {kind}, y int, pieces array<binary>").collect(), key=lambda r: (r["y"], str(r["doc_id"]))):
        by[r["y"]] += map(bytes, r["pieces"])
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    if not by[0] or not by[1]:
        return Model(b"", b"", np.zeros(2), np.ones(2), np.zeros(6), share)
    good, bad = dictionary(by[1]), dictionary(by[0])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = measure(good, bad)
        for batch in batches:
            got = np.array([sizes(t) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, 2)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["y", "a", "b"])

    seen = np.array(sorted(tuple(r) for r in rows.mapInArrow(measured, "y int, a double, b double").collect()), float)
    y, x = seen[:, 0], seen[:, 1:]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    return Model(good, bad, mean, scale, logistic(design((x - mean) / scale), y, weight), share)


def scored(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """The frame with a score for every row."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for texts in batches:
            yield pd.Series(own([t or b"" for t in texts]), dtype="float64")

    return docs.withColumn(to, score(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    got = scored(docs, fit(docs, table(spark, sf_dir, "labels", ("doc_id", "quality"))))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", ("doc_id", "quality")))
    (score,) = free(docs, "score")
    return scored(docs, model, to=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)
