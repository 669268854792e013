"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that is computed from its code point. An n-gram's
vector binds those of its letters, each rotated by its place, by multiplication; the vectors of all
n-grams of a text are bundled into the text's vector by addition, and those of a language's texts,
each at length one, into the language's prototype. A text belongs to the language whose prototype
has the largest cosine with its vector.

Texts are read whole: in lower case, with every run of other characters than letters as one gap. An
n-gram is counted first and bundled as often as it occurs. Vectors of n-grams are kept in a cache
of bounded size; texts are bundled some at a time, as one product of counts and vectors.

Prototypes are learnt from about ``ROWS`` texts of each language, picked by a hash of the id, so that
learning costs the same at any size; all others are only predicted.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text
where nothing could be learnt; ties go to the language that sorts first; rows without an id count
as held out; rows with a null language or without a letter teach nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stable_fraction, table

#: Components of a vector, letters of an n-gram, texts that teach a language, and the seed.
DIM, GRAM, ROWS, SEED = 1024, 3, 3000, 12
#: n-grams whose vectors are kept, and a quarter of those that are bundled at once.
CACHED, AT_ONCE = 16_384, 12_288
NONE = "und"
#: The remainder of an id's checksum that is held out.
FOLDS, HELD_OUT = 3, 1


# ----------------------------------------------------------------------- letters


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none; what has a longer lower case keeps its first letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def grams(text: str, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text's letters and gaps, as one number each, and how often each occurs; none without a letter."""
    own = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    own = np.concatenate([[0], own, [0]])
    own = own[np.append(True, (own[1:] != 0) | (own[:-1] != 0))]
    if len(own) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(max(1, len(own) - n + 1), np.int64)
    for i in range(n):
        code = (code << 21) | own[i : i + len(code)]
    code.sort()
    first = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
    return code[first], np.diff(np.append(first, len(code)))


# ----------------------------------------------------------------------- vectors


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of letters, as +1 and -1: bits of a mixed hash of the code point."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim // 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray, n: int = GRAM, dim: int = DIM) -> np.ndarray:
    """The vectors of n-grams: those of their letters, each rotated by its place from the end, multiplied."""
    out = np.ones((len(codes), dim), np.int8)
    for i in range(n):
        points, at = np.unique((codes >> (21 * i)) & 0x1FFFFF, return_inverse=True)
        out *= np.roll(letter_vectors(points, dim), i, axis=1)[at]
    return out


class Bundler:
    """Bundles texts; keeps the vectors of the n-grams seen last."""

    def __init__(self):
        self.codes, self.vectors = np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct n-grams."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            new = gram_vectors(codes[~known]).astype(np.float32)
            if len(self.codes) + len(new) > CACHED:
                own = np.empty((len(codes), DIM), np.float32)
                own[known], own[~known] = self.vectors[at[known]], new
                self.codes, self.vectors = codes, own
                return own
            place = np.searchsorted(self.codes, codes[~known])
            self.codes, self.vectors = np.insert(self.codes, place, codes[~known]), np.insert(self.vectors, place, new, axis=0)
            at = np.searchsorted(self.codes, codes)
        return self.vectors[at]

    def bundles(self, texts: Sequence[str | None]) -> np.ndarray:
        """The vector of each text at length one; zero for one without a letter."""
        out = np.zeros((len(texts), DIM), np.float32)
        held, size = [], 0
        for i, text in enumerate(texts):
            codes, counts = grams(text) if text else (np.zeros(0, np.int64),) * 2
            for cut in range(0, len(codes), AT_ONCE):
                held.append((i, codes[cut : cut + AT_ONCE], counts[cut : cut + AT_ONCE]))
                size += len(held[-1][1])
                if size >= 4 * AT_ONCE:
                    self._bundle(held, out)
                    held, size = [], 0
        if held:
            self._bundle(held, out)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)

    def _bundle(self, held: list[tuple[int, np.ndarray, np.ndarray]], out: np.ndarray) -> None:
        """Add counts times vectors to the rows of texts; a text's rows lie side by side."""
        codes, at = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
        first = held[0][0]
        counts = np.zeros((held[-1][0] - first + 1, len(codes)), np.float32)
        counts[np.repeat([i - first for i, _, _ in held], [len(c) for _, c, _ in held]), at] = np.concatenate([n for _, _, n in held])
        out[first : first + len(counts)] += counts @ self._vectors(codes)


@lru_cache(maxsize=1)
def bundler() -> Bundler:
    """One bundler for each Python worker."""
    return Bundler()


# ------------------------------------------------------------- learning, predicting


@dataclass
class Profiles:
    """Languages in order and their prototypes, each of length one."""

    names: list[str]
    prototypes: np.ndarray

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine with the prototype, from 0 to 1."""
        vectors = bundler().bundles(texts)
        if not self.names:
            return [NONE] * len(texts), np.zeros(len(texts))
        there = vectors.any(axis=1)
        cosines = vectors.astype(np.float64) @ self.prototypes.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return [self.names[b] if ok else NONE for b, ok in zip(best.tolist(), there.tolist(), strict=True)], np.where(there, score, 0.0)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> Profiles:
    """Prototypes from about so many rows of each language; what tasks have bundled is added up by language."""
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r[lang]: r["n"] for r in usable.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not totals:
        return Profiles([], np.zeros((0, DIM)))
    names = sorted(totals)
    share = F.get(F.array(*[F.lit(min(1.0, rows / totals[n])) for n in names]), F.array_position(F.array(*[F.lit(n) for n in names]), F.col(lang)).cast("int") - 1)
    some = usable.where(stable_fraction([F.col(key)], SEED) < share).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            own, vectors = np.array(batch.column(0).to_pylist(), object), bundler().bundles(batch.column(1).to_pylist())
            whole = np.rint(vectors * 2.0**20).astype(np.int64)  # in whole steps, so that the sum is the same in any order
            for name in set(own):
                sums[name] = sums.get(name, 0) + whole[own == name].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "v"])

    parts = some.mapInArrow(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    got = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()  # DIM numbers for each language
    sums = np.zeros((len(names), DIM))
    for r in got:
        sums[names.index(r["lang"]), r["i"]] = r["x"]
    there = sums.any(axis=1)
    return Profiles([n for n, ok in zip(names, there, strict=True) if ok], (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30))[there])


def predicted(df: DataFrame, profiles: Profiles, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The frame with the language of every row and its score."""
    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = profiles.predict(texts.tolist())
            yield pd.DataFrame({"lang": names, "score": scores})

    got = df.withColumn("_judged", judge(F.col(text).cast("string")))
    return got.select(*df.columns, F.col("_judged.lang").alias(to[0]), F.col("_judged.score").alias(to[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text", "lang"))
    profiles = fit(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), profiles).drop("text")
