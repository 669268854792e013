"""Embeddings of texts and pictures by pluggable models, batched by Arrow.

No model weights come with the engine. A model is a callable from a list of texts (or of pictures
as bytes) to a matrix, loaded once for each Python worker; the built-in ones hash n-grams of texts
and brightness of pictures, which is deterministic but carries no meaning beyond surface form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import images
from lodestone.schema import LOGO_DIM, TEXT_DIM


def hashed_ngrams(texts: list[str], dim: int = TEXT_DIM, n: int = 3) -> np.ndarray:
    """Signed counts of character n-grams, hashed."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in enumerate(texts):
        padded = f" {text.lower()} "
        for i in range(max(1, len(padded) - n + 1)):
            h = int.from_bytes(hashlib.blake2b(padded[i : i + n].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            out[row, h % dim] += 1 if h >> 63 else -1
    return out


def brightness(pictures: list[np.ndarray], dim: int = LOGO_DIM) -> np.ndarray:
    """Pictures shrunk to 16 by 32 cells of ink."""
    return np.stack([255 - images.resized(images.gray(p), 16, 32).ravel() for p in pictures]).astype(np.float32)[:, :dim]


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def text_embedding(c: Column, load: Callable[[], Callable] = lambda: hashed_ngrams, dim: int = TEXT_DIM) -> Column:
    """Unit vectors of texts; a null or empty text has the zero vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out = np.zeros((len(texts), dim), np.float32)
            there = [i for i, t in enumerate(texts) if t]
            if there:
                out[there] = _units(np.asarray(model([texts.iloc[i] for i in there]), np.float32))
            yield pd.Series(list(out))

    return run(c)


def image_embedding(c: Column, load: Callable[[], Callable] = lambda: brightness, decode: Callable = images.decode) -> Column:
    """Unit vectors of pictures; null where a picture can't be read."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for blobs in batches:
            read = [images.attempt(decode, b) for b in blobs]
            there = [i for i, p in enumerate(read) if p is not None]
            out: list = [None] * len(read)
            if there:
                for i, v in zip(there, _units(np.asarray(model([read[i] for i in there]), np.float32)), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return run(c)
