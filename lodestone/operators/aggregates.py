"""Aggregations: first of each key, best of each group, top groups as arrays, lines of words, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in a given order; reduced before the shuffle, so a frequent key costs no more."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def best_of_each(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The row of each key with the largest values of by, in that order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def top_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank; a limit goes below the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def as_arrays(top: DataFrame, keys: Sequence[str], columns: Sequence[str], short: int, name: str = "matches") -> DataFrame:
    """Ranked rows of each key as arrays of structs: all of them, and the first few; keys without rows give none."""
    packed = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    bare = F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return top.groupBy(*keys).agg(packed.alias("_all")).select(*keys, F.slice(bare, 1, short).alias(name), bare.alias(f"all_{name}"))


def lines_of(words: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """(…, y, line): words at the same height, rounded to a tenth, joined from left to right."""
    placed = words.withColumn("y", F.round("top", 1))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    return placed.groupBy(*keys, "y").agg(F.array_join(texts, " ").alias("line"))


def widest_runs(df: DataFrame, keys: Sequence[str], at: str, flag: Column) -> DataFrame:
    """(…, start, length) of the longest run of set flags in each key, the first of equally long ones: gaps and islands."""
    seq = W.partitionBy(*keys).orderBy(at)
    run = df.withColumn("_f", flag).withColumn("_g", F.row_number().over(seq) - F.sum(F.col("_f").cast("int")).over(seq))
    islands = run.where("_f").groupBy(*keys, "_g").agg(F.min(at).alias("start"), F.count("*").alias("length"))
    return best_of_each(islands.drop("_g"), keys, [F.col("length"), -F.col("start")])


def progress(done: Column, total: Column) -> Column:
    """Percent of a job that is done, rounded down."""
    return F.coalesce(F.floor(F.try_divide(done * 100, total)).cast("int"), F.lit(0))
