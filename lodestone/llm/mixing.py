"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / size-of-source times. The whole part is taken
outright; the fractions are rounded dependently: a document and its partner exchange probability,
in proportion to their sizes, in a random direction until one of them is settled, so the words
expected stay the same throughout. The largest open document of a group goes first and its partner
is all that are smaller, together, so what is left open in the end is small. A group leaves one open
document at most; those of 64 groups meet on the next level of the reduction tree, until each source
has one, which is rounded to the nearer side.

Groups are dealt out by a hash of the row and read as a sorted stream with two numbers held, so no
source, however large, meets in one task, and a rerun makes the same draws.

Defined results: a null or empty text has size 0, is taken outright by the whole part and adds no
words; rows with a null source form a source of their own, the last; repeated rows are rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, free, table

WEIGHTS, CAP, SEED = (1, 2, 3), 3.0, 8
#: Rows of a group on the first level; groups that meet on a further one.
GROUP, FAN_IN = 512, 64
#: Fractions nearer to a whole number than this are whole.
TINY = 1e-9

_ROW = "src long, g long, level int, doc_id string, size long, source_size long, target double, k long, copies int, p double"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, src, source_size, n, target) for each source; one row each, so the windows are short.

    Shares by weight fill up like water: in order of cap to weight, the level that a source would
    get if all before it were capped rises as long as they should be, and falls after that; so the
    highest of these levels is the one at which no source is above its cap.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    by_cap = W.orderBy("ratio", "src")
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    listed = sums.withColumn("src", F.row_number().over(by_name).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("w", weight).withColumn("cap", cap * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    share = F.max("level").over(everything) * F.col("w")
    return listed.withColumn("level", level).select("source", "src", "source_size", "n", F.least("cap", share).alias("target"))


def _stream(seed: int):
    """The first level: every open document of a group has the same probability, so that of all that
    are still to come is one number, and a sorted stream with the group's words is enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rng, q, rest = None, None, 0.0, 0
        for frame in frames:
            copies, left = frame["copies"].to_numpy().copy(), np.full(len(frame), np.nan)
            keys = zip(frame["src"].tolist(), frame["g"].tolist(), strict=True)
            for i, (own, p, size, words) in enumerate(zip(keys, frame["p"].tolist(), frame["size"].tolist(), frame["words"].tolist(), strict=True)):
                if own != group:
                    group, rng, q, rest = own, np.random.default_rng([seed, 0, *own]), p, words
                if size == 0 or q < TINY or q > 1 - TINY:
                    copies[i] += (q if size else p) > 0.5
                    rest -= size
                    continue
                rest -= size
                up, down = min((1 - q) * size, q * rest), min(q * size, (1 - q) * rest)  # words that can move to or from it
                if up + down <= 0:
                    left[i] = q
                    continue
                moved = up if rng.random() * (up + down) < down else -down
                own_p, q = q + moved / size, q - moved / rest
                if TINY < own_p < 1 - TINY:
                    left[i] = own_p
                else:
                    copies[i] += own_p > 0.5
            yield frame.drop(columns="words").assign(copies=copies, p=left)

    return run


def _meet(seed: int):
    """A further level: the few open documents of up to FAN_IN groups, each with its own probability."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "k"], ascending=[False, True], kind="stable")
        p, size = frame["p"].to_numpy().copy(), frame["size"].to_numpy().astype(float)
        rng = np.random.default_rng([seed, *(int(frame[c].iloc[0]) for c in ("level", "src", "g"))])
        for i in range(len(p) - 1):
            if p[i] < TINY or p[i] > 1 - TINY:
                continue
            rest, words = p[i + 1 :], size[i + 1 :]
            held, room = float(rest @ words), float((1 - rest) @ words)
            up, down = min((1 - p[i]) * size[i], held), min(p[i] * size[i], room)
            if up + down <= 0:
                break
            if rng.random() * (up + down) < down:
                p[i] += up / size[i]
                rest *= 1 - up / held if held else 1.0
            else:
                p[i] -= down / size[i]
                rest += (1 - rest) * (down / room if room else 0.0)
        settled = (p < TINY) | (p > 1 - TINY)
        frame["copies"] += (settled & (p > 0.5)).astype(frame["copies"].dtype)
        frame["p"] = np.where(settled, np.nan, p)
        return frame

    return run


def rounded(df: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, k) for each row; k identifies the row's content."""
    kind = df.schema["doc_id"].dataType.simpleString()
    sized = checkpoint(df.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("k")))
    plan = checkpoint(targets(sized, weights, cap))
    widest = plan.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + TINY)
    rows = (
        sized.join(plan, sized["source"].eqNullSafe(plan["source"]))
        .select(
            "src",
            F.pmod(F.xxhash64(F.lit(seed), "k"), F.ceil(F.col("n") / GROUP)).alias("g"),
            F.lit(0).alias("level"), F.col("doc_id").cast("string"), "size", "source_size", "target", "k",
            whole.cast("int").alias("copies"),
            F.greatest(rate - whole, F.lit(0.0)).alias("p"),
        )
    )
    groups, level, done = -(-widest // GROUP), 0, None
    while True:
        if level == 0:
            dealt = rows.withColumn("words", F.sum("size").over(W.partitionBy("src", "g"))).sortWithinPartitions("src", "g", F.desc("size"), "k", "doc_id")
            got = dealt.mapInPandas(_stream(seed), _ROW)
        else:
            got = rows.groupBy("src", "g").applyInPandas(_meet(seed), _ROW)
        out = checkpoint(got.withColumn("p", F.nanvl("p", F.lit(None).cast("double"))))
        if groups <= 1:
            last = out.withColumn("copies", F.col("copies") + F.coalesce(F.round("p"), F.lit(0)).cast("int"))
            return (last if done is None else done.unionByName(last)).select(F.col("doc_id").cast(kind), "size", "source_size", "target", "copies", "k")
        settled = out.where("p is null")
        done = settled if done is None else done.unionByName(settled)
        level, groups = level + 1, -(-groups // FAN_IN)
        rows = out.where("p is not null").withColumn("g", F.floor(F.col("g") / FAN_IN)).withColumn("level", F.lit(level))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rounded(table(spark, sf_dir, "documents", ("doc_id", "source", "text")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; of repeated rows the first ones are taken more often."""
    key, row, n, *least = free(docs, "k", "_row", "_n", *[f"_{c}" for c in range(1, int(CAP) + 1)])
    taken = rounded(docs.select("doc_id", "source", "text")).groupBy(F.col("k").alias(key)).agg(*[F.count_if(F.col("copies") >= c).alias(name) for c, name in enumerate(least, 1)])
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text")).withColumn(row, F.row_number().over(W.partitionBy(key).orderBy(key)))
    copies = sum((F.when(F.col(row) <= F.col(name), 1).otherwise(0) for name in least), F.lit(0))
    return keyed.join(taken, key).withColumn(n, copies).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
