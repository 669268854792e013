"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints; distinct fingerprints at most ``LIMIT`` bits apart are linked.
The bits are grouped so that correlated ones share a partition. If the partitions' thresholds add
up to LIMIT - partitions + 1, two linked fingerprints agree within the threshold of at least one of
them. Dynamic programming deals the thresholds out by the estimated candidates and probes of each
partition, counted over all fingerprints, for several numbers of partitions; the cheapest plan is
probed by an equi-join on the partition's (varied) bits and every candidate is verified there.

Buckets of thousands of fingerprints, such as those of a large group of near copies, would still
make all their pairs. Their members are linked through midpoints instead: two fingerprints are at
most four bits apart exactly if some value lies within two bits of both. Each member files itself
under its 2081 such values, no value can have more members than that, and each is linked with the
smallest one it meets. Cost is linear and no link is lost.

Defined results: a null text counts as empty; an empty text has fingerprint zero and links as any
other; repeated rows each give their row; rows without an id link like others but never name a
component that has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, connected_components, delete, free, shared_folder, table

BITS, LIMIT, SHINGLE, SEED = 64, 4, 4, 42
#: Shingles that are hashed at once.
BLOCK = 16_384
#: From so many fingerprints on, a bucket is linked through midpoints.
DENSE = 512
#: Cost of writing, sorting and reading one key, about a microsecond, in candidates verified.
KEY_COST = 30.0
#: Keys that a fingerprint may file and ask for in all partitions: each is a literal in the plan.
MOST_KEYS = 512


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a whole text given as UTF-8; bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        ends = starts[at + width : to + width] if n > 1 or len(words) >= width else [len(whole) + 1]
        hashes = b"".join([digest(whole[a : b - 1], SEED) for a, b in zip(starts[at:to], ends, strict=True)])
        ones += set_bits(np.frombuffer(hashes, np.uint8))
    return majority(ones, n)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes, given as bytes with the highest first, each bit is set."""
    return np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes as a signed number."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per row; fp is the fingerprint as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=[key, "fp"])

    return df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, f"{key} {kind}, fp long")


# ------------------------------------------------------------------ the plan


@dataclass(frozen=True)
class Part:
    """A partition: its bits (0 is the lowest) and the threshold it is probed with (-1: never)."""

    bits: tuple[int, ...]
    limit: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    def variants(self, radius: int) -> list[int]:
        return [signed(sum(1 << b for b in some)) for r in range(radius + 1) for some in combinations(self.bits, r)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def keys_of(width: int, limit: int) -> int:
    """Keys that a fingerprint files and asks for, together, in a partition."""
    ball = lambda r: sum(comb(width, i) for i in range(r + 1))
    return 0 if limit < 0 else ball(limit // 2) + ball(limit - limit // 2)


def bit_statistics(reps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = unpacked(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            both, n = both + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(both.ravel(), n).astype(np.int64)), pa.array(range(BITS * BITS + 1), pa.int32())], names=["x", "at"])

    rows = reps.select("fp").mapInArrow(run, "x long, at int").groupBy("at").agg(F.sum("x").alias("x")).collect()  # 4097 rows at any size
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["x"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def unpacked(fps: np.ndarray) -> np.ndarray:
    """Column b holds bit b, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped(correlation: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The bits in m groups of nearly equal size, each grown by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    strength = np.abs(correlation) - np.eye(BITS)
    for i in range(m):
        size = len(left) // (m - i)
        rest = sorted(left)
        group = [rest[int(np.argmax(strength[np.ix_(rest, rest)].max(axis=1)))]]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(strength[np.ix_(rest, group)].mean(axis=1)))])
        left -= set(group)
        groups.append(tuple(sorted(group)))
    return groups


def growth(rates: np.ndarray, limit: int) -> np.ndarray:
    """By how much pairs within 0, 1, ... differing bits outnumber equal ones, for independent bits."""
    odds = np.clip((1 - rates) / np.maximum(rates, 1e-9), 0, 1e9)
    poly = np.zeros(limit + 1)
    poly[0] = 1
    for o in odds:
        poly[1:] += o * poly[:-1].copy()
    return np.cumsum(poly)


def allocate(costs: list[np.ndarray], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of at least -1 that add up to total at the least cost; costs[i][t + 1] is the cost of t, infinite if t can't be had."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                at = c + cost[t + 1], (*chosen, t)
                if s + t not in new or at < new[s + t]:
                    new[s + t] = at
        best = new
    return best[total]


def plan(reps: DataFrame, limit: int = LIMIT) -> list[Part]:
    """The partitions and thresholds of the cheapest of several plans, estimated over all fingerprints.

    There are five partitions at most, each with ``MOST_KEYS`` keys at most. Keys are priced for one
    fingerprint at least, so that without any the plan with the fewest keys is taken.
    """
    n, both = bit_statistics(reps)
    mean = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    correlation = (both / max(n, 1) - np.outer(mean, mean)) / np.outer(sd, sd)
    same = mean**2 + (1 - mean) ** 2
    tried = {m: grouped(correlation, m) for m in range(2, min(limit, 4) + 2)}
    flat = [(m, i) for m, groups in tried.items() for i in range(m)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(Part(tried[m][i], 0).mask)).alias("v")) for k, (m, i) in enumerate(flat)]))
    counted = reps.select(keys.alias("x")).groupBy("x").count().groupBy("x.k").agg(F.sum((F.col("count") * (F.col("count") - 1) / 2).cast("double")).alias("pairs"))
    pairs = {flat[r["k"]]: r["pairs"] for r in counted.collect()}  # a row for each partition tried
    plans = []
    for m, groups in tried.items():
        costs = []
        for i, bits in enumerate(groups):
            at_zero = max(pairs.get((m, i), 0.0), n * n / 2 * float(np.prod(same[list(bits)])))
            keyed = np.array([keys_of(len(bits), t) for t in range(limit + 1)], float)
            pay = at_zero * growth(same[list(bits)], limit) + KEY_COST * max(n, 1) * keyed
            costs.append(np.append(0.0, np.where(keyed <= MOST_KEYS, pay, np.inf)))
        cost, limits = allocate(costs, limit - m + 1)
        plans.append((cost, [Part(b, t) for b, t in zip(groups, limits, strict=True)]))
    return min(plans, key=lambda x: x[0])[1]


# ----------------------------------------------------------------- the links


def _keys(parts: list[Part], probes: bool) -> Column:
    """An array of (part, key): what a fingerprint asks for if probes, else what it is filed under."""
    each = []
    for i, p in enumerate(parts):
        if p.limit >= 0:
            radius = p.limit - p.limit // 2 if probes else p.limit // 2
            own = F.col("fp").bitwiseAND(F.lit(p.mask))
            each += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(v)).alias("key")) for v in p.variants(radius)]
    return F.array(*each)


def _dealt(reps: DataFrame, parts: list[Part], dense: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is filed, what is asked for, and the keys under which so many are filed that their pairs aren't made."""
    filed = reps.select("fp", F.explode(_keys(parts, False)).alias("x")).select("fp", "x.*")
    asked = reps.select("fp", F.explode(_keys(parts, True)).alias("x")).select("fp", "x.*")
    return filed, asked, checkpoint(filed.groupBy("part", "key").count().where(F.col("count") >= dense).select("part", "key"))


def gap(a: str, b: str) -> Column:
    """In how many bits two fingerprints differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def candidates(reps: DataFrame, limit: int, dense: int = DENSE) -> DataFrame:
    """(a, b): fingerprints with the nearest smaller one within the limit, for a caller that verifies texts.

    Under a key that very many share, each is paired with the smallest there; whoever needs all
    pairs has to look on.
    """
    if reps.isEmpty():
        return reps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    parts = plan(reps, limit)
    filed, asked, crowded = _dealt(reps, parts, dense)
    pairs = None
    if not crowded.isEmpty():
        each = filed.unionByName(asked)
        # Only keys meet the crowded ones here; a join of their members would list these once more.
        least = checkpoint(each.groupBy("part", "key").agg(F.min("fp").alias("b")).join(crowded, ["part", "key"], "left_semi"))
        close = (F.col("fp") > F.col("b")) & (gap("fp", "b") <= limit)
        pairs = each.join(least, ["part", "key"]).where(close).select(F.col("fp").alias("a"), "b")
        filed, asked = (x.join(crowded, ["part", "key"], "left_anti") for x in (filed, asked))
    met = filed.withColumnRenamed("fp", "b").join(asked.withColumnRenamed("fp", "a"), ["part", "key"]).select("a", "b")
    near = (met if pairs is None else pairs.union(met)).where((F.col("a") > F.col("b")) & (gap("a", "b") <= limit))
    return near.groupBy("a").agg(F.min(F.struct(gap("a", "b").alias("gap"), "b")).alias("x")).select("a", "x.b")


def links(reps: DataFrame, parts: list[Part], limit: int = LIMIT, dense: int = DENSE) -> DataFrame:
    """(a, b): edges between fingerprints within the limit that join all that links join."""
    filed, asked, crowded = _dealt(reps, parts, dense)
    near = lambda a, b: gap(a, b) <= limit
    if crowded.isEmpty():
        through = None
    else:
        members = filed.unionByName(asked).join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
        half = limit // 2
        flips = F.array(*[F.lit(v) for v in Part(tuple(range(BITS)), 0).variants(half)])
        at = members.select("fp", F.explode(F.transform(flips, lambda v: F.col("fp").bitwiseXOR(v))).alias("mid"))
        through = at.withColumn("b", F.min("fp").over(W.partitionBy("mid"))).where("fp > b").select(F.col("fp").alias("a"), "b").distinct()
        if limit % 2:
            raise ValueError("midpoints need an even limit")
        filed, asked = (x.join(crowded, ["part", "key"], "left_anti") for x in (filed, asked))
    pairs = (
        filed.withColumnRenamed("fp", "a")
        .join(asked.withColumnRenamed("fp", "b"), ["part", "key"])
        .where((F.col("a") < F.col("b")) & near("a", "b"))
        .select("a", "b")
    )
    return pairs if through is None else pairs.union(through)


def components(fps: DataFrame, key: str = "doc_id", limit: int = LIMIT, dense: int = DENSE) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of (key, fp)."""
    reps = checkpoint(fps.groupBy("fp").agg(F.min(key).alias("least")))
    nodes = connected_components(links(reps, plan(reps, limit), limit, dense), "a", "b")
    placed = checkpoint(nodes.withColumnRenamed("node", "fp").join(reps, "fp"))
    named = checkpoint(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = placed.join(named, "root").select("fp", "root", "component_id")
    return reps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): one row per row of the input."""
    fps = checkpoint(fingerprints(df, key, text))
    return fps.join(checkpoint(components(fps, key)), "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", ("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are near copies by their five-word shingles one row stays, that of the smallest id.

    Fingerprints of these shingles are probed at a wider radius; what they find is verified by the
    exact similarity and completed (see shingles). A component none of whose rows has an id keeps the row whose text has the smallest hash; so do
    rows of one id. Of repeated rows, one stays.
    """
    none, key, text, row = free(docs, "_none", "_key", "_t", "_row")
    from lodestone.llm import shingles  # which builds on this module

    folder = f"{shared_folder(spark)}/shingles-{uuid.uuid4().hex}"
    rows = shingles.kept(shingles.filed(docs, "doc_id", "text"), folder)
    rooted = rows.select("key", "t", "h").join(shingles.components(rows, docs, folder), "h", "left")
    least = rooted.groupBy(F.coalesce("root", "h").alias("root")).agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("x"))
    wanted = checkpoint(least.select(F.col("x.none").alias(none), F.coalesce("x.key", F.lit(0)).alias(key), F.col("x.t").alias(text)))
    delete(spark, folder)
    own = docs.withColumns({none: F.col("doc_id").isNull(), key: F.coalesce("doc_id", F.lit(0)), text: F.xxhash64("text")})
    kept = own.join(wanted, [none, key, text], "left_semi")
    kept = kept.withColumn(row, F.row_number().over(W.partitionBy(none, key, text).orderBy(F.lit(0)))).where(F.col(row) == 1)
    return kept.select(*docs.columns)
