"""Near duplicates by the exact similarity of their shingles, for stages without a contract of their own.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least
0.8; near copies of near copies belong together. At that similarity SimHash fingerprints lie about
ten of 64 bits apart, some of them twenty, further than any plan of partitions can probe. So the work
is shared out:

1. SimHash finds most of them: fingerprints of the sets are probed by the generalised pigeonhole at
   ``RADIUS`` bits, each is compared with the nearest it meets, and the pair is verified on the sets.
2. What is left is found by prefix filtering, only between texts that aren't linked yet: in one order
   of all shingles, two similar sets share one of the first n - ceil(0.8 n) + 1 of either (n is a
   set's size). At the first one that they share, no more can be shared than what follows it in
   either, so a place where that is too little for the threshold makes no pair; nor does one where
   one of the last ``LAST`` shingles before it is shared, which was a place of the pair itself. Sets
   differ in no fewer shingles than the parities of their shingles' counts in ``CELLS`` cells do, so
   pairs whose parities differ too often for the threshold are no copies. First each set meets one hub under each of its shingles, the set with the fewest
   rarer ones, as the least edited of many copies has; that is linear and links most of what is
   left. Then all pairs of different components are taken, the nearest of two components first,
   and the others only if that didn't join them.

Sets are verified whole, as 64-bit hashes. The order puts common shingles last, by their counts over
all texts: a table of a fixed number of cells, in which a shingle has the class of its count, or that
of a more frequent one it shares the cell with. The order only decides how many pairs are looked at,
never which are found.

What stands between steps is written as tables: a step reads the columns it needs of them, and a
table of small files is read by few tasks, where a checkpoint has one for each partition again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.common import checkpoint, connected_components, delete, release, stored

WIDTH, SEED = 5, 42
#: The least similarity of near copies, as a fraction.
OF, PARTS = 4, 5
#: Bits within which fingerprints are probed, and members of a bucket from which only its smallest is probed.
RADIUS, CROWD = 8, 64
#: Cells of a set's parities, and the shingles before a place that are looked at for an earlier one.
CELLS, LAST = 256, 4
ODD = [f"odd{i}" for i in range(CELLS // 64)]
#: Blocks of the table of counts, cells of each, classes from a count to its double, and shingles that a task counts at once.
BLOCKS, PLACES, STEPS, CHUNK = 4096, 1024, 4, 1 << 21
#: Sets of a block in which pairs are verified.
SEATS = 256


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one as well."""
    words = text.lower().split()
    whole = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[width:] if len(words) >= width else [len(whole) + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends)], np.uint64).view(np.int64))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def name_of(own: np.ndarray) -> int:
    """A set's name: a hash of it."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def cells(own: np.ndarray) -> np.ndarray:
    """Each shingle's cell in the table of counts: the block is its first 12 bits, the place there 10 of its last 32."""
    bits = own.view(np.uint64)
    return ((bits >> 52) * PLACES + ((bits & 0xFFFFFFFF) >> 22)).astype(np.int64)


def prefix(own: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles that a similar set must share one of; classes has a number for each cell, the rarest first."""
    return own[np.lexsort((own, classes[cells(own)]))[: len(own) + (-OF * len(own) // PARTS) + 1]]


def parities(own: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each cell is odd, 64 cells to a number."""
    odd = np.bincount(own.view(np.uint64) % CELLS, minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counted(sets: Iterable[np.ndarray]) -> pa.RecordBatch:
    """(block, shingles, counts) of the sets: the last 32 bits of each block's shingles, and how many sets have each."""
    bits = np.concatenate([*sets]).view(np.uint64)
    found, counts = np.unique((bits >> 52 << 32) | (bits & 0xFFFFFFFF), return_counts=True)
    blocks, starts = np.unique(found >> 32, return_index=True)
    ends = [*starts[1:], len(found)]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), cut(found.astype("<u4")), cut(counts.astype("<u4"))], names=["block", "shingles", "counts"])


def _classes(shingles: list[bytes], counts: list[bytes]) -> bytes:
    """The classes of a block's cells, each that of its most frequent shingle; zero is a shingle of one set, or none."""
    own, n = np.frombuffer(b"".join(shingles), "<u4"), np.frombuffer(b"".join(counts), "<u4")
    order = np.argsort(own)
    own = own[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    of_all = np.add.reduceat(n[order].astype(np.int64), first)
    out = np.zeros(PLACES, np.uint8)
    np.maximum.at(out, own[first] >> 22, np.floor(STEPS * np.log2(of_all)).astype(np.uint8))
    return out.tobytes()


def common_shingles(df: DataFrame, text: str) -> np.ndarray:
    """The class of each cell by the counts of all shingles of all texts; copies that a task meets together count once.

    Shingles are dealt out by block, and counted there by 44 bits of their hashes: 32 and those of the block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for v in batch.column(0):
                own = shingles(v.as_py())
                name = name_of(own)
                if name not in held:
                    held[name], size = own, size + len(own)
                if size >= CHUNK:
                    yield _counted(held.values())
                    held, size = {}, 0
        if held:
            yield _counted(held.values())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda block, own: pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "classes": [_classes(*zip(*own, strict=True))]})
        at, own = None, []
        for batch in batches:
            for block, *x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at and own:
                    yield row(at, own)
                    own = []
                at = block
                own.append(x)
        if own:
            yield row(at, own)

    dealt = df.select(_text(text).alias("_text")).mapInArrow(count, "block int, shingles binary, counts binary").repartition("block").sortWithinPartitions("block")
    classes = np.zeros((BLOCKS, PLACES), np.uint8)
    for r in dealt.mapInArrow(judge, "block int, classes binary").collect():  # BLOCKS rows at most
        classes[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return classes.ravel()


def filed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t, h, n, least, fp, prefix, odd) of each row: the hash of its text, its set's name, size, least hash, fingerprint, prefix and parities."""
    classes = common_shingles(df, text)
    release(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(v.as_py()) for v in batch.column(2)]
            new = [
                pa.array([name_of(s) for s in own], pa.int64()),
                pa.array([len(s) for s in own], pa.int32()),
                pa.array([int(s[0]) for s in own], pa.int64()),
                pa.array([simhash.majority(simhash.set_bits(s.astype(">i8").view(np.uint8)), len(s)) for s in own], pa.int64()),
                pa.array([prefix(s, classes) for s in own], pa.list_(pa.int64())),
                pa.array([parities(s) for s in own], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["key", "t", "h", "n", "least", "fp", "prefix", "odd"])

    return df.select(F.col(key).alias("key"), F.xxhash64(text).alias("t"), _text(text).alias("_text")).mapInArrow(run, f"key {kind}, t long, h long, n int, least long, fp long, prefix array<long>, odd array<long>")


def _fit(a: str, b: str) -> Column:
    return OF * F.greatest(a, b) <= PARTS * F.least(a, b)


def kept(df: DataFrame, folder: str) -> DataFrame:
    """The frame as a table of its own in the folder."""
    return stored(df, f"{folder}/{uuid.uuid4().hex}")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, text: str, folder: str) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar, by the whole sets.

    Sets with the same least hash, as near copies mostly have, sit in blocks of about ``SEATS``;
    a pair is judged where the blocks of both meet, so that a set is sent once to each such place
    and not once for each of its pairs.
    """
    steps = f"{folder}/{uuid.uuid4().hex}"
    pairs = kept(pairs.distinct(), steps)
    if pairs.isEmpty():
        return pairs
    release(docs.sparkSession)  # what the pairs came from, before the texts are shuffled
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(reps.select("h", "t", F.col("least").alias("s")), "h")
    wanted = kept(wanted, steps)
    crowds = kept(wanted.groupBy("s").agg(F.ceil(F.count("*") / SEATS).alias("blocks")), steps)
    seated = kept(wanted.join(crowds, "s").select("h", F.xxhash64("s", F.pmod("h", F.col("blocks"))).alias("block")), steps)
    placed = pairs.join(seated.toDF("a", "ba"), "a").join(seated.toDF("b", "bb"), "b")
    placed = kept(placed.select("a", "b", F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("place")), steps)
    release(docs.sparkSession)
    members = placed.select("place", F.explode(F.array("a", "b")).alias("h")).distinct()
    # Texts are sent and not sets, which are larger and don't compress.
    own = docs.select(F.xxhash64(text).alias("t"), _text(text).alias("text")).join(wanted.select("t").distinct(), "t", "left_semi").dropDuplicates(["t"])
    seats = members.join(wanted.select("h", "t"), "h").join(own, "t").select("place", "h", F.lit(None).cast("long").alias("b"), "text")
    rows = seats.unionByName(placed.select("place", F.col("a").alias("h"), "b", F.lit(None).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, {}
        for batch in batches:
            left, right = [], []
            for at, h, b, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != place:
                    place, held = at, {}
                if b is None:
                    held[h] = shingles(content)
                elif _alike(held[h], held[b]):
                    left.append(h)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("place").sortWithinPartitions("place", F.asc_nulls_first("b"))
    judged = kept(dealt.mapInArrow(run, "a long, b long"), folder)
    delete(docs.sparkSession, steps)
    release(docs.sparkSession)
    return judged


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether i of s - i shingles are shared, s the size of both: i / (s - i) >= OF / PARTS."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return (OF + PARTS) * shared >= OF * len(both)


def found(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): each set with one whose fingerprint is near, by SimHash."""
    first = checkpoint(reps.groupBy("fp").agg(F.min("h").alias("first")))
    same = reps.join(first, "fp").where("h <> first").select(F.col("h").alias("a"), F.col("first").alias("b"))
    near = simhash.candidates(first.select("fp"), radius, CROWD)
    near = near.join(first.toDF("a", "ha"), "a").join(first.toDF("b", "hb"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return near.union(same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _rooted(frame: DataFrame, roots: DataFrame, h: str, root: str) -> DataFrame:
    """The frame with the component that the set in column h is in, itself if it isn't linked."""
    return frame.join(roots.toDF(h, "_root"), h, "left").withColumn(root, F.coalesce("_root", h)).drop("_root")


def merged(roots: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """(h, root) after the pairs (a, b) of sets are linked as well: only the components that they join are linked anew."""
    edges = _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb")
    new = kept(connected_components(edges, "ra", "rb").toDF("root", "_new"), folder)
    alone = new.join(roots.select(F.col("h").alias("root")), "root", "left_anti")
    old = roots.join(new, "root", "left").select("h", F.coalesce("_new", "root").alias("root"))
    return kept(old.union(alone.select("root", "_new")), folder)


def _places(reps: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """One row for each set and shingle of its prefix that sets of another component have there too.

    All prefixes are shuffled as bare shingles; the sets' numbers come to those rows that are left.
    """
    rooted = kept(_rooted(reps.select("h", "n", "fp", *[F.col("odd")[i].alias(o) for i, o in enumerate(ODD)]), roots, "h", "root"), folder)
    several = _several(reps.select("h", "prefix").join(rooted.select("h", "root"), "h").select("root", F.explode("prefix").alias("s")))
    left = kept(reps.select("h", F.posexplode("prefix").alias("i", "s")).join(several, "s", "left_semi"), folder)
    before = W.partitionBy("h").orderBy("i")
    left = left.withColumn("last", F.array_compact(F.array(*[F.lag("s", k).over(before) for k in range(1, LAST + 1)])))
    return kept(left.join(rooted, "h").withColumn("rest", F.col("n") - F.col("i")).drop("i"), folder)


def _several(at: DataFrame) -> DataFrame:
    """The shingles of more than one component."""
    return at.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")


def _may_be_copies() -> Column:
    """What two places x and y of one shingle have to meet if their sets are near copies of different components."""
    both = F.col("x.n") + F.col("y.n")
    enough = (OF + PARTS) * F.least("x.rest", "y.rest") >= OF * both
    differ = sum((simhash.gap(f"x.{o}", f"y.{o}") for o in ODD), F.lit(0))
    # Of both sizes together, at most (PARTS - OF) / (PARTS + OF) may be in one set alone.
    return (F.col("x.root") != F.col("y.root")) & _fit("x.n", "y.n") & enough & ((OF + PARTS) * differ <= (PARTS - OF) * both)


def _with_hubs(at: DataFrame, folder: str) -> DataFrame:
    """(a, b): each set with the hubs of its shingles, the sets with the smallest share of rarer ones."""
    hub = F.max_by(F.struct("h", "root", "n", "fp", "rest", *ODD), F.struct(F.col("rest") / F.col("n"), "h"))
    hubs = kept(at.groupBy("s").agg(hub.alias("hub")).select("s", "hub.*"), folder)
    met = at.alias("x").join(hubs.alias("y"), (F.col("x.s") == F.col("y.s")) & _may_be_copies())
    return met.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))


def _with_all(at: DataFrame) -> DataFrame:
    """(a, b, ra, rb, gap): each two sets that may be copies."""
    first = ~F.arrays_overlap("x.last", "y.last")
    met = at.alias("x").join(at.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.h") < F.col("y.h")) & _may_be_copies() & first)
    return met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"), simhash.gap("x.fp", "y.fp").alias("gap")).distinct()


def components(rows: DataFrame, docs: DataFrame, folder: str, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(h, root) of the sets of filed rows that have near copies; its tables stay in the folder, for the caller to delete."""
    reps = kept(rows.select("h", "t", "n", "least", "fp", "prefix", "odd").dropDuplicates(["h"]), folder)
    links = verified(found(reps, radius), reps, docs, text, folder)
    roots = kept(connected_components(links, "a", "b").toDF("h", "root"), folder)
    at = _places(reps, roots, folder)
    roots = merged(roots, verified(_with_hubs(at, folder), reps, docs, text, folder), folder)
    now = kept(_rooted(at.drop("root"), roots, "h", "root"), folder)
    pairs = kept(_with_all(kept(now.join(_several(now), "s", "left_semi"), folder)), folder)
    nearest = pairs.groupBy(F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi")).agg(F.min(F.struct("gap", "a", "b")).alias("x")).select("x.a", "x.b")
    nearest = kept(nearest, folder)
    more = verified(nearest, reps, docs, text, folder)
    if not more.isEmpty():
        roots = merged(roots, more, folder)
    left = _rooted(_rooted(pairs.select("a", "b"), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
    more = verified(left.join(nearest, ["a", "b"], "left_anti"), reps, docs, text, folder)
    return roots if more.isEmpty() else merged(roots, more, folder)
