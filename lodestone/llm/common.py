"""Helpers shared by the corpus operators: reading, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is wherever a contract counts words: runs without these six characters.
SPACE = r"[\x20\x09-\x0D]+"


#: Edges of which a task makes stars at once.
EDGES = 1 << 18
#: Rows of an Arrow batch: with texts of a few kilobytes, some megabytes.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch if they are more; whole texts go through Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """One input table; only the named columns, so that others that clash with ours never matter."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over all cores where a table is so small that its files make fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between steps, shared by all executors.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder and any other session one beside its warehouse, which is shared as well.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        own = tempfile.mkdtemp(prefix="ckpt-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or own)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles of steps that are cut off; it learns which ones from the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def apart(df: DataFrame, column: str) -> DataFrame:
    """An aggregate dealt out by a hash of its key: evenly, and so that a join on the key shuffles both sides and can split hot keys."""
    return df.repartition(F.xxhash64(F.lit("apart"), column))


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame written as a table and read again: for loops, where Spark would carry each round's constraints on."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the frame's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stable_fraction(parts: Iterable[Column], seed: int) -> Column:
    """A number in [0, 1) that depends only on the given columns and the seed."""
    bits = F.xxhash64(F.lit(seed), *parts)
    return F.shiftrightunsigned(bits, 11).cast("double") * F.lit(2.0**-53)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of these edges that aren't the smallest of their component, which is the root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = a[open_ := root[a] != root[b]], b[open_]
    below = root < np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def contracted(links: DataFrame, path: str, tasks: int = 0) -> DataFrame:
    """Edges (u, v) of longs stored anew, of which every task replaces those it has, ``EDGES`` at a time, by stars of the same components.

    They are packed into so many tasks, or else stay in theirs and are made distinct.
    """
    most = EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if size >= most or batch is None and size:
                u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(u, v)], names=["u", "v"])
                held, size = [], 0

    if tasks:
        return stored(links.coalesce(tasks).mapInArrow(run, "u long, v long"), path)
    return stored(links.mapInArrow(run, "u long, v long").distinct(), path)


def _shape(links: DataFrame) -> tuple[bool, int]:
    """Whether every node is a root or has one edge, to a root; and how many edges there are."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.to").alias("lo"), F.max("e.to").alias("hi"), F.max(F.col("e.to").isNull()).alias("top"), F.count("e.to").alias("n"))
    odd = (F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & F.col("top"))
    found = nodes.agg(F.max(F.coalesce(odd, F.lit(False))), F.sum("n")).first()
    return not found[0], found[1] or 0


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node in an edge, a long; root is the smallest node of the component.

    Edges are packed ``EDGES`` to a task, which makes stars of them. So few edges take one round of
    one small task, and what the driver keeps of jobs and tasks doesn't follow the partitions. More
    edges are as many tasks, and between these large-star and small-star steps alternate, which keep
    the number of edges from growing and end after few rounds also on long chains; it is done when
    all edges form stars. A node with very many neighbours is reduced before any shuffle by the
    aggregate, whose result is dealt apart, so that the join with it has a shuffle of its own on
    either side and the adaptive join can split the node. Nothing is gathered on the driver but one
    row per round. No edges give no rows; loops are ignored.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    given = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    links, i = contracted(given, f"{folder}/0"), 0
    release(spark)
    done, n = _shape(links)
    while not done:
        i += 1
        tasks = -(-n // EDGES)
        before = [f"{i - 1}"]
        links = contracted(links, f"{folder}/{i}", tasks)
        if tasks > 1:
            before += [f"{i}", f"{i}-large"]
            both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = apart(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")
            large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), f"{folder}/{i}-large")
            smaller = apart(large.groupBy("u").agg(F.min("v").alias("m")), "u")
            parts = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
            i += 1
            links = stored(large.join(smaller, "u").select(parts.alias("e")).select("e.u", "e.v").where("u > v").distinct(), f"{folder}/{i}")
        for old in before:
            delete(spark, f"{folder}/{old}")
        release(spark)
        done, n = _shape(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
