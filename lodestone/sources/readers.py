"""Sources: a table in a database, documents and pictures as files, and layout words from either."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.schema import WORDS


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over all cores where a table is so small that its files make fewer tasks; for costly functions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows of an Arrow batch where each row is a text or a picture.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch if they are more: a Python worker holds whole batches, decoded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read by ranges of a numeric key where its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, is_pdf, content) of the files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.lower("path").endswith(".pdf").alias("is_pdf"), "content")


def layout_words(documents: DataFrame, read: Callable[[bytes], Iterator[dict]], start_page: int = 1) -> tuple[DataFrame, DataFrame]:
    """Words of all pages from start_page on, and the documents that could not be read, with the reason.

    read is a layout reader: from a document's bytes to dicts of the words schema without doc_id.
    None comes with the engine, since reading PDF takes a library that isn't there.
    """
    names = [f.name for f in WORDS if f.name != "doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [w for w in read(bytes(content)) if w["page"] >= start_page]
                    out = pd.DataFrame(rows, columns=names).assign(doc_id=path, error=None)
                except Exception as e:  # readers may raise anything; the document is reported
                    out = pd.DataFrame([{n: None for n in names} | {"doc_id": path, "error": str(e)}])
                yield out[["doc_id", *names, "error"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WORDS)
    both = documents.select("path", "content").mapInPandas(run, f"{kinds}, error string")
    return both.where("error is null").drop("error"), both.where("error is not null").select("doc_id", "error")


def plain_pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, text) of plain texts whose pages are separated by form feeds."""
    return documents.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f", -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)
