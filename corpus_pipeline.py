"""The corpus pipeline: from raw documents to digests of encoded training text.

Each stage reads all that its predecessor kept and returns the columns of documents; the last one
returns digests of the ids. Null and empty texts, repeated rows, missing ids, empty tables and
further columns are treated as each stage's operator states it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, pii, quality, simhash
from lodestone.llm.common import delete, shared_folder, table
from lodestone.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage, with the package sent to the executors before it is planned."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality", _shipped(quality.stage)),
    ("near_duplicates", _shipped(simhash.stage)),
    ("personal_data", _shipped(pii.stage)),
    ("mixing", _shipped(mixing.stage)),
    ("encoding", _shipped(bpe.stage)),
]

#: Compression, linking and encoding are beyond SQL; the tests hold run() against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    A stage's folder goes once the next one is written; that of the last but one holds the rows that
    the result is computed from, and is left to whoever reads the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
