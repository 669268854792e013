"""Sinks: CSV, JSON lines, JSON arrays in a column, and one file for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X


def csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a header; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def json_array(df: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """For each key one JSON array of its rows, in the order of the columns; groups must be small, such as top matches."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias(column))


def report_html(matches: DataFrame) -> DataFrame:
    """(qid, html): a report's rows for each query, tier by tier, as a fragment of HTML."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in ("tier", "label", "serial", "text_percent", "img_percent")], F.lit("</tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("tier", "rank", row.alias("row")))), lambda x: x["row"])
    return matches.groupBy("qid").agg(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def file_for_each(df: DataFrame, name: str, content: str, write: Callable[[str, bytes], None], suffix: str = ".png", key: str = "id", width: int = 30) -> DataFrame:
    """(file, bytes): write a binary column to files named by id and a safe name, from the executors.

    write takes a file name and bytes and puts them into a store that all executors reach.
    """

    @F.pandas_udf("long")
    def put(names, blobs):
        for n, b in zip(names, blobs, strict=True):
            write(n, bytes(b))
        return blobs.map(len)

    there = df.where(F.col(content).isNotNull())
    named = there.select(F.concat(F.col(key).cast("string"), F.lit("_"), X.file_safe(X.first_filled(F.col(name), default="no_name"), width), F.lit(suffix)).alias("file"), F.col(content).alias("_b"))
    return named.select("file", put("file", "_b").alias("bytes"))
