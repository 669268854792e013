"""Documents read page by page: a page that can't be read loses itself only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.schema import WORDS

#: Pages that are read from one copy of a document's bytes.
PAGES = 32
_NAMES = [f.name for f in WORDS if f.name not in ("doc_id", "page")]
_KINDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WORDS if f.name != "doc_id")


def page_words(documents: DataFrame, count: Callable[[bytes], int], read: Callable[[bytes, int], Iterable[dict]], start_page: int = 1, pages: int = PAGES) -> tuple[DataFrame, DataFrame]:
    """The words of all pages from start_page on, and (doc_id, page, error) of what could not be read.

    count says how many pages a document's bytes have, read gives the words of one page as dicts of
    the words schema without doc_id and page; either may raise anything. Documents (path, content)
    are divided into runs of pages, each of which is a row of its own for a table function, so that a
    long document is many tasks' work. A document whose pages can't be counted is one error without a
    page; one without content has no pages.
    """

    @F.pandas_udf("n int, error string")
    def counted(contents: pd.Series) -> pd.DataFrame:
        found = []
        for content in contents:
            try:
                found.append((0 if content is None else int(count(bytes(content))), None))
            except Exception as e:  # readers may raise anything; the document is reported
                found.append((0, str(e)))
        return pd.DataFrame(found, columns=["n", "error"])

    @F.udtf(returnType=f"{_KINDS}, error string")
    class Words:
        def eval(self, content: bytes, first: int, last: int) -> Iterator[tuple]:
            for page in range(first, last + 1):
                try:
                    rows = [(page, *(word[n] for n in _NAMES), None) for word in read(bytes(content), page)]
                except Exception as e:  # the page is reported, the others stay
                    rows = [(page, *[None] * len(_NAMES), str(e))]
                yield from rows

    known = documents.select(F.col("path").alias("doc_id"), "content", counted("content").alias("_pages"))
    whole = known.where("_pages.error is null and _pages.n >= " + str(start_page))
    runs = whole.withColumn("_first", F.explode(F.sequence(F.lit(start_page), F.col("_pages.n"), F.lit(pages)))).withColumn("_last", F.least(F.col("_first") + pages - 1, F.col("_pages.n")))
    dealt = runs.select("doc_id", "content", "_first", "_last").repartition("doc_id", "_first")
    both = dealt.lateralJoin(Words(F.col("content").outer(), F.col("_first").outer(), F.col("_last").outer())).select("doc_id", "page", *_NAMES, "error")
    unread = known.where("_pages.error is not null").select("doc_id", F.lit(None).cast("int").alias("page"), F.col("_pages.error").alias("error"))
    return both.where("error is null").drop("error"), both.where("error is not null").select("doc_id", "page", "error").unionByName(unread)
