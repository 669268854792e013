"""From the words of a page to records: lines, blocks between markers, the lines of each, its fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import records as R
from lodestone.functions import text as X
from lodestone.operators import aggregates as A
from lodestone.operators import joins as J
from lodestone.operators import segment as S

PAGE = ["doc_id", "page"]
#: Heights that blocks are binned by, as exponents of two: from the least height on.
BLOCK_SIZES = (8, 10)
# Margins of a block around its markers, and the least height of one.
AFTER_AGENT, BEFORE_CLASS, TOP_MARGIN, BELOW_AGENT, BOTTOM_MARGIN, LEAST_HEIGHT = 25, 120, 50, 15, 60, 100


def blocks(words: DataFrame) -> DataFrame:
    """(doc_id, page, class_y, bx0, by0, bx1, by1): a block for every line that is a class header alone.

    It reaches from below the agent line before it to that after it, or to margins of the page.
    """
    sized = words.groupBy(*PAGE).agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    lines = A.lines_of(words)
    heads = lines.where(F.col("line").rlike(f"(?i){X.CLASS_LINE}")).select(*PAGE, "y", F.lit(1).alias("one"))
    agents = lines.where(F.upper(F.trim("line")).startswith("AGENT")).select(*PAGE, "y", F.col("y").alias("agent_y"))
    placed = J.previous_and_next(heads, agents, PAGE, "y", "agent_y", part_rows=None).join(sized.hint("merge"), PAGE)  # pages are as many as words are, in Spark's estimate few
    above = F.when(F.coalesce("previous", F.lit(0.0)) != 0, F.col("previous") + AFTER_AGENT).otherwise(F.greatest(F.col("y") - BEFORE_CLASS, F.lit(float(TOP_MARGIN))))
    below = F.when(F.coalesce("next", F.lit(0.0)) != 0, F.col("next") + BELOW_AGENT).otherwise(F.col("page_h") - BOTTOM_MARGIN)
    found = placed.select(*PAGE, F.col("y").alias("class_y"), F.lit(0.0).alias("bx0"), above.alias("by0"), F.col("page_w").alias("bx1"), below.alias("by1"))
    return found.where(F.col("by1") - F.col("by0") > LEAST_HEIGHT)


def block_lines(words: DataFrame, found: DataFrame) -> DataFrame:
    """(…, class_y, lines): the trimmed, non-blank lines of the words wholly inside each block."""
    within = J.inside(words, found, PAGE, sizes=BLOCK_SIZES)
    lines = A.lines_of(within, (*PAGE, "class_y")).withColumn("line", X.stripped(F.col("line"))).where(F.col("line") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda x: x["line"])
    return lines.groupBy(*PAGE, "class_y").agg(ordered.alias("lines"))


def records(words: DataFrame, start_page: int = 1) -> DataFrame:
    """A record for each block that has a serial number, from the words of pages from start_page on."""
    wanted = words.where(F.col("page") >= start_page)
    found = R.with_block_fields(block_lines(wanted, blocks(wanted)))
    return found.where("serial_number is not null").select(*PAGE, "class_y", *R.RECORD)


def page_status(words: DataFrame, found: DataFrame, start_page: int = 1) -> DataFrame:
    """(doc_id, page, records, percent): how far a document is when each page is done."""
    pages = words.where(F.col("page") >= start_page).select(*PAGE).distinct()
    counted = pages.join(found.groupBy(*PAGE).agg(F.count("*").alias("records")), PAGE, "left").fillna(0, ["records"])
    seq = W.partitionBy("doc_id")
    return counted.withColumn("percent", A.progress(F.row_number().over(seq.orderBy("page")), F.count("*").over(seq)))


def entry_records(pages: DataFrame, compat: bool = False) -> DataFrame:
    """Records of plain page texts: segmented, parsed, those without a serial dropped, of equal serials the first kept."""
    parsed = R.with_entry_fields(S.entries(pages, compat=compat)).where("serial_number <> ''")
    ordered = parsed.select(F.struct("doc_id", "page", "entry").alias("at"), *R.ENTRY)
    return A.first_of_each(ordered, ["serial_number"], "at")


def hit_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """Records of whole texts by serial and context, of equal serials the first kept."""
    found = R.with_context_fields(R.with_hits(texts.select("doc_id", text), text))
    return A.first_of_each(found.select(F.struct("doc_id", "n").alias("at"), *R.ENTRY), ["serial_number"], "at")
