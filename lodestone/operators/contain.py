"""Which texts hold which others: a set of passages against all texts, without joining them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import similarity as S
from lodestone.functions import text as X

#: Characters of the passages that one automaton holds, and pieces that the texts are dealt into where passages take more than one.
BLOCK_CHARS, PIECES = 16_000_000, 64


class Finder:
    """A block of passages (id, normalised text), and which of them a text holds or is held by."""

    def __init__(self, rows: list[tuple]):
        self.ids: dict[str, list] = {}
        for i, s in rows:
            self.ids.setdefault(s, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for s in self.ids:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self.passages = list(self.ids)
        self.whole, self.longest = " ".join(self.passages), max(map(len, self.passages), default=0)
        self.starts = list(accumulate((len(s) + 1 for s in self.passages), initial=0))

    def around(self, text: str) -> Iterator[str]:
        """The passages that hold a text, found by its places in all of them joined."""
        at = self.whole.find(text)
        while at >= 0:
            i = bisect_right(self.starts, at) - 1
            yield self.passages[i]
            at = self.whole.find(text, self.starts[i + 1])

    def matches(self, text: str) -> Iterator[tuple]:
        """(id, score) of the passages that a text holds, equals or is held by."""
        found = {x for _, x in self.automaton.iter(text)} if self.ids else set()
        if len(text) < self.longest:
            found.update(self.around(text))
        return ((i, 1.0 if x == text else S.CONTAINED) for x in found for i in self.ids[x])


def literal_matches(passages: DataFrame, texts: DataFrame, passage_id: str, text_id: str, passage: str = "text", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(passage_id, text_id, score): pairs whose normalised texts are equal (1) or of which one holds the other.

    An automaton finds all passages that a text holds in one pass over it, and a short text is looked
    up in the passages joined together. Empty ones match nothing. Passages that fit into one block
    are sent to where the texts lie. More are dealt into blocks and the texts into pieces, which meet
    in the cells of a grid; a task builds the automaton of one block at a time and lets texts stream by.
    """
    normal = lambda df, key, c: df.select(F.col(key).alias("id"), X.normalized(F.col(c)).alias("s")).where("s <> ''")
    p, t = normal(passages, passage_id, passage), normal(texts, text_id, text)
    total = p.agg(F.coalesce(F.sum(F.char_length("s")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    p_type, t_type = passages.schema[passage_id].dataType, texts.schema[text_id].dataType
    kinds = [to_arrow_type(p_type), to_arrow_type(t_type), pa.float64()]
    shape = f"p {p_type.simpleString()}, t {t_type.simpleString()}, score double"

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["p", "t", "score"])

    if blocks == 1:
        rows = [(r["id"], r["s"]) for r in p.collect()]  # block_chars characters at most

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(rows)
            for batch in batches:
                yield batch_of([(i, key, score) for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, score in finder.matches(s)])

        found = t.mapInArrow(search, shape)
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        place = lambda n: F.pmod(F.xxhash64("id", "s"), F.lit(n)).cast("long")
        left = p.select(place(blocks).alias("block"), every(PIECES).alias("piece"), F.lit(0).alias("side"), F.col("id").alias("p"), F.lit(None).cast(t_type).alias("t"), "s")
        right = t.select(every(blocks).alias("block"), place(PIECES).alias("piece"), F.lit(1).alias("side"), F.lit(None).cast(p_type).alias("p"), F.col("id").alias("t"), "s")
        dealt = left.unionByName(right).repartition("block", "piece").sortWithinPartitions("block", "piece", "side")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, finder = None, [], None
            for batch in batches:
                out = []
                for block, piece, side, i, key, s in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                    if (block, piece) != cell:
                        cell, held, finder = (block, piece), [], None
                    if side == 0:
                        held.append((i, s))
                    else:
                        finder = finder or Finder(held)
                        out += [(i, key, score) for i, score in finder.matches(s)]
                yield batch_of(out)

        found = dealt.mapInArrow(meet, shape)
    return found.select(F.col("p").alias(passage_id), F.col("t").alias(text_id), "score")
