"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in a corpus.

The tokens of tokenizer B are laid out as a static index of byte intervals, sorted by their ends. A
stabbing query for each token of tokenizer A, two bisections, lists the tokens of B that it overlaps.
A gap between two tokens of B that no token of A spans is a border between groups; within a group
every token of A is linked with every one of B.

Neither tokenizer has a token that reaches over a space that follows a character which is no white
space (checked when they are loaded, else a text is one segment). So a text falls into segments
there that are tokenized and aligned each by itself, all new ones of a batch at once, and remembered
in a cache of bounded size. A text's result is what its segments give.

A pair of ids is counted in every document that links it, over the whole corpus. Documents are kept
as arrays of their distinct pairs in a table of the shared folder. Most links belong to few pairs, the
``HOT`` most frequent, which are broadcast, so that such pairs are never shuffled again; all others
meet their counts in a join, where a pair is at most as frequent as the last one that was broadcast.

Defined results: texts that are null or empty, or whose tokens don't give back their bytes (as with
U+2581, which B reads as a space), have no tokens, zeros and an empty digest; repeated rows, also
of one id, are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import shared_folder, table

#: Segments that are remembered and their characters at most; pairs of ids that are broadcast.
CACHED, CACHE_CHARS, HOT = 200_000, 64, 200_000
#: Characters of segments that are read in one go; characters of documents that are worked on at once, and links of a group from which its ids are counted first.
JOINED, CHUNK, WIDE = 16_384, 1_000_000, 4096
#: Fixed value: what byte-level tokenizers split a text by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BORDER = re.compile(r"(?<=\S)(?= )")
_SPACE = "▁"


class Tokens:
    """Both tokenizers, with the bytes of every token.

    Ids of A are found by ranks, which is quicker, where that gives the same: if ids follow the order
    of the merges and the merges make each entry whole from its own text. For then two neighbours
    whose bytes are an entry's, when all earlier merges are done, are the very two that its merge
    names, because up to there nothing outside them has mattered.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Byte-level letters: printable bytes stand for themselves, the others for the code points from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        written = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        longest = max(len(self.a_bytes), len(self.b_bytes))
        self.before_comma, self.before_bar, self.before_semicolon = (written(longest, mark) for mark in ",|;")
        with open(a_path, encoding="utf-8") as f:
            how = json.load(f)
        plain = how["normalizer"] is None and how["pre_tokenizer"].get("type") == "ByteLevel" and how["pre_tokenizer"].get("use_regex", True) and not how["pre_tokenizer"]["add_prefix_space"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in how["model"]["merges"]]
        ranked = plain and len(vocabulary) == len(merges) + 256 and all(vocabulary[x + y] == 256 + i and len(self.a.model.tokenize(x + y)) == 1 for i, (x, y) in enumerate(merges))
        if ranked:
            ranks = {self.a_bytes[i]: i for i in vocabulary.values()}
            self.a_ids = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.a_ids = lambda text: self.a.encode(text, add_special_tokens=False).ids
        self.divides = plain and not any(re.search(rf"[^{_SPACE}]{_SPACE}", p) for p in pieces)

    def segments(self, text: str) -> list[str]:
        """A text, with the space before it, cut where neither tokenizer has a token across."""
        parts = _BORDER.split(" " + text) if self.divides else [" " + text]
        if len(parts) > 1 and parts[-1].isspace():
            parts[-2:] = [parts[-2] + parts[-1]]
        return parts

    def encode(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all segments by A, how many each has, and the same by B; none where a tokenizer's don't give back the bytes.

        Segments that don't end in white space are read many at a time: where they join is a border.
        """
        a, na, b, nb = [], [], [], []
        for run in _runs(segments, JOINED if self.divides else 0):
            whole = "".join(run)
            own_a, own_b = self.a_ids(whole), self.b.encode(whole[1:])
            own = whole.encode()
            same = b"".join([self.a_bytes[t] for t in own_a]) == own and b"".join([self.b_bytes[t] for t in own_b]) == own
            if len(run) > 1 and not same:
                for one in run:  # one of them is to blame
                    for all_, got in zip((a, na, b, nb), self.encode([one]), strict=True):
                        all_.append(got)
                continue
            ends = np.cumsum([len(s.encode()) for s in run]) if same else np.zeros(len(run), np.int64)
            for ids, lengths, all_, n in ((own_a, self.a_length, a, na), (own_b, self.b_length, b, nb)):
                ids = np.array(ids if same else [], np.int64)
                all_.append(ids)
                n.append(np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends, side="right"), prepend=0))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([*x, none]) for x in (a, na, b, nb))


def _runs(segments: Sequence[str], most: int) -> Iterator[list[str]]:
    """The segments in order, in runs of about so many characters whose members but the last don't end in white space."""
    run, size = [], 0
    for s in segments:
        run.append(s)
        size += len(s)
        if size > most or s[-1].isspace():
            yield run
            run, size = [], 0
    if run:
        yield run


def borders(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, given the lengths of tokens that cover the same bytes."""
    ends = np.cumsum(b_lengths)  # the index: tokens of B by their ends
    a_ends = np.cumsum(a_lengths)
    first = np.searchsorted(ends, a_ends - a_lengths, side="right")  # of the tokens of B that a token of A overlaps
    last = np.searchsorted(ends, a_ends, side="left")
    spanned = np.zeros(len(ends) + 1, np.int64)
    np.add.at(spanned, first, 1)
    np.add.at(spanned, last, -1)
    is_border = np.cumsum(spanned)[:-1] == 0  # behind a token of B
    b_group = np.cumsum(is_border) - is_border
    return b_group[first], b_group


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as counted, one run behind the other."""
    runs = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(runs - starts, counts)


class Aligner:
    """Segments that are aligned once: what each adds to a document."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.width = len(tokens.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes come back
        self.at = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, segments: Sequence[str]) -> None:
        """Align segments and remember them, in order."""
        a, na, b, nb = self.tokens.encode(segments)
        a_group, b_group = borders(self.tokens.a_length[a], self.tokens.b_length[b])
        of_segment = np.repeat(np.arange(len(segments)), na)
        n_groups = int(a_group[-1]) + 1 if len(a) else 0
        a_count, b_count = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        a_first, b_first = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
        segment = of_segment[a_first]  # of each group
        # Every token of A with every one of B in its group; where that is much, with how often each id is there.
        narrow = a_count * b_count <= WIDE
        side = np.nonzero(narrow[a_group])[0]
        each = b_count[a_group[side]]
        key = np.repeat(a[side], each) * self.width + b[ragged(b_first[a_group[side]], each)]
        own, times = [np.repeat(of_segment[side], each)], [np.ones(len(key), np.int64)]
        key = [key]
        for g in np.nonzero(~narrow)[0]:
            x, nx = np.unique(a[a_first[g] : a_first[g] + a_count[g]], return_counts=True)
            y, ny = np.unique(b[b_first[g] : b_first[g] + b_count[g]], return_counts=True)
            key.append((x[:, None] * self.width + y).ravel())
            times.append(np.outer(nx, ny).ravel())
            own.append(np.full(len(x) * len(y), segment[g]))
        own, key, times = _summed(np.concatenate(own), np.concatenate(key), np.concatenate(times))
        n = np.bincount(segment, minlength=len(segments))
        links = np.bincount(segment, weights=a_count * b_count, minlength=len(segments)).astype(np.int64)
        self.numbers = np.concatenate([self.numbers, np.column_stack([na, nb, n, links, na > 0])])
        self.groups += self._written(a, a_group, b, b_group, na + nb)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(own, minlength=len(segments)))])
        self.pairs, self.times = np.concatenate([self.pairs, key]), np.concatenate([self.times, times])

    def _written(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The groups of each segment as text; tokens is how many it has of both kinds."""
        after = lambda group: np.append(group[1:] != group[:-1], True)[: len(group)]
        said = np.concatenate([np.where(after(a_group), self.tokens.before_bar[a], self.tokens.before_comma[a]), np.where(after(b_group), self.tokens.before_semicolon[b], self.tokens.before_comma[b])])
        place = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        words = said[place].tolist()
        ends = np.cumsum(tokens)
        return ["".join(words[i:j])[:-1] for i, j in zip((ends - tokens).tolist(), ends.tolist(), strict=True)]

    def documents(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """For each text: tokens of A and B, groups and links; the digest; the distinct pairs and how often each is linked."""
        if len(self.known) > CACHED:
            self.clear()
        known = self.known
        parts = [self.tokens.segments(t) if t else [] for t in texts]
        new = list(dict.fromkeys([s for p in parts for s in p if s not in known]))
        new.sort(key=lambda s: len(s) > CACHE_CHARS)  # those that stay come first
        n = len(self.groups)
        known.update(zip(new, range(n, n + len(new)), strict=True))
        if new:
            self.add(new)
        flat = np.array([known[s] for p in parts for s in p], np.int64)
        counts = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(counts)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[flat], axis=0)])
        numbers = sums[ends] - sums[ends - counts]
        whole = (numbers[:, 4] == counts) & (counts > 0)
        numbers[~whole] = 0
        said = flat.tolist()
        groups = self.groups
        digests = [hashlib.sha256(";".join([groups[i] for i in said[end - k : end]]).encode()).hexdigest() if ok else "" for k, end, ok in zip(counts.tolist(), ends.tolist(), whole.tolist(), strict=True)]
        of = np.repeat(np.arange(len(texts)), counts)
        flat, of = flat[whole[of]], of[whole[of]]
        many = self.at[flat + 1] - self.at[flat]
        at = ragged(self.at[flat], many)
        doc, key, times = _summed(np.repeat(of, many), self.pairs[at], self.times[at])
        cuts = np.searchsorted(doc, np.arange(1, len(texts)))
        out = numbers[:, :4], digests, np.split(key, cuts), np.split(times, cuts)
        long = [s for s in new if len(s) > CACHE_CHARS]
        if long:
            end = n + len(new) - len(long)
            self.groups, self.numbers, self.at = self.groups[:end], self.numbers[:end], self.at[: end + 1]
            self.pairs, self.times = self.pairs[: self.at[-1]], self.times[: self.at[-1]]
            for s in long:
                del known[s]
        return out


def _summed(own: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (own, key) in order, with the sum of their times; own is small, key below 2^40."""
    code = (own << 40) | key
    order = np.argsort(code)
    code, times = code[order], times[order]
    first = np.nonzero(np.append(True, code[1:] != code[:-1])[: len(code)])[0]
    code = code[first]
    return code >> 40, code & ((1 << 40) - 1), np.add.reduceat(times, first) if len(first) else times[:0]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each Python worker."""
    return Aligner(Tokens(a_path, b_path))


def documents(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; a pair is A's id times B's vocabulary plus B's id."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= CHUNK:
                    size, to = size + len(texts[to]), to + 1
                numbers, digests, pairs, times = own.documents(texts[at:to])
                columns = [pa.array(numbers[:, i]) for i in range(4)] + [pa.array(digests, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], names=[key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                at = to

    texts = df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return texts.mapInArrow(run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def aligned(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of the input."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/align-{uuid.uuid4().hex}"
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    numbered = documents(df, a_path, b_path, key, text).withColumn("row", F.monotonically_increasing_id())

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    docs = kept(numbered, "documents")  # numbers of rows are fixed from here on
    counted = docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = W.partitionBy(F.floor(F.col("pair") / width))  # at most as many rows as B has ids
    counts = kept(counted.withColumn("best", F.col("n") == F.max("n").over(of_a)), "counts")
    frequent = F.broadcast(counts.orderBy(F.desc("n"), "pair").limit(hot))  # hot rows at most
    links = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    of_frequent = links.join(frequent, "pair").groupBy("row").agg(*sums)
    rest = counts.join(frequent.select("pair"), "pair", "left_anti")
    of_rest = links.join(frequent.select("pair"), "pair", "left_anti").join(rest, "pair").groupBy("row").agg(*sums)
    total = of_frequent.unionByName(of_rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    done = docs.drop("pairs", "times").join(total, "row", "left")
    return done.select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
