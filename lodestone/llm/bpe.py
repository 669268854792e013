"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

The bytes of a piece become Latin-1 characters, so that pyahocorasick can report every vocabulary
entry in it in one pass. From the longest entry at each position the encoder walks forward and
backs up to shorter entries whenever two neighbours could not stand side by side in the result of
the ranked merges. That test looks at the two entries alone, so it is memoised; with a mark for
each position already refuted, a piece takes time linear in its length.

Defined results: a null text counts as empty and gives no ids; an empty text gives no ids; repeated
rows each give their row; an empty table gives no rows; other columns of the input are ignored.
Texts of any length are encoded whole, in blocks of pieces, with memory bounded by block and cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Entries of a generation of the per-process caches, and characters of a piece that may enter them.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48
#: Pieces that are hashed at once.
BLOCK = 32_768


class Encoder:
    """Encodes and decodes by the ranks of a vocabulary file, one piece at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.entry = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.entry[rank] = token
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.prefixes: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}  # in use since the last change of generations
        self.older: dict[str, tuple[int, ...]] = {}
        self.written = [str(i) for i in range(len(self.entry))]

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """The plain ranked merges of a short string, using only ranks below the given one."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int]:
        """The two entries whose merge makes this one; the entry itself, twice, if it is a byte."""
        if (got := self.halves.get(token)) is None:
            parts = self._merge(self.entry[token], token)
            got = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self.halves[token] = got
        return got

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between these two neighbours standing.

        Undoes the merges of both sides from the latest on; the border falls if, at some moment,
        the entries beside it had a merge that came before the next one undone.
        """
        if (got := self.fits.get((left, right))) is not None:
            return got
        a, b, limit, got = left, right, len(self.entry) + 1, True
        while True:
            merged = self.ranks.get(self.entry[a] + self.entry[b])
            if merged is not None and merged < limit:
                got = False
                break
            a_in, b_in = self._halves(a)[1], self._halves(b)[0]
            if a_in == a and b_in == b:
                break
            # The later of the two merges is undone first; on a tie the right one ran later.
            if a_in != a and (a > b or b_in == b):
                limit, a = a, a_in
            else:
                limit, b = b + 1, b_in
        if len(self.fits) >= 4 * CACHE_ENTRIES:
            self.fits.clear()
        self.fits[left, right] = got
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        longest: list[tuple[int, int] | None] = [None] * n  # (rank, length) of the longest entry that begins here
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - found[1]] = found  # of one start, longer ones end later
        alive = bytearray(b"\1") * (n + 1)
        fits, entry = self.fits, self.entry
        out: list[int] = []
        at, last, here = 0, -1, longest[0]
        while at < n:
            while here is not None:
                token, length = here
                if alive[at + length] and (last < 0 or fits.get((last, token)) or self._fit(last, token)):
                    break
                here = self._shorter(token)
            else:  # nothing that begins here fits: shorten what stands before
                alive[at] = 0
                at -= len(entry[last])
                here = self._shorter(out.pop())
                last = out[-1] if out else -1
                continue
            out.append(token)
            last, at = token, at + length
            here = longest[at] if at < n else None
        return out

    def _shorter(self, token: int) -> tuple[int, int] | None:
        """The longest entry that is a proper prefix of this one."""
        if (got := self.prefixes.get(token, 0)) == 0:
            whole = self.entry[token]
            got = next(((self.ranks[whole[:k]], k) for k in range(len(whole) - 1, 0, -1) if whole[:k] in self.ranks), None)
            self.prefixes[token] = got
        return got

    def _known(self, piece: str) -> tuple[int, ...]:
        if (got := self.older.get(piece)) is None:
            got = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.known, self.older = {}, self.known
            self.known[piece] = got
        return got

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The text's ids in order, for blocks of pieces."""
        short = len(text) <= 16 * BLOCK  # all pieces at once are quicker, if they are few
        pieces = iter(self.pieces.findall(text)) if short else (m.group() for m in self.pieces.finditer(text))
        while block := list(islice(pieces, BLOCK)):
            known = self.known
            yield list(chain.from_iterable([known.get(p) or self._known(p) for p in block]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder.load(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The frame with the ids of every text in a column of arrays; null texts have no ids."""

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        own = encoder(path, pattern)
        return texts.map(lambda t: own.encode(t or ""))

    return df.withColumn(ids, ids_of(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The frame with the bytes that the ids stand for; null ids give no bytes."""

    @F.pandas_udf("binary")
    def bytes_of(rows):
        own = encoder(path, pattern)
        return rows.map(lambda r: b"" if r is None else own.decode(r))

    return df.withColumn(to, bytes_of(ids))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: n_tokens and digests of the ids and of what they decode to; nothing shuffles."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                n, h_ids, h_bytes, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
                for ids in own.blocks(value.as_py() or ""):
                    n += len(ids)
                    h_ids.update(gap + " ".join(map(own.written.__getitem__, ids)).encode())
                    h_bytes.update(own.decode(ids))
                    gap = b" "
                counts.append(n)
                of_ids.append(h_ids.hexdigest())
                of_bytes.append(h_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInArrow(
        run, f"{key} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", ("doc_id", "text")), *_vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: the digests of every document that is left."""
    return digests(docs.select("doc_id", "text"), *_vocabulary())
