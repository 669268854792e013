"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs at line ends, and each paragraph further at places that its own bytes
choose (after ``LONGEST`` bytes at the latest), so that an edit changes the digests around it alone. The set of digests (a repeat counts as
a digest of its own) goes into the cells of a sketch: each digest into one cell of every third,
where its number, sum and checksum are added. The sketches of two versions subtract cell by cell;
peeling the cells that hold one digest recovers what differs. If cells are left over, both are
sketched again, four times as large. The likeness of two fingerprints is twice the digests they
share over all digests of both; two empty ones are alike.

The serialised smallest sketch is the fingerprint; equal texts have equal ones.

Defined results: a null text counts as empty; the order is by falling doc_id, rows without an id
last, repeated ids by the hash of their text; a single row is its own next; an empty table gives no
rows; other columns are ignored. Texts are read whole; a batch of texts is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Cells of the smallest sketch, by how many times it grows after a failure, and texts of a batch.
CELLS, GROW, HASHES = 24, 4, 3
BATCH_TEXTS, BATCH_CHARS = 256, 4_000_000
#: Bytes of a passage at most; a text shorter than that is cut at every space.
LONGEST = 64
#: Ranges of ids for each shuffle partition.
RANGES = 4

_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def digests(text: bytes) -> np.ndarray:
    """The digests of a text's passages; the i-th repeat of a passage has a digest of its own."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    before = b.astype(np.uint32)
    chosen = before * 7
    chosen[1:] += before[:-1] * 31
    chosen[2:] += before[:-2] * 113
    chosen ^= chosen >> 5
    ends = (b == 10) | (b == 32) & ((chosen & 3 == 0) | (len(b) < LONGEST)) | (chosen & 127 == 77)
    ends[-1] = True
    cuts = np.concatenate([[0], np.nonzero(ends)[0] + 1])
    if (gaps := np.diff(cuts)).max() > LONGEST:  # where nothing is chosen, cut by length
        cuts = np.concatenate([*(np.arange(a, a + g, LONGEST) for a, g in zip(cuts, gaps, strict=False)), cuts[-1:]])
    at = cuts.tolist()
    of = xxhash.xxh3_64_intdigest
    found = np.array([of(text[i:j]) for i, j in zip(at, at[1:], strict=False)], np.uint64)
    order = np.argsort(found, kind="stable")
    s = found[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return mixed(s + (np.arange(len(s)) - start).astype(np.uint64) * _SALTS[0], _SALTS[1])


def places(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    third = cells // HASHES
    return np.concatenate([owner * cells + i * third + (mixed(keys, _SALTS[i]) % np.uint64(third)).astype(np.int64) for i in range(HASHES)])


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sum and checksum of every cell of n sketches, one after the other."""
    at = places(keys, owner, cells)
    number = np.bincount(at, minlength=n * cells).astype(np.int64)
    total, check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    np.add.at(total, at, np.tile(keys, HASHES))
    np.add.at(check, at, np.tile(mixed(keys, _CHECK), HASHES))
    return number, total, check


def peel(number: np.ndarray, total: np.ndarray, check: np.ndarray, n: int, cells: int):
    """What differs, from n subtracted sketches (which it uses up): for each whether it was recovered,
    and the recovered digests with the sketch each is from and its side (1 or -1)."""
    out_keys, out_owner, out_sign = [], [], []
    while True:
        at = np.nonzero(np.abs(number) == 1)[0]
        sign = number[at]
        keys = np.where(sign == 1, total[at], np.uint64(0) - total[at])
        seen = mixed(keys, _CHECK)
        pure = np.where(sign == 1, check[at], np.uint64(0) - check[at]) == seen
        at, sign, keys = at[pure], sign[pure], keys[pure]
        if not len(at):
            break
        owner = at // cells
        order = np.lexsort((keys, owner))
        owner, keys, sign = owner[order], keys[order], sign[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
        owner, keys, sign = owner[new], keys[new], sign[new]
        where = places(keys, owner, cells)
        weight = np.tile(sign, HASHES)
        of = np.where(weight == 1, np.tile(keys, HASHES), np.uint64(0) - np.tile(keys, HASHES))
        checks = np.tile(mixed(keys, _CHECK), HASHES)
        np.subtract.at(number, where, weight)
        np.subtract.at(total, where, of)
        np.subtract.at(check, where, np.where(weight == 1, checks, np.uint64(0) - checks))
        out_keys.append(keys)
        out_owner.append(owner)
        out_sign.append(sign)
    done = ~((number != 0) | (total != 0) | (check != 0)).reshape(n, cells).any(axis=1)
    none = np.zeros(0, np.int64)
    return done, np.concatenate(out_keys or [none.astype(np.uint64)]), np.concatenate(out_owner or [none]), np.concatenate(out_sign or [none])


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets those that only the first and only the second has, from sketches alone."""
    found: list = [None] * len(a)
    left, cells = np.arange(len(a)), CELLS
    while len(left):
        n = len(left)
        one, two = sketch(*joined([a[i] for i in left]), n, cells), sketch(*joined([b[i] for i in left]), n, cells)
        done, keys, owner, sign = peel(one[0] - two[0], one[1] - two[1], one[2] - two[2], n, cells)
        order = np.argsort(owner, kind="stable")
        keys, owner, sign = keys[order], owner[order], sign[order]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        for j in np.nonzero(done)[0]:
            k, s = keys[bounds[j] : bounds[j + 1]], sign[bounds[j] : bounds[j + 1]]
            found[left[j]] = k[s == 1], k[s == -1]
        left, cells = left[~done], cells * GROW
        if cells * len(left) > 4_000_000 and len(left) > 1:  # few at a time from here on
            half = len(left) // 2
            for part in (left[:half], left[half:]):
                for i, d in zip(part, differences([a[i] for i in part], [b[i] for i in part]), strict=True):
                    found[i] = d
            break
    return found


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differences(a, b), strict=True):
        both = len(x) + len(y)
        out.append(1.0 if not both else (both - len(only_x) - len(only_y)) / both)
    return out


def serialised(sets: list[np.ndarray]) -> list[str]:
    """The smallest sketch of each set as text."""
    number, total, check = (x.reshape(len(sets), CELLS) for x in sketch(*joined(sets), len(sets), CELLS))
    cells = np.zeros((len(sets), CELLS), np.dtype([("n", "<i4"), ("sum", "<u8"), ("check", "<u4")]))
    cells["n"], cells["sum"], cells["check"] = number, total, check & np.uint64(0xFFFFFFFF)
    return [base64.b64encode(row.tobytes()).decode() for row in cells]


# ------------------------------------------------------------------ on DataFrames


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows (pid, foreign, key, text), sorted, so that each row's next by falling key follows it in its range.

    Ranges of the key are cut at quantiles; the first row of each range is also sent, as a foreign
    row, to the range that precedes it. The texts move once. On the driver there are as many keys
    as ranges.
    """
    spark = df.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType.simpleString()
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    keys = df.select(place.alias("k"))
    bounds = sorted({int(b) for b in keys.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)})
    block = max(1, round(len(bounds) ** 0.5))
    outer = F.array(*map(F.lit, bounds[block - 1 :: block])).cast("array<long>")
    every = F.array(*map(F.lit, bounds)).cast("array<long>")
    smaller = lambda a: F.size(F.filter(a, lambda b: b < F.col("k")))
    ranged = keys.withColumn("o", smaller(outer)).withColumn("pid", F.col("o") * block + smaller(F.slice(every, F.col("o") * block + 1, block)))
    heads = sorted(tuple(r) for r in ranged.groupBy("pid").agg(F.max("k").alias("k")).collect())
    send = [(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)] if heads else []
    sent = F.broadcast(spark.createDataFrame(send, "k long, to int"))  # one row for each range
    rows = (
        df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), place.alias("k"))
        .withColumn("o", smaller(outer))
        .withColumn("pid", F.col("o") * block + smaller(F.slice(every, F.col("o") * block + 1, block)))
        .join(sent, "k", "left")
    )
    goes = F.array_compact(F.array(F.struct("pid", F.lit(0).alias("foreign")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("pid"), F.lit(1).alias("foreign")))))
    dealt = rows.select(key, "_text", "k", F.explode(goes).alias("x")).select("x.pid", "x.foreign", key, "_text", "k")
    return dealt.repartition("pid").sortWithinPartitions("pid", "foreign", F.desc("k"), F.xxhash64("_text")).select("pid", "foreign", key, "_text"), kind


def compared(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and the likenesses."""
    rows, kind = neighbours(df, key, text)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batch_of(pairs: list, key_type: pa.DataType) -> pa.RecordBatch:
        ids, lengths, hashes, own, edited, after = [], [], [], [], [], []
        for (doc, text, keys), (_, next_text, next_keys) in pairs:
            cut = len(text) // 3
            changed = (text[: len(text) - cut] + next_text[:cut]).encode("utf-8", "surrogatepass")
            ids.append(doc)
            lengths.append(len(text))
            hashes.append(hashlib.sha256(changed).hexdigest())
            own.append(keys)
            edited.append(digests(changed))
            after.append(next_keys)
        columns = [pa.array(ids, key_type), pa.array(lengths, pa.int64()), pa.array(hashes), pa.array(serialised(own)), pa.array(serialised(edited)), pa.array(likeness(own, edited), pa.float64()), pa.array(likeness(own, after), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, range_of, pairs, chars, key_type = None, None, [], 0, None
        for batch in batches:
            key_type = batch.schema.field(2).type
            for pid, foreign, doc, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                pid, row_text = pid.as_py(), text.as_py()
                if pid != range_of:
                    range_of, waiting = pid, None
                elif waiting is None:
                    continue  # a repeat of a foreign row
                row = (doc.as_py(), row_text, digests(row_text.encode("utf-8", "surrogatepass")))
                if waiting is not None:
                    pairs.append((waiting, row))
                    chars += len(waiting[1])
                waiting = None if foreign.as_py() else row
                if len(pairs) >= BATCH_TEXTS or chars >= BATCH_CHARS:
                    yield batch_of(pairs, key_type)
                    pairs, chars = [], 0
        if pairs:
            yield batch_of(pairs, key_type)

    return rows.mapInArrow(run, f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents", ("doc_id", "text")))
