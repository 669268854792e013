r"""Chat formatting by schema fingerprints.

Chat records come in many layouts: a list of messages under various names, an instruction with an
input and an output, a prompt with a response. The nested field paths of a record, with the kind of
each value, are hashed into its schema fingerprint. The fingerprint selects a declarative mapping,
which says where roles and texts are and whether its roles go by other names; the mapping is worked
out once for a fingerprint. A row of a table of turns is a layout of its own, whose roles are taken
as they are. Canonical turns are then written in one template::

    \### Role: text</turn>

Backslashes and control strings inside a text are escaped by a backslash in front, so the formatted
text can be read back exactly. The loss mask covers assistant texts alone, markers left out.

Defined results: null roles and texts count as empty, a null turn comes first; rows with the same
turn are ordered by role and text; repeated rows are turns of their own; a role that isn't known is
kept as it is, escaped; rows without a conversation id are one conversation; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

OPEN, MIDDLE, CLOSE = "\\### ", ": ", "</turn>"
#: Stands before a role that has no name of its own in the template.
OTHER = "="
#: How roles are written in the template, and back.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
#: Names that roles go by in foreign layouts; a row of a table of turns is taken at its word.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

# ------------------------------------------------------------ schemas and mappings

#: Lists of turns: (path of the list, field of the role, field of the text).
LISTS = [("messages", "role", "content"), ("messages", "role", "text"), ("conversations", "from", "value"), ("conversation", "role", "content"), ("turns", "role", "text"), ("dialog", "speaker", "text")]
#: Flat records: (role, the fields whose texts that role says, joined by an empty line) in order.
FLAT = [
    [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])],
    [("system", ["system"]), ("user", ["instruction", "context"]), ("assistant", ["response"])],
    [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])],
    [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])],
    [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])],
]
_MAPPINGS: dict[str, dict | None] = {}


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a record, with the kinds of their values; elements of a list share a path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {f"{at}:{'null' if value is None else 'text' if isinstance(value, str) else 'other'}"}


def fingerprint(record) -> str:
    return hashlib.sha256("\n".join(sorted(paths(record))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def mapping(record) -> dict | None:
    """The mapping of a record's layout, looked up by its fingerprint; None if no layout fits."""
    own = paths(record)
    key = hashlib.sha256("\n".join(sorted(own)).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    if key not in _MAPPINGS:
        if len(_MAPPINGS) >= 10_000:
            _MAPPINGS.clear()
        names = {p.rsplit(":", 1)[0] for p in own}
        found = {"row": True} if names == {".role", ".text"} else None
        for path, role, text in LISTS if found is None else ():
            if f".{path}[].{role}" in names and f".{path}[].{text}" in names or f".{path}[]" in own:
                found = {"list": path, "role": role, "text": text}
                break
        if found is None:
            for fields in FLAT:
                if all(f".{some[0]}" in names for role, some in fields if role != "system"):
                    found = {"flat": fields}
                    break
        _MAPPINGS[key] = found
    return _MAPPINGS[key]


def canonical(record) -> list[tuple[str, str]] | None:
    """The turns (role, text) of a record in any known layout; None if its layout isn't known."""
    if not isinstance(record, dict) or (how := mapping(record)) is None:
        return None
    if "row" in how:
        return [tuple("" if record[f] is None else str(record[f]) for f in ("role", "text"))]
    if "list" in how:
        turns = [(m.get(how["role"]), m.get(how["text"])) for m in record[how["list"]]]
        return [(ALIASES.get(str(r).lower(), str(r)) if r is not None else "", "" if t is None else str(t)) for r, t in turns]
    said = [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in how["flat"]]
    return [(role, text) for role, text in said if text or role != "system"]


# ----------------------------------------------------------------- the template

_CONTROL = re.compile(r"\\|</turn>|: ")
_TEXT_CONTROL = re.compile(r"\\|</turn>")
_ESCAPED = re.compile(r"\\(\\|</turn>|: )")


def escape(text: str) -> str:
    return _TEXT_CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    """One turn in the template; a conversation is its turns, one after the other.

    Escaping doubles every backslash of a text, so a single one before ``###`` can only be a marker.
    """
    return OPEN + (ROLES.get(role) or OTHER + _CONTROL.sub(lambda m: "\\" + m.group(), role)) + MIDDLE + escape(text) + CLOSE


_ROLE_PART = re.compile(r"((?:\\(?:\\|</turn>|: )|[^\\])*?): ", re.S)
_BACK = {v: k for k, v in ROLES.items()}


def _text_end(formatted: str, at: int) -> int:
    """Where the text that begins at the place ends: at the next close that no backslash escapes."""
    while True:
        close = formatted.find(CLOSE, at)
        if close < 0:
            raise ValueError("turn without an end")
        back = close
        while back > 0 and formatted[back - 1] == "\\":
            back -= 1
        if (close - back) % 2 == 0:
            return close
        at = close + 1


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in the formatted one."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        role = _ROLE_PART.match(formatted, at + len(OPEN))
        end = _text_end(formatted, role.end())
        name = role.group(1)
        yield _BACK.get(name) or unescape(name.removeprefix(OTHER)), unescape(formatted[role.end() : end]), role.end(), end
        at = end + len(CLOSE)


def loss_mask(formatted: str) -> list[tuple[int, int]]:
    """The ranges, in code points, that count towards the loss: the assistant's texts."""
    return [(start, end) for role, _, start, end in parse(formatted) if role == "assistant"]


# ------------------------------------------------------------------ on DataFrames


def format_records(df: DataFrame, column: str = "record") -> DataFrame:
    """The frame with fingerprint, formatted and mask of each JSON record; unknown layouts have nulls."""

    @F.pandas_udf("fingerprint string, formatted string, mask array<struct<start:int,end:int>>")
    def of(records: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in records:
            try:
                record = None if raw is None else json.loads(raw)
            except ValueError:
                record = None
            turns = canonical(record)
            text = None if turns is None else "".join(format_turn(*t) for t in turns)
            rows.append((None if record is None else fingerprint(record), text, None if text is None else [{"start": a, "end": b} for a, b in loss_mask(text)]))
        return pd.DataFrame(rows, columns=["fingerprint", "formatted", "mask"])

    return df.withColumn("_chat", of(column)).select(*[c for c in df.columns], "_chat.*")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted) of every row of a conversation.

    Each row is a record of its own layout; a conversation's text is that of its turns one after the
    other, so a conversation of any length is never gathered.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for role, text in zip(frame["role"], frame["text"], strict=True):
                out.append("".join(format_turn(*t) for t in canonical({"role": role, "text": text})))
            yield frame.assign(formatted=out)[["conv_id", "turn", "role", "text", "formatted"]]

    kind = rows.schema["conv_id"].dataType.simpleString()
    plain = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    got = plain.mapInPandas(run, "conv_id string, turn string, role string, text string, formatted string")
    return got.withColumn("conv_id", F.col("conv_id").cast(kind)).withColumn("turn", F.col("turn").cast("long"))


def read_back(parts: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted turns alone, as a sorted stream."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key, state = None, None

        def row(key, state):
            return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for frame in frames:
            done = []
            for conv, formatted in zip(frame["conv_id"].tolist(), frame["formatted"].tolist(), strict=True):
                if key is None or key[0] != conv:
                    if key is not None:
                        done.append(row(key, state))
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for start, end in loss_mask(formatted):
                    text = unescape(formatted[start:end])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([row(key, state)], columns=names)

    kind = parts.schema["conv_id"].dataType.simpleString()
    sorted_parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select(F.col("conv_id").cast("string"), "formatted")
    got = sorted_parts.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return got.withColumn("conv_id", F.col("conv_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", ("conv_id", "turn", "role", "text"))
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(segments(rows.unionByName(more)))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, layout, n, formatted_sha256, loss_chars) of every row written as a record of one of five foreign layouts."""
    rows = table(spark, sf_dir, "conversations", ("conv_id", "turn", "role", "text"))
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    by = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    said = lambda r, t, a, b: F.array(F.struct(r.alias(a), t.alias(b)))
    kinds = [
        F.to_json(F.struct(said(role, text, "role", "content").alias("messages"))),
        F.to_json(F.struct(said(by, text, "from", "value").alias("conversations"))),
        F.to_json(F.struct(said(role, text, "speaker", "text").alias("dialog"), F.lit(1).alias("version"))),
        F.to_json(F.struct(text.alias("prompt"), text.alias("response"))),
        F.to_json(F.struct(text.alias("instruction"), F.lit("").alias("input"), text.alias("output"))),
    ]
    layout = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(len(kinds))).cast("int")
    records = rows.select("conv_id", "turn", layout.alias("layout"), F.get(F.array(*kinds), layout).alias("record"))
    got = format_records(records)
    loss = F.aggregate("mask", F.lit(0), lambda n, m: n + m["end"] - m["start"]).cast("long")
    return got.select("conv_id", "turn", "layout", F.sha2("formatted", 256).alias("formatted_sha256"), loss.alias("loss_chars"))


#: The same in SQL: the template over each row's text, and of flat records the question before the answer.
LAYOUTS_SQL = r"""WITH said AS (SELECT conv_id, turn, CAST((((coalesce(conv_id, 0) + coalesce(turn, 0)) % 5) + 5) % 5 AS INTEGER) AS layout, coalesce(role, '') AS role,
  replace(replace(coalesce(text, ''), '\', '\\'), '</turn>', '\</turn>') AS t FROM conversations),
named AS (SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), ': ', '\: ') END AS name FROM said)
SELECT conv_id, turn, layout, sha256(CASE WHEN layout < 3 THEN '\### ' || name || ': ' || t || '</turn>' ELSE '\### User: ' || t || '</turn>\### Assistant: ' || t || '</turn>' END) AS formatted_sha256,
  CAST(CASE WHEN layout >= 3 OR role = 'assistant' THEN length(t) ELSE 0 END AS BIGINT) AS loss_chars FROM named"""

#: The query in SQL.
SQL = r"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (SELECT *, replace(replace(text, '\', '\\'), '</turn>', '\</turn>') AS escaped,
  CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), ': ', '\: ') END AS name FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(5 + length(name) + 2 + length(escaped) + 7) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""
