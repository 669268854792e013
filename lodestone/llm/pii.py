r"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base spans of four kinds are found by pattern and check. They are the seeds: the words around them
make lexical patterns (the two words before; the word before with the word after). Patterns and the
strings that stand in them, seeds as well as other strings that look like identifiers, form a
graph. A pattern's confidence in a kind is the mean score of its strings, a string's score is the
noisy-or of its patterns' confidences, seeds keep score 1. Strings that look like identifiers are
words with an at sign or enough digits and runs of digit groups. After a few rounds a string of a fitting
shape becomes a span where both of its patterns are confident and have several different seeds.

The patterns differ from the contract's only in possessive repeats and an anchor at the start of a
run, which change no match but keep the time linear and the matcher's stack flat on long runs.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each give
their row and count once as evidence; spans count code points, end exclusive; an empty table gives
no rows; other columns are ignored (query) or kept (stage).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, free, table

KINDS = ("email", "ip", "card", "phone")

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SEARCH = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its kind is searched for.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A word with a digit or an at sign, and its core without marks around it.
_WORD, _CORE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", r"[0-9A-Za-z+@](?:\S*[0-9A-Za-z])?"
#: Groups of digits joined by spaces, dots, dashes and brackets, taken whole as the base phone and card patterns do.
_RUN = r"(?<![0-9A-Za-z])[+(]{0,2}+[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++"
#: Shapes that a discovered span of each kind must have.
_SHAPE = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]+(?:[.:][0-9]++){2,}+$",
    "card": r"^[0-9](?:[\x20.-]?[0-9]){11,}+$",
    "phone": r"^[+(0-9][\x200-9().+/-]{6,}$",
}
#: Digits that an identifier has at least unless it has an at sign.
LEAST_DIGITS = 6
#: Different seeds a pattern needs, confidence it needs, rounds, and characters of context read.
SEEDS, CONFIDENCE, ROUNDS, REACH = 5, 0.8, 3, 80
#: Characters of a block of text in redaction.
PIECE = 4096


def _let(value: Column, body) -> Column:
    """The body with the value worked out once, however often and in whatever lambda the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, most: bool = False) -> Column:
    """Running sums (or maxima) of an array of integers, by blocks of 256, so long arrays don't cost their square."""
    of = (lambda a: F.coalesce(F.array_max(a), F.lit(0))) if most else (lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y))
    join = (lambda x, y: F.greatest(x, y)) if most else (lambda x, y: x + y)
    block = lambda i: F.floor(i / 256).cast("int")

    def cut(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: of(F.slice(v, b * 256 + 1, 256)))
        return _let(_let(blocks, lambda x: F.transform(x, lambda _, b: of(F.slice(x, 1, b)))), lambda before: F.transform(v, lambda _, i: join(F.get(before, block(i)), of(F.slice(v, block(i) * 256 + 1, i % 256 + 1)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(v))


def _below(ordered: Column, x: Column) -> Column:
    """How many of an ascending array are less than x, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        less = F.get(ordered, mid) < x
        moved = F.struct(F.when(less, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(less, at["hi"]).otherwise(mid).alias("hi"))
        return F.when(at["lo"] < at["hi"], moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ordered)))), start, step, lambda at: at["lo"])


_HIT = "array<struct<text:string,start:int,end:int,before:string,after:string>>"


def _hits(text: Column, search: str, wanted: Column) -> Column:
    """An array of the matches with their places and the characters around them."""
    none = F.array().cast("array<string>")
    matches = F.when(wanted, F.regexp_extract_all(text, F.lit(search), F.lit(0))).otherwise(none)

    def placed(m: Column) -> Column:
        pieces = F.when(F.size(m) > 0, F.split(text, search, -1)).otherwise(none)
        return _let(pieces, lambda p: _let(_running(F.transform(m, lambda x, i: F.char_length(x) + F.char_length(F.get(p, i)))), lambda e: F.transform(m, hit(p, e))))

    def hit(p: Column, e: Column):
        return lambda m, i: F.struct(
            m.alias("text"), (F.get(e, i) - F.char_length(m)).alias("start"), F.get(e, i).alias("end"),
            F.right(F.get(p, i), F.lit(REACH)).alias("before"), F.left(F.get(p, i + 1), F.lit(REACH)).alias("after"),
        )

    return _let(matches, placed).cast(_HIT)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": n.between(14, 19) & F.call_function("luhn_check", _digits(hit)),
        "phone": n.between(10, 15),
    }[kind]


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with base (kind, start, end and context of each base span) and other (candidates)."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = own.rlike("[0-9@]")

    def kept(i: int, kind: str) -> Column:
        """The matches of a kind that pass its check, as spans."""
        found = _hits(own, _SEARCH[kind], some & own.contains(_HINT[kind]))
        return F.transform(F.filter(found, lambda h: _passes(kind, h["text"])), lambda h: _span(F.lit(i), h))

    base = F.array_sort(F.concat(*[kept(i, k) for i, k in enumerate(KINDS)]))
    core = lambda h: F.regexp_extract(h["text"], _CORE, 0)
    skip = lambda h: F.length(F.regexp_extract(h["text"], "^[^0-9A-Za-z+@]*", 0))
    cut = lambda h: F.struct(
        (h["start"] + skip(h)).alias("start"), F.lit(-1).alias("kind"), (h["start"] + skip(h) + F.char_length(core(h))).alias("end"),
        core(h).alias("text"), h["before"].alias("before"), h["after"].alias("after"),
    )
    like = lambda h: h["text"].contains("@") | (F.length(_digits(h["text"])) >= LEAST_DIGITS)
    # A run without a space lies in one word, which is a candidate itself.
    wide = lambda h: h["text"].contains(" ") & like(h)
    words = F.transform(F.filter(_hits(own, _WORD, some), like), cut)
    runs = F.transform(F.filter(_hits(own, _RUN, some), wide), lambda h: _span(F.lit(-1), h))

    def both(base: Column) -> Column:
        """Base spans, and the candidates that overlap none: no base span that starts before one's end reaches beyond its start."""
        starts, reach = F.transform(base, lambda b: b["start"]), _running(F.transform(base, lambda b: b["end"]), most=True)
        clear = lambda s, r: lambda h: F.coalesce(F.get(r, _below(s, h["end"]) - 1) <= h["start"], F.lit(True))
        other = _let(starts, lambda s: _let(reach, lambda r: F.filter(F.concat(words, runs), clear(s, r))))
        return F.struct(base.alias("base"), other.alias("other"))

    return df.withColumn("_both", _let(base, both)).withColumns({"base": F.col("_both.base"), "other": F.col("_both.other")}).drop("_both")


def _span(kind: Column, h: Column) -> Column:
    return F.struct(h["start"].alias("start"), kind.alias("kind"), h["end"].alias("end"), h["text"].alias("text"), h["before"].alias("before"), h["after"].alias("after"))


def _patterns(h: Column) -> Column:
    """The lexical patterns that an occurrence stands in."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"^[^\p{L}0]+|[^\p{L}0:=]+$", "")
    # Only the last two words of the context: the lookahead-free form stays linear.
    words = F.filter(F.split(h["before"], r"\s+"), lambda w: w != "")
    one, two = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit(""))
    after = F.coalesce(F.get(F.filter(F.split(h["after"], r"\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))
    return F.array(F.concat_ws(" ", F.lit("before"), clean(two), clean(one)), F.concat_ws(" ", F.lit("around"), clean(one), clean(after)))


def discovered(found: DataFrame, key: list[str]) -> DataFrame:
    """(*key, added): the spans that confident patterns add, for rows that have any.

    Edges are made distinct before anything is joined, and only patterns with enough different
    seeds stay, so that copies of a text weigh once and the graph stays far below the input.
    """
    at = F.explode(F.concat("base", "other")).alias("hit")
    edges = found.select(at).select(F.explode(_patterns(F.col("hit"))).alias("pattern"), F.lower("hit.text").alias("string"), "hit.kind").distinct()
    fit = edges.where("kind >= 0").groupBy("pattern", F.col("kind").alias("of")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SEEDS)
    fit = checkpoint(fit.select("pattern", "of"))
    graph = checkpoint(edges.join(fit.select("pattern").distinct(), "pattern", "left_semi"))
    sizes = graph.groupBy("pattern").agg(F.countDistinct("string").alias("n"))
    seeds = graph.where("kind >= 0").select("pattern", "string", F.col("kind").alias("of")).distinct()
    open_edges = graph.join(graph.where("kind >= 0").select("string").distinct(), "string", "left_anti").select("pattern", "string").distinct()
    known = seeds.groupBy("pattern", "of").agg(F.count("*").alias("sum"))
    confidence = known.join(sizes, "pattern").join(fit, ["pattern", "of"], "left_semi").select("pattern", "of", "sum", "n", (F.col("sum") / (F.col("n") + 1)).alias("confidence"))
    confidence = checkpoint(confidence)
    for _ in range(ROUNDS):
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))
        score = open_edges.join(confidence.select("pattern", "of", "confidence"), "pattern").groupBy("string", "of").agg((1 - doubt).alias("score"))
        more = open_edges.join(score, "string").groupBy("pattern", "of").agg(F.sum("score").alias("more"))
        confidence = checkpoint(
            confidence.drop("confidence")
            .join(more, ["pattern", "of"], "left")
            .select("pattern", "of", "sum", "n", ((F.col("sum") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + 1)).alias("confidence"))
        )
    sure = confidence.where(F.col("confidence") >= CONFIDENCE).select("pattern", "of")
    shape = F.lit(False)
    for i, k in enumerate(KINDS):
        shape = shape | ((F.col("of") == i) & F.col("hit.text").rlike(_SHAPE[k]))
    seen = found.select(*key, F.explode("other").alias("hit")).select(*key, "hit", F.explode(_patterns(F.col("hit"))).alias("pattern"))
    added = seen.join(sure, "pattern").where(shape)
    span = F.struct("hit.start", F.col("of").alias("kind"), "hit.end")
    agreed = added.select(*key, span.alias("span"), "pattern").distinct().groupBy(*key, "span").count().where(F.col("count") > 1)
    return agreed.groupBy(*key).agg(F.array_sort(F.collect_set("span")).alias("added"))


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, base, spans) for each row: base spans, and all spans, as sorted arrays of structs; h is a hash of the text."""
    plain = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = checkpoint(spans(df.select(key, F.col(text).alias("_own")), "_own").select(key, F.xxhash64("_own").alias("h"), "base", "other"))
    more = discovered(found, [key, "h"]).withColumnsRenamed({key: "_key", "h": "_h"})
    joined = found.join(more, F.col(key).eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")), "left").select(key, "h", plain("base").alias("base"), "added")
    return joined.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.slice("base", 1, 0)))))).drop("added")


def _written(array: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents", ("doc_id", "text")))
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping ones the first, and what the others cover goes.

    The text is cut into blocks once, so that a piece is taken from its blocks and not counted off from the start.
    """
    tag = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), s["kind"] + 1), F.lit(">"))
    block = lambda i: F.floor(i / PIECE).cast("int")

    def written(blocks: Column, at: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            own = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b, (k + 1) * PIECE) - F.greatest(a, k * PIECE))
            return F.when(a < b, F.array_join(F.transform(F.sequence(block(a), block(b - 1)), own), "")).otherwise("")

        before = lambda i: F.coalesce(F.get(at, i - 1), F.lit(0))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"]), tag(s))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(before(F.size(at)), F.char_length(text)))

    blocks = F.transform(F.sequence(F.lit(0), block(F.char_length(text))), lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE)))
    return _let(blocks, lambda b: _let(_running(F.transform(spans, lambda s: s["end"]), most=True), lambda at: written(b, at)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its spans replaced by the name of their kind in angle brackets; n_chars follows."""
    key, mine, theirs, spans_, clean = free(docs, "_id", "_hash", "_h", "spans", "_clean")
    got = find(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("h").alias(theirs), F.col("spans").alias(spans_)).distinct()
    joined = docs.withColumn(mine, F.xxhash64("text")).join(got, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(theirs)), "left")
    redacted = _redacted(F.col("text"), F.col(spans_))
    done = joined.withColumn(clean, F.when(F.col(spans_).isNull(), F.col("text")).otherwise(redacted))
    columns = {"text": F.col(clean).alias("text"), "n_chars": F.char_length(clean).cast("long").alias("n_chars")}
    return done.select(*[columns.get(c, F.col(c)) for c in docs.columns])
