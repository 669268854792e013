"""URL filters: domain rules first, then a classifier over segmented host names and paths.

A rule names a host and the start of a path; it fits that host and all its subdomains, and of the
rules that fit the longest wins. URLs that no rule fits are judged by multinomial naive Bayes over
the words of the path and those of the host: concatenated names are split by Viterbi into the
likeliest words under a unigram model of the words in all pages.

The classifier learns from the urls that a rule decides: a word counts once for every host and
verdict it stands under, so that a host with very many pages weighs as any other. Words that a rule
names itself say nothing (they would only repeat the rule), and hosts of the fold ``HELD`` are not
learned from, so they measure what was learned (``accuracy``). Lists of words known to be good or
bad are the prior, worth ``LISTED`` hosts each. A word seen under fewer than ``SEEN`` hosts of the
rules, or whose odds lie within ``SURE`` standard errors of those of all words, has its prior alone.
Words are hashed into ``BUCKETS`` counts, so the model has a fixed size.

Segmentation works on distinct labels of distinct hosts. Only the pieces of a label that are words
reach it, by a join with the counts of all words, so neither the words nor the hosts are gathered
anywhere; a host that very many pages share is reduced before it is joined and the join back to the
pages is split where it is skewed. Everything is built-in functions.

Defined results: a null url or one without ``://`` has an empty host and path; a null or empty html
adds no words; labels longer than ``LABEL`` characters, which no host name has, stay whole; of
equally likely splits the one whose last word is longest counts; words that were never seen say
nothing, and ties allow; without ruled urls the prior is the model; repeated rows each give their
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, lower_ascii, table

#: (verdict, host, start of the path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of hosts and paths to block and to allow, and words that say nothing: the prior.
LISTS = {
    "block": "ad ads adserver adult amateur bet bets betting bingo cam cams casino casinos cialis crack cracked dating drugs erotic escort escorts fetish gamble "
    "gambling hentai hookup jackpot keygen loans lottery malware naked nude payday phishing pills poker porn porno replica roulette sex sexy slot slots "
    "spam steroids torrent track tracker tracking viagra warez webcam win winner xxx",
    "allow": "academy archive art article articles bank biology book books center chemistry church city club coffee college community cooking design "
    "education energy engineering food foundation garden gallery health history hospital hotel institute journal kids kitchen lab law library "
    "literature market math medical museum music nature news nursery paper park physics poetry press project radio recipes research review school "
    "science sports story studio team theatre tech times travel tutorial university village weather wiki world",
}
NEUTRAL = "www m blog en de fr es it com org net edu gov info co uk io example html htm php index page home 0 x"
#: Odds that a name is to be blocked before its words are read.
PRIOR = 0.25
#: Hosts that a listed word is worth; hosts a learned word must stand under and standard errors it must be off.
LISTED, SEEN, SURE = 4.0, 8, 3.0
#: Folds of hosts and the one held out.
FOLDS, HELD = 4, 2
#: Hashed counts of the classifier, added count, characters of a word and of a host label at most.
BUCKETS, SMOOTH, WORD, LABEL = 1 << 14, 0.1, 24, 63


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    there = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(there, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, from columns host and path; of equally long ones a blocking one."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    fits = lambda r: ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
    return F.coalesce(*[F.when(fits(r), F.lit(r[1] + r[2])) for r in order]), F.coalesce(*[F.when(fits(r), F.lit(r[0])) for r in order])


# ------------------------------------------------------------------ segmentation


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of the words in all pages' text, each listed word once more."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), "<[^<>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"\P{L}+")).alias("word")).where(F.char_length("word").between(1, WORD))
    known = F.array(*[F.lit(w) for w in sorted({w for side in LISTS.values() for w in side.split()})])
    return words.union(pages.sparkSession.range(1).select(F.explode(known).alias("word"))).groupBy("word").agg(F.count("*").alias("n"))


def costs(total: int) -> tuple[float, float]:
    """What an unknown word costs, and what each of its characters costs on top."""
    return math.log(10.0 / max(total, 10)), math.log(10.0)


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, tokens): the words of every host, labels in order."""
    labels = hosts.select("host", F.posexplode(F.split("host", r"[.-]", -1)).alias("at", "label")).where("label <> ''")
    distinct = labels.select("label").distinct()
    starts = distinct.where(F.char_length("label") <= LABEL).select("label", F.explode(F.sequence(F.lit(0), F.char_length("label") - 1)).alias("start"))
    ends = starts.select("label", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + WORD, F.char_length("label")))).alias("end"))
    pieces = ends.select("label", "start", "end", F.substring("label", F.col("start") + 1, F.col("end") - F.col("start")).alias("word"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    likely = F.log(F.col("n") / F.lit(float(max(total, 1))))
    found = pieces.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("start", "end", likely.alias("score"))).alias("words"))
    split = distinct.join(found, "label", "left").select("label", _split(F.col("label"), F.coalesce("words", F.array().cast("array<struct<start:int,end:int,score:double>>")), total).alias("tokens"))
    return labels.join(checkpoint(split), "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])).alias("tokens"))


def _split(label: Column, words: Column, total: int) -> Column:
    """The likeliest words of a label, by Viterbi: the best way to each place, then back from the end."""
    unknown, each = costs(total)
    n = F.char_length(label)
    way = "struct<score:double,from:int>"

    def reach(ways: Column, end: Column) -> Column:
        before = lambda start: F.get(ways, start)["score"]
        known = F.transform(F.filter(words, lambda w: w["end"] == end), lambda w: F.struct((before(w["start"]) + w["score"]).alias("score"), (-w["start"]).alias("from")))
        other = F.transform(F.sequence(F.lit(0), end - 1), lambda s: F.struct((before(s) + (F.lit(unknown) - (end - s) * F.lit(each))).alias("score"), (-s).alias("from")))
        return F.concat(ways, F.array(F.array_max(F.concat(known, other)).cast(way)))

    ways = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")).cast(way)), reach)

    def back(cut: Column, end: Column) -> Column:
        start = -F.get(cut["ways"], end)["from"]
        here = F.struct(cut["ways"].alias("ways"), start.alias("at"), F.concat(F.array(F.substring(label, start + 1, end - start)), cut["out"]).alias("out"))
        return F.when(cut["at"] == end, here).otherwise(cut)

    begin = F.struct(ways.alias("ways"), n.alias("at"), F.array().cast("array<string>").alias("out"))
    tokens = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), begin, back, lambda cut: cut["out"])
    return F.when(n > LABEL, F.array(label)).otherwise(tokens)


# ------------------------------------------------------------------ the classifier


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def path_tokens(path: Column) -> Column:
    """Words of a path; numbers are all alike."""
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}++|\p{N}++"), F.lit(0)), lambda t: F.regexp_replace(t, r"^\p{N}+$", "0"))


def held_out(host: Column) -> Column:
    return F.crc32(host.cast("binary")) % FOLDS == HELD


def _buckets(spark: SparkSession, *lists: str) -> list[list[int]]:
    return list(spark.range(1).select(*[hashed(F.split(F.lit(words), " ")) for words in lists]).first())


def trained(told: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, lists: dict[str, str] = LISTS) -> np.ndarray:
    """For each hashed word its log odds of block over allow, from (host, verdict, at); at are the buckets of a url's words."""
    spark = told.sparkSession
    seen = told.where(~held_out(F.col("host"))).select("host", "verdict", F.explode("at").alias("at")).distinct()
    counted = seen.groupBy("at").agg(F.countDistinct("host").alias("hosts"), *[F.count_if(F.col("verdict") == v).alias(v) for v in lists])
    side = {v: np.full(BUCKETS, SMOOTH) for v in lists}
    found = counted.where(F.col("hosts") >= SEEN).collect()  # BUCKETS rows at most
    base = math.log((sum(r["block"] for r in found) + SMOOTH) / (sum(r["allow"] for r in found) + SMOOTH))
    for r in found:
        b, a = r["block"] + SMOOTH, r["allow"] + SMOOTH
        if abs(math.log(b / a) - base) >= SURE * math.sqrt(1 / a + 1 / b):
            side["block"][r["at"]] += r["block"]
            side["allow"][r["at"]] += r["allow"]
    named = " ".join(w for _, host, path in rules for w in (host + path).replace("/", " ").replace(".", " ").split())
    at = _buckets(spark, *[words + " " + NEUTRAL for words in lists.values()], named)
    for v, own in zip(lists, at, strict=False):
        np.add.at(side[v], own, LISTED)
    odds = np.log(side["block"] / side["block"].sum()) - np.log(side["allow"] / side["allow"].sum())
    never = np.log(side["allow"].sum() / side["block"].sum())
    odds[(side["block"] == SMOOTH) & (side["allow"] == SMOOTH)] = never
    odds[at[-1]] = never
    return odds - never


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, lists: dict[str, str] = LISTS, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; score is the classifier's log odds of block."""
    host, path = parsed(F.col(url))
    rule, verdict = ruled(rules)
    rows = pages.select(key, host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("told", verdict)
    hosts = checkpoint(rows.groupBy("host").agg(F.count("*").alias("n")))
    words = segmented(hosts.select("host"), checkpoint(word_counts(pages, html)))
    by_host = checkpoint(words.select("host", hashed(F.col("tokens")).alias("host_at")))
    urls = rows.where("told is not null").select("host", F.col("told").alias("verdict"), F.explode(F.array_distinct(hashed(path_tokens(F.col("path"))))).alias("at")).distinct()
    paths = urls.groupBy("host", "verdict").agg(F.collect_set("at").alias("at"))
    sides = rows.where("told is not null").select("host", F.col("told").alias("verdict")).distinct()
    told = sides.join(by_host.withColumnRenamed("host_at", "at"), "host").unionByName(paths)
    odds = trained(told, rules, lists)
    # One constant of BUCKETS numbers, folded when the plan is made.
    weights = F.from_json(F.lit(json.dumps(odds.tolist())), "array<double>")
    score = lambda at: F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    host_score = checkpoint(by_host.select("host", score(F.col("host_at")).alias("host_score")))
    both = rows.join(host_score, "host", "left").withColumn("path_score", score(hashed(path_tokens(F.col("path")))))
    total = F.coalesce("host_score", F.lit(0.0)) + F.col("path_score") + math.log(PRIOR)
    return both.select(key, "host", "path", "rule", F.coalesce("told", F.when(total > 0, "block").otherwise("allow")).alias("verdict"), total.alias("score"))


def accuracy(found: DataFrame) -> DataFrame:
    """(verdict, urls, right): how often the classifier alone agrees with the rules on hosts it didn't learn from."""
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return found.where(F.col("rule").isNotNull() & held_out(F.col("host"))).groupBy("verdict").agg(F.count("*").alias("urls"), F.count_if(own == F.col("verdict")).alias("right"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", ("page_id", "url", "html"))).drop("score")
