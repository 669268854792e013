"""Batch comparison: candidates from two indexes, one lookup, fused scores, the best of each query, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.functions import text as X
from lodestone.operators import aggregates as A
from lodestone.operators import joins as J
from lodestone.operators import knn as K

# Neighbours taken from each index, matches returned to a screen and to a report.
TEXT_K, LOGO_K, SHOWN, REPORTED = 10, 20, 3, 20


def candidates(queries: DataFrame, corpus: DataFrame, text_k: int = TEXT_K, logo_k: int = LOGO_K) -> DataFrame:
    """(qid, id, t, l): the union of both lists of neighbours; where a list lacks a pair, its score is 0.

    Queries and corpus have text_vec and logo_vec of unit length; null vectors find and are found by nothing.
    """
    text = K.nearest_each(queries, corpus, text_k, vector="text_vec")
    logo = K.nearest_each(queries, corpus, logo_k, vector="logo_vec")
    return J.merged_scores(text, logo, ["qid", "id"])


def scored(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, fuzzy: bool = True, compat: bool = False) -> DataFrame:
    """Candidate pairs that are kept, with text_sim and img_sim from 0 to 1.

    Queries: qid, serial_number, trademark_name, applicant_name, has_img, phash. Corpus: id,
    trademark_name, serial_number, phash, and what else a match shows. Only pairs past the gate
    reach the fuzzy ratio. With compat a query without names goes by its serial number.
    """
    name = X.first_filled(F.col("trademark_name"), F.col("applicant_name"), *([F.col("serial_number")] if compat else []))
    q = queries.select("qid", F.col("serial_number").alias("query_serial"), X.normalized(name).alias("q_name"), F.coalesce("has_img", F.lit(False)).alias("q_img"), F.col("phash").alias("q_hash"))
    gated = pairs.join(q, "qid").where((F.col("q_name") != "") | F.col("q_img")).where(S.passes_gate(F.col("q_img"), F.col("t"), F.col("l")))
    found = gated.join(corpus.withColumn("d_name", X.normalized(F.coalesce("trademark_name", F.lit("")))), "id")
    both = (F.col("q_name") != "") & (F.col("d_name") != "")
    ratio = F.when(both, S.sequence_ratio("q_name", "d_name")).otherwise(0.0) if fuzzy else F.lit(0.0)
    pixel = F.when(F.col("q_img"), S.hash_similarity(F.col("q_hash"), F.col("phash"))).otherwise(0.0)
    rated = found.withColumn("text_sim", S.text_score(S.literal(F.col("q_name"), F.col("d_name")), F.col("t"), ratio)).withColumn("img_sim", S.image_score(pixel, F.col("l")))
    least = S.threshold(F.col("q_name"))
    return rated.where((F.col("img_sim") >= least) | (F.col("text_sim") >= least))


def best(rated: DataFrame, k: int = REPORTED, exclude_self: bool = False) -> DataFrame:
    """The k best pairs of each query, by the larger score, ties by id."""
    rated = rated.where(F.col("id") != F.col("qid")) if exclude_self else rated
    return A.top_of_each(rated, ["qid"], [F.desc(F.greatest("img_sim", "text_sim")), F.asc("id")], k)


def compare(queries: DataFrame, corpus: DataFrame, fuzzy: bool = True, compat: bool = False, exclude_self: bool = False, phash: Column | None = None) -> DataFrame:
    """Ranked matches (qid, query_serial, rank, id, serial, label, text_sim, img_sim, …), one row each.

    phash makes the picture hash of a row that a candidate pair needs, where the corpus has none.
    """
    pairs = candidates(queries, corpus)
    rows = corpus if phash is None else corpus.join(pairs.select("id").distinct(), "id", "left_semi").withColumn("phash", phash)
    top = best(scored(pairs, queries, rows, fuzzy, compat), exclude_self=exclude_self)
    label = X.first_filled(F.col("trademark_name"), F.col("applicant_name"), F.col("serial_number"))
    shown = [c for c in ("description", "class_indices", "agent_details") if c in corpus.columns]
    return top.select("qid", "query_serial", "rank", "id", F.col("serial_number").alias("serial"), label.alias("label"), "text_sim", "img_sim", *shown)


def grouped(matches: DataFrame, shown: int = SHOWN) -> DataFrame:
    """One row for each query that has matches: the few that a screen shows, and all."""
    columns = [c for c in matches.columns if c not in ("qid", "query_serial", "rank")]
    return A.as_arrays(matches, ["qid", "query_serial"], columns, shown)


def tiered(matches: DataFrame) -> DataFrame:
    """Matches with percentages, a tier and a badge."""
    p = matches.withColumn("text_percent", S.percent(F.col("text_sim"))).withColumn("img_percent", S.percent(F.col("img_sim")))
    both = F.col("img_percent"), F.col("text_percent")
    return p.withColumn("tier", S.tier(*both)).withColumn("badge", S.has_badge(*both))


def report(matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matches of the high tier, those of the low one, and counts of both for each query."""
    t = tiered(matches)
    counts = t.groupBy("qid", "query_serial").agg(F.count_if(F.col("tier") == "high").alias("high"), F.count_if(F.col("tier") == "low").alias("low"), F.count("*").alias("matches"))
    return t.where("tier = 'high'"), t.where("tier = 'low'"), counts
