"""Queries of the search and comparison engine by name, with their SQL.

The tables stand in for the engine's own: parts for marks, benchmark passages for query items,
embeddings for logos, conversations for lines, events for feeds in time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import embedding as E
from lodestone.functions import images as I
from lodestone.functions import similarity as S
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import aggregates as A
from lodestone.operators import buckets, contain, dml, extract, pivots, search, segment, trigrams
from lodestone.operators import joins as J
from lodestone.operators import knn as K
from lodestone.plans import api
from lodestone.plans import compare as C
from lodestone.sources import files, pages, readers, writers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return readers.parquet(spark, f"{sf_dir}/{name}.parquet", *columns)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as marks."""
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.format_string("TM %010d", "p_partkey").alias("serial_number"), F.col("p_name").alias("trademark_name"), F.col("p_brand").alias("applicant_name"),
        F.col("p_type").alias("description"), F.col("p_size").cast("string").alias("class_indices"), (F.col("p_partkey") % 12).cast("string").alias("batch_number"), F.lit("2025").alias("batch_year"),
    )


_MARKS = """(SELECT p_partkey AS id, 'TM ' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS serial_number, p_name AS trademark_name, p_brand AS applicant_name,
  p_type AS description, CAST(p_size AS VARCHAR) AS class_indices, CAST(p_partkey % 12 AS VARCHAR) AS batch_number, '2025' AS batch_year FROM part)"""

#: The journal's records from its parts: a line holds twelve words before it leaves the page.
_RECORDS = """SELECT doc_id, page, class_y, serial_number, '1 January 2025' AS registration_date, '' AS trademark_name, class_indices, applicant_name, '1 ROAD' AS applicant_address, 'A & B' AS agent_details, description,
  round(0.80 + CASE WHEN length(description) > 50 THEN 0.20 ELSE 0 END, 6) AS completeness FROM (
  SELECT CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS VARCHAR) AS doc_id, CAST(floor(p_partkey % 40 / 2) AS INTEGER) AS page, 100.0 + p_partkey % 2 * 300 AS class_y, 'TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS serial_number,
    CAST(p_size AS VARCHAR) AS class_indices, upper(p_brand) || ' SDN BHD' AS applicant_name, array_to_string(list_slice(string_split(p_name || ' for all that is ' || p_type, ' '), 1, 12), ' ') AS description FROM part) WHERE page >= 1"""

# ------------------------------------------------------------------- neighbours


def _vector(spark: SparkSession, sf_dir: str, key: int = 0) -> list[float]:
    return _t(spark, sf_dir, "embeddings", "vec_id", "embedding").where(F.col("vec_id") == key).first()["embedding"]


_TOP10 = """SELECT vec_id, label, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM (
  SELECT e.vec_id, e.label, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 10"""


@_query(f"SELECT vec_id, rank, round(sim, 6) AS sim FROM ({_TOP10})")
def knn_topk_global(spark, sf_dir):
    near = K.nearest(_t(spark, sf_dir, "embeddings", "vec_id", "embedding"), _vector(spark, sf_dir), 10, "vec_id", "embedding")
    return K.ranked(near, "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@_query(f"SELECT vec_id, rank, round(sim, 6) AS sim FROM ({_TOP10})")
def knn_pivot_index(spark, sf_dir):
    """The same by an index of pivots, from the partitions that can hold one of the ten."""
    index = pivots.Index.build(_t(spark, sf_dir, "embeddings", "vec_id", "embedding"), f"{_shared(spark)}/pivots-{uuid.uuid4().hex}", "embedding", pivots=16, rings=8)
    near = index.nearest(_vector(spark, sf_dir), 10, "vec_id")
    return K.ranked(near, "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@_query(f"SELECT vec_id, rank, round(sim, 6) AS sim FROM ({_TOP10}) WHERE 1 - sim <= 0.70 AND label % 2 = 0")
def knn_threshold_postfilter(spark, sf_dir):
    near = K.nearest(_t(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), _vector(spark, sf_dir), 10, "vec_id", "embedding")
    found = K.within(K.ranked(near, "vec_id"), 0.70).where("label % 2 = 0")
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


_EACH = """SELECT q.vec_id AS qid, e.vec_id AS id, list_inner_product(CAST(q.{v} AS DOUBLE[]), CAST(e.{v} AS DOUBLE[])) AS sim,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.{v} AS DOUBLE[]), CAST(e.{v} AS DOUBLE[])) DESC, e.vec_id) AS rank
  FROM (SELECT * FROM {t} WHERE vec_id % 50 = 0) q, {t} e QUALIFY rank <= {k}"""


@_query(f"SELECT qid, id, rank, round(sim, 6) AS sim FROM ({_EACH.format(v='embedding', t='embeddings', k=10)})")
def knn_topk_batch(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    found = K.nearest_each(e.where("id % 50 = 0").withColumnRenamed("id", "qid"), e, 10, vector="embedding")
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


_HALVES = "(SELECT vec_id, label, list_slice(embedding, 1, 32) AS a, list_slice(embedding, 33, 64) AS b FROM embeddings)"
_MERGED = f"""SELECT qid, id, coalesce(max(t), 0.0) AS t, coalesce(max(l), 0.0) AS l FROM (
  SELECT qid, id, sim AS t, NULL AS l FROM ({_EACH.format(v="a", t=_HALVES, k=10)}) UNION ALL SELECT qid, id, NULL, sim FROM ({_EACH.format(v="b", t=_HALVES, k=20)})) GROUP BY qid, id"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks with two vectors each, and a hash that both engines compute alike."""
    e = _t(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("text_vec"), F.slice("embedding", 33, 32).alias("logo_vec"))
    hashed = ((F.col("id") % 97) * 2654435761 * 97).alias("phash")
    return _marks(spark, sf_dir).withColumn("agent_details", F.lit("n/a")).join(e, "id").select("*", hashed)


def _asked(items: DataFrame) -> DataFrame:
    """Every fiftieth item as a query; some have no name, some no picture."""
    named = F.when(F.col("id") % 150 != 0, F.col("trademark_name")).otherwise("")
    return items.where("id % 50 = 0").select(F.col("id").alias("qid"), "serial_number", named.alias("trademark_name"), F.lit("").alias("applicant_name"), (F.col("id") % 100 == 0).alias("has_img"), "phash", "text_vec", "logo_vec")


@_query(f"SELECT qid, id, round(t, 6) AS t, round(l, 6) AS l FROM ({_MERGED})")
def candidate_union_merge(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("text_vec"), F.slice("embedding", 33, 32).alias("logo_vec"))
    merged = C.candidates(e.where("id % 50 = 0").withColumnRenamed("id", "qid"), e)
    return merged.select("qid", "id", F.round("t", 6).alias("t"), F.round("l", 6).alias("l"))


@_query("SELECT DISTINCT id FROM (" + _MERGED + ")")
def candidate_ids(spark, sf_dir):
    return candidate_union_merge(spark, sf_dir).select("id").distinct()


_ITEMS = f"(SELECT m.*, (m.id % 97) * 2654435761 * 97 AS phash FROM {_MARKS} m WHERE m.id IN (SELECT vec_id FROM embeddings))"
_FUSED = f"""SELECT *, greatest(literal, 0.9 * t) AS text_sim, CASE WHEN raw > 0.92 THEN 1.0 ELSE raw END AS img_sim FROM (
  SELECT *, CASE WHEN pixel < 0.25 AND l > 0.70 THEN 0.4 * l ELSE greatest(l, pixel) END AS raw FROM (
  SELECT g.*, CASE WHEN q_name = '' OR d_name = '' THEN 0.0 WHEN q_name = d_name THEN 1.0 WHEN contains(q_name, d_name) OR contains(d_name, q_name) THEN 0.85 ELSE 0.0 END AS literal,
    CASE WHEN q_img THEN greatest(0.0, 1 - bit_count(xor(q_hash, phash)) / 64.0) ELSE 0.0 END AS pixel FROM (
  SELECT c.qid, c.id, c.t, c.l, q.phash AS q_hash, d.phash, c.qid % 100 = 0 AS q_img, d.serial_number AS serial,
    CASE WHEN c.qid % 150 <> 0 THEN regexp_replace(upper(q.trademark_name), '[^A-Z0-9]', '', 'g') ELSE '' END AS q_name, regexp_replace(upper(d.trademark_name), '[^A-Z0-9]', '', 'g') AS d_name
  FROM ({_MERGED}) c JOIN {_ITEMS} q ON q.id = c.qid JOIN {_ITEMS} d ON d.id = c.id) g
  WHERE (q_name <> '' OR q_img) AND (t >= 0.3 OR (q_img AND l >= 0.3))))"""
_KEPT = f"SELECT * FROM ({_FUSED}) WHERE greatest(img_sim, text_sim) >= CASE WHEN q_name <> '' THEN 0.35 ELSE 0.45 END"
_BEST = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY greatest(img_sim, text_sim) DESC, id) AS rank FROM ({_KEPT}) QUALIFY rank <= 20"


@_query(f"SELECT qid, id, rank, serial, round(text_sim, 6) AS text_sim, round(img_sim, 6) AS img_sim FROM ({_BEST})")
def fusion_scores_core(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = C.compare(_asked(items), items, fuzzy=False)
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), "serial", F.round("text_sim", 6).alias("text_sim"), F.round("img_sim", 6).alias("img_sim"))


@_query()
def compare_topk(spark, sf_dir):
    """The flagship: the whole comparison with the fuzzy ratio, which SQL can't express."""
    items = _items(spark, sf_dir)
    found = C.compare(_asked(items), items)
    return found.select("qid", "rank", "id", "serial", "label", F.round("text_sim", 6).alias("text_sim"), F.round("img_sim", 6).alias("img_sim"), "description")


@_query()
def compare_grouped(spark, sf_dir):
    items = _items(spark, sf_dir)
    return C.grouped(C.compare(_asked(items), items))


@_query(f"""SELECT qid, 'TM ' || lpad(CAST(qid AS VARCHAR), 10, '0') AS query_serial, count(*) FILTER (WHERE high) AS high, count(*) FILTER (WHERE NOT high) AS low, count(*) AS matches
  FROM (SELECT qid, round(img_sim * 100, 2) >= 70 OR round(text_sim * 100, 2) >= 70 AS high FROM ({_BEST})) GROUP BY qid""")
def report_tiers_grouped(spark, sf_dir):
    items = _items(spark, sf_dir)
    return C.report(C.compare(_asked(items), items, fuzzy=False))[2]


@_query()
def report_html(spark, sf_dir):
    items = _items(spark, sf_dir)
    return writers.report_html(C.tiered(C.compare(_asked(items), items)))


@_query()
def matches_json(spark, sf_dir):
    items = _items(spark, sf_dir)
    return writers.json_array(C.compare(_asked(items), items).select("qid", "rank", "id", "serial"), ["qid"])


# ---------------------------------------------------------------------- search


@_query(f"SELECT id, trademark_name, applicant_name FROM {_MARKS} WHERE trademark_name ILIKE '%bolt%' OR applicant_name ILIKE '%bolt%' OR description ILIKE '%bolt%' OR regexp_replace(serial_number, '\\s+', '', 'g') ILIKE '%bolt%'")
def text_search_ilike(spark, sf_dir):
    return search.search(_marks(spark, sf_dir), "bolt").select("id", "trademark_name", "applicant_name")


@_query("SELECT doc_id FROM documents WHERE text ILIKE '%licensed%'")
def document_search(spark, sf_dir):
    return _t(spark, sf_dir, "documents", "doc_id", "text").where(search.words_match("licensed", ("text",), serial=None)).select("doc_id")


_ASKED = ("licensed", "LICENSED under", "lic_nsed", "the%licen", "th", "@", "no such words")


@_query(" UNION ALL ".join(f"SELECT {i} AS asked, doc_id FROM documents WHERE text ILIKE '%{''.join(w.split())}%'" for i, w in enumerate(_ASKED)))
def trigram_search(spark, sf_dir):
    """Several searches by one trigram index of all texts: words, blanks, wildcards, words too short for it, and words that no text has."""
    index = trigrams.Index.build(_t(spark, sf_dir, "documents", "doc_id", "text"), f"{_shared(spark)}/trigrams-{uuid.uuid4().hex}", ("text",), serial=None, parts=32, buckets=16)
    return reduce(DataFrame.unionByName, [index.matches(w).select(F.lit(i).alias("asked"), "doc_id") for i, w in enumerate(_ASKED)])


@_query(f"SELECT id, trademark_name FROM {_MARKS} WHERE (regexp_replace(serial_number, '\\s+', '', 'g') ILIKE '%00012%' OR trademark_name ILIKE '%00012%' OR applicant_name ILIKE '%00012%' OR description ILIKE '%00012%') AND class_indices ILIKE '%1%'")
def trigram_search_marks(spark, sf_dir):
    """The search over marks by an index of all its columns; other filters hold as without one."""
    index = trigrams.Index.build(_marks(spark, sf_dir), f"{_shared(spark)}/trigrams-{uuid.uuid4().hex}", parts=32, buckets=16)
    return trigrams.search(index, "00 012", "1").select("id", "trademark_name")


@_query(f"SELECT id, serial_number FROM {_MARKS} WHERE regexp_replace(serial_number, '\\s+', '', 'g') ILIKE '%TM00000000_7%' OR trademark_name ILIKE '%TM00000000_7%' OR applicant_name ILIKE '%TM00000000_7%' OR description ILIKE '%TM00000000_7%'")
def serial_normalized_search(spark, sf_dir):
    return search.search(_marks(spark, sf_dir), "TM 00000000_7").select("id", "serial_number")


@_query(f"SELECT id, class_indices FROM {_MARKS} WHERE class_indices ILIKE '%9%'")
def class_filter_substring(spark, sf_dir):
    return search.search(_marks(spark, sf_dir), class_filter="9").select("id", "class_indices")


@_query(f"SELECT id, class_indices FROM {_MARKS} WHERE class_indices = '9'")
def class_filter_exact(spark, sf_dir):
    return search.search(_marks(spark, sf_dir), class_filter="9", exact_class=True).select("id", "class_indices")


@_query(f"SELECT id, trademark_name FROM {_MARKS} WHERE (serial_number ILIKE '%ring%' OR trademark_name ILIKE '%ring%' OR applicant_name ILIKE '%ring%' OR description ILIKE '%ring%') AND class_indices ILIKE '%1%' AND batch_number = '3' AND batch_year = '2025'")
def dynamic_predicates(spark, sf_dir):
    return search.search(_marks(spark, sf_dir), "ring", "1", batch="3", year="2025").select("id", "trademark_name")


@_query("SELECT o_orderkey AS id, o_orderdate, o_totalprice, o_orderstatus = 'F' AS has_logo FROM orders")
def listing_recent(spark, sf_dir):
    flagged = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.lit("x").cast("binary")).alias("logo_data"))
    return search.listed(flagged, "o_orderdate", "o_totalprice")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'file-' || o_orderkey || '.pdf' WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '/2025.pdf' WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'id-' || o_orderkey END AS display_name FROM orders""")
def listing_display_name(spark, sf_dir):
    k = F.col("o_orderkey")
    file, batch, serial = F.when(k % 5 == 0, F.concat(F.lit("file-"), k, F.lit(".pdf"))), F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(""), F.when(k % 2 == 0, F.col("o_orderpriority"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.display_label(file, batch, F.lit("2025"), serial, k).alias("display_name"))


@_query("SELECT c_custkey AS id, c_name AS applicant_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS upload_date FROM customer WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%' ORDER BY upload_date DESC NULLS FIRST, c_custkey DESC")
def listing_nulls_first(spark, sf_dir):
    uploaded = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("upload_date")
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("applicant_name"), F.col("c_mktsegment").alias("description"), uploaded)
    return search.search_clients(c, "7").select("id", "applicant_name", "upload_date")


@_query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS uploaded FROM customer ORDER BY uploaded DESC NULLS FIRST, c_custkey DESC")
def listing_clients(spark, sf_dir):
    """The whole listing, in order."""
    uploaded = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("upload_date")
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("id"), uploaded)
    return search.search_clients(c).select(F.col("id").alias("c_custkey"), F.col("upload_date").alias("uploaded"))


@_query("SELECT doc_id, text IS NOT NULL AS has_logo, coalesce(nullif(source, ''), 'N/A') AS source, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS preview FROM documents")
def has_blob_flag_and_defaults(spark, sf_dir):
    d = _t(spark, sf_dir, "documents", "doc_id", "text", "source")
    return d.select("doc_id", F.col("text").isNotNull().alias("has_logo"), X.or_na(F.col("source")).alias("source"), X.preview(F.col("text")).alias("preview"))


@_query("SELECT s_suppkey, coalesce(nullif(s_name, ''), 'no_name') AS name FROM supplier ORDER BY s_suppkey LIMIT 50")
def export_listing(spark, sf_dir):
    return _t(spark, sf_dir, "supplier", "s_suppkey", "s_name").select("s_suppkey", X.first_filled(F.col("s_name"), default="no_name").alias("name")).orderBy("s_suppkey").limit(50)


@_query("SELECT p_partkey AS id, p_name AS trademark_name FROM part WHERE p_partkey IN (3, 5, 8, 13, 999999999)")
def lookup_ids(spark, sf_dir):
    return search.with_ids(_marks(spark, sf_dir), [3, 5, 8, 13, 999999999]).select("id", "trademark_name")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_join_ids(spark, sf_dir):
    ids = _t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return search.with_ids(_t(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), ids, "o_custkey").select("o_orderkey")


# ---------------------------------------------------------------- similarities

_NORMAL = "regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g')"


@_query(f"""SELECT item_id, doc_id, CAST(CASE WHEN b.s = d.s THEN 1.0 ELSE 0.85 END AS DOUBLE) AS score FROM (SELECT item_id, {_NORMAL} AS s FROM benchmark) b, (SELECT doc_id, {_NORMAL} AS s FROM documents) d
  WHERE b.s <> '' AND d.s <> '' AND (contains(d.s, b.s) OR contains(b.s, d.s))""")
def containment_literal(spark, sf_dir):
    texts = readers.spread(_t(spark, sf_dir, "documents", "doc_id", "text"))
    return contain.literal_matches(_t(spark, sf_dir, "benchmark", "item_id", "text"), texts, "item_id", "doc_id")


@_query("""SELECT id, other, CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) AS score FROM (
  SELECT a.p_partkey AS id, b.p_partkey AS other, list_distinct(string_split(lower(a.p_name), ' ')) AS x, list_distinct(string_split(lower(b.p_name), ' ')) AS y FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey)""")
def token_jaccard(spark, sf_dir):
    m = _marks(spark, sf_dir).select("id", "trademark_name")
    other = m.select(F.col("id").alias("other"), (F.col("id") - 1).alias("id"), F.col("trademark_name").alias("b"))
    return m.join(other, "id").select("id", "other", S.jaccard(F.col("trademark_name"), F.col("b")).alias("score"))


@_query("SELECT p_partkey AS id, greatest(0.0, 1 - bit_count(xor(p_partkey * 2654435761, (p_partkey + 7) * 40503)) / 64.0) AS score FROM part")
def hamming_similarity(spark, sf_dir):
    return _marks(spark, sf_dir).select("id", S.hash_similarity(F.col("id") * 2654435761, (F.col("id") + 7) * 40503).alias("score"))


@_query()
def sequence_ratio(spark, sf_dir):
    m = _marks(spark, sf_dir).select("id", X.normalized(F.col("trademark_name")).alias("a"))
    other = m.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return m.join(other, "id").select("id", F.round(S.sequence_ratio("a", "b"), 6).alias("score"), S.python_percent(S.sequence_ratio("a", "b")).alias("percent"))


@_query("""SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_inner_product(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS unit_norm, len(list_filter(v, lambda x: x <> 0)) > 0 AS nonzero
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def vector_units(spark, sf_dir):
    e = K.usable(_t(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding")
    u = V.unit(F.col("embedding"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.dot(u, u), 6).alias("unit_norm"), V.is_nonzero(V.or_zeros(F.col("embedding"), 64)).alias("nonzero"))


@_query()
def embed_texts(spark, sf_dir):
    m = _marks(spark, sf_dir)
    v = E.text_embedding(X.embeddable(X.combined(F.col("trademark_name"), F.col("description"))))
    return m.select("id", v.alias("v")).select("id", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 4).alias("norm"))


@_query()
def picture_operators(spark, sf_dir):
    """Pictures drawn from vectors: hash, crop, transparency, logo zone, embedding and scores against themselves."""

    @F.pandas_udf("binary")
    def drawn(vectors):
        import numpy as np
        import pandas as pd

        out = []
        for v in vectors:
            ink = (np.asarray(v, float).reshape(8, 8) * 255 * 3 % 200).astype("uint8")
            page = np.full((60, 80), 255, "uint8")
            page[6:38, 4:36] = np.kron(ink, np.ones((4, 4), "uint8"))
            out.append(I.encode(page))
        return pd.Series(out)

    readers.small_batches(spark)
    p = _t(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", drawn("embedding").alias("png"))
    size = lambda c: F.coalesce(F.length(c), F.lit(-1))
    return p.select(
        "vec_id", I.hash_of(F.col("png")).alias("phash"), I.is_picture(F.col("png")).alias("is_picture"), (size(I.picture(F.col("png"), I.tight_crop)) > 0).alias("cropped"), (size(I.picture(F.col("png"), I.without_white)) > 0).alias("cleared"),
        (size(I.logo_of(F.col("png"))) > 0).alias("logo"), (size(I.picture(F.col("png"), I.logo_beside_text, keep=True)) > 0).alias("split"), F.size(E.image_embedding(F.col("png"))).alias("dim"),
        I.pair_score(F.col("png"), F.col("png"), I.edge_similarity).alias("edges"), F.round(I.pair_score(F.col("png"), F.col("png"), I.key_point_score), 3).alias("points"),
    )


# ---------------------------------------------------------------------- tables

_UPSERT_BATCH = "SELECT p_partkey, p_name || ' new' AS p_name, p_brand, p_type, p_partkey AS seq FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name || ' newer', p_brand || '!', p_type || '!', p_partkey + 1000000000 FROM part WHERE p_partkey % 4 = 0"


@_query(f"""SELECT coalesce(c.p_partkey, b.key) AS p_partkey, CASE WHEN b.key IS NULL THEN c.p_name ELSE b.name END AS p_name, CASE WHEN c.p_partkey IS NULL THEN b.brand ELSE c.p_brand END AS p_brand
  FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) c FULL JOIN (SELECT p_partkey AS key, arg_max(p_name, seq) AS name, arg_min(p_brand, seq) AS brand FROM ({_UPSERT_BATCH}) GROUP BY 1) b ON c.p_partkey = b.key""")
def upsert_snapshot(spark, sf_dir):
    part = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    one = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat("p_name", F.lit(" new")).alias("p_name"), "p_brand", F.col("p_partkey").alias("seq"))
    two = part.where("p_partkey % 4 = 0").select("p_partkey", F.concat("p_name", F.lit(" newer")).alias("p_name"), F.concat("p_brand", F.lit("!")).alias("p_brand"), (F.col("p_partkey") + 1000000000).alias("seq"))
    return dml.upserted(part.where("p_partkey % 3 <> 0"), one.unionByName(two), "p_partkey", overwrite=("p_name",), keep=("p_brand",), id_column=None)


@_query("""SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS VARCHAR) AS serial_number, CASE WHEN p_partkey % 100 = 1 THEN p_name || ' new' ELSE p_name END AS over, p_brand AS keep FROM part WHERE p_partkey % 10 <> 3
  UNION ALL SELECT CAST((SELECT max(p_partkey) FROM part WHERE p_partkey % 10 <> 0) + 1 AS BIGINT), 'fresh', 'f', 'g'""")
def upsert_buckets(spark, sf_dir):
    """A table in buckets after an insert of two halves, an upsert of one in a hundred rows and a new one, and a delete."""
    part = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_partkey").cast("string").alias("serial_number"), F.col("p_name").alias("over"), F.col("p_brand").alias("keep"))
    table = buckets.Table(dml.Catalog(spark, _engine(spark).catalog.root), "parts")
    table.create(part.schema, "serial_number", 16)
    table.insert(part.where("id % 10 <> 0"))
    changed = part.where("id % 100 = 1").select("serial_number", F.concat("over", F.lit(" new")).alias("over"), F.lit("other").alias("keep"), F.col("id").alias("seq"))
    fresh = spark.range(1).select(F.lit("fresh").alias("serial_number"), F.lit("f").alias("over"), F.lit("g").alias("keep"), F.lit(0).cast("long").alias("seq"))
    table.upsert(changed.unionByName(fresh), overwrite=("over",), keep=("keep",))
    table.insert(part.where("id % 10 = 0"))
    table.delete(part.where("id % 10 = 3").select("id"))
    return table.read()


@_query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_antijoin(spark, sf_dir):
    gone = _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return dml.deleted(_t(spark, sf_dir, "orders"), gone, "o_custkey")


@_query("SELECT c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return search.blob(_t(spark, sf_dir, "customer", "c_custkey", "c_name"), 42, "c_name", "c_custkey")


def _shared(spark) -> str:
    """The folder that executors share."""
    return spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")


def _engine(spark) -> api.Engine:
    """An engine over a new catalog in the shared folder."""
    return api.Engine(dml.Catalog(spark, f"{_shared(spark)}/catalog-{uuid.uuid4().hex}"))


@_query("SELECT n_nationkey AS id, n_name AS username, lower(n_name) || '@example.org' AS email, CASE n_nationkey WHEN 3 THEN 'editor' ELSE 'user' END AS role FROM nation WHERE n_nationkey <> 5 ORDER BY id")
def listing_ascending(spark, sf_dir):
    """Users of a catalog after an insert, an update and a delete."""
    e, n = _engine(spark), F.col("n_name")
    users = _t(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), n.alias("username"), F.concat(F.lower(n), F.lit("@example.org")).alias("email"), F.lit("x").alias("password_hash"),
        F.lit("user").alias("role"), F.lit(True).alias("is_temporary_password"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    e.add_user(users)
    e.set_role(3, "editor")
    e.set_password(4, "y")
    e.delete_user(5)
    return e.users()


@_query("SELECT n_nationkey AS id, 'user' AS role, TRUE AS is_temporary_password FROM nation WHERE n_name = 'CANADA'")
def user_by_email(spark, sf_dir):
    e = _engine(spark)
    n = F.col("n_name")
    e.add_user(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), n.alias("username"), F.concat(F.lower(n), F.lit("@example.org")).alias("email"), F.lit("x").alias("password_hash"), F.lit("user").alias("role"), F.lit(True).alias("is_temporary_password"), F.lit(None).cast("timestamp").alias("created_at")))
    return e.user_by_email("canada@example.org").select("id", "role", "is_temporary_password")


#: Marks of a catalog: logos of every tenth lie near that of mark 50, some within a tenth and some beyond.
_STORED = """(SELECT m.*, CASE WHEN id % 3 = 0 THEN 'OTHER' ELSE 'MYIPO' END AS category, CASE WHEN id % 2 = 0 THEN trademark_name END AS logo, id % 10 = 0 AS near,
  list_transform(raw, lambda x: CAST(x / sqrt(list_inner_product(raw, raw)) AS FLOAT)) AS vec FROM (
  SELECT m.*, list_transform(range(1, 33), lambda i: CASE WHEN m.id % 10 = 0 THEN CAST(o.embedding[32 + i] AS DOUBLE) + m.id % 7 * CAST(0.1 AS DOUBLE) * CAST(e.embedding[32 + i] AS DOUBLE) ELSE CAST(e.embedding[32 + i] AS DOUBLE) END) AS raw
  FROM {marks} m JOIN embeddings e ON e.vec_id = m.id, (SELECT embedding FROM embeddings WHERE vec_id = 50) o) m)""".format(marks=_MARKS)


def _stocked(spark, sf_dir) -> api.Engine:
    """An engine whose tables hold marks, and clients from suppliers."""
    e = _engine(spark)
    rows = _t(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("text_embedding"), F.slice("embedding", 33, 32).cast("array<double>").alias("raw"))
    o = F.array(*[F.lit(x) for x in _vector(spark, sf_dir, 50)[32:]])
    share = (F.col("id") % 7).cast("double") * F.lit(0.1)
    mixed = rows.withColumn("raw", F.when(F.col("id") % 10 == 0, F.zip_with(o, "raw", lambda a, b: a + share * b)).otherwise(F.col("raw")))
    marks = _marks(spark, sf_dir).join(mixed, "id").withColumns({
        "logo_embedding": V.unit(F.col("raw")), "category": F.when(F.col("id") % 3 == 0, "OTHER").otherwise("MYIPO"),
        "logo_data": F.when(F.col("id") % 2 == 0, F.col("trademark_name").cast("binary")),
    })
    there = {c.lower() for c in marks.columns}
    e.catalog.commit(api.MARKS, marks.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.MARKS]))
    clients = _t(spark, sf_dir, "supplier").select(F.col("s_name").cast("binary").alias("logo_data"), F.when(F.col("s_suppkey") % 3 > 0, F.array(F.lit(1.0), F.col("s_acctbal"))).cast("array<float>").alias("logo_embedding"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("applicant_name"), F.when(F.col("s_suppkey") % 5 > 0, F.format_string("of %d", "s_nationkey")).alias("description"))
    e.ingest_clients(clients, "suppliers.pdf")
    return e


@_query(f"SELECT id, CASE WHEN batch_number <> '' THEN batch_number || '/2025.pdf' END AS display_name, serial_number, logo IS NOT NULL AS has_logo FROM {_STORED} WHERE class_indices ILIKE '%1%' AND batch_number = '3' AND (trademark_name ILIKE '%a%' OR applicant_name ILIKE '%a%' OR description ILIKE '%a%' OR regexp_replace(serial_number, '\\s+', '', 'g') ILIKE '%a%')")
def engine_list_marks(spark, sf_dir):
    return _stocked(spark, sf_dir).list_marks("a", "1", "3", "2025").select("id", "display_name", "serial_number", "has_logo")


@_query(f"""SELECT id, serial_number, rank FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (
  SELECT s.*, list_inner_product(CAST(s.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) AS sim FROM {_STORED} s, (SELECT vec FROM {_STORED} WHERE id = 50) q) QUALIFY rank <= 10) WHERE 1 - sim <= 0.10 AND class_indices ILIKE '%1%'""")
def engine_image_search(spark, sf_dir):
    """Marks within a tenth of a logo, of the ten nearest; the class filter comes after these are taken."""
    e = _stocked(spark, sf_dir)
    logo = search.blob(e.marks(), 50, "logo_embedding").first()[0]
    return e.image_search(logo, class_filter="1").select("id", "serial_number", F.col("rank").cast("long").alias("rank"))


@_query(f"""SELECT 'MYIPO' AS target, id, serial_number, trademark_name, applicant_name, class_indices, NULL AS agent_details, TRUE AS has_text FROM {_STORED} WHERE category = 'MYIPO'
  UNION ALL SELECT 'CLIENT', NULL, 'suppliers.pdf', name, name, NULL, 'Client Record', FALSE FROM (SELECT CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE 'suppliers.pdf' END AS name FROM supplier WHERE s_suppkey % 3 > 0)""")
def engine_corpus(spark, sf_dir):
    """What queries are compared with, of either target."""
    e = _stocked(spark, sf_dir)
    parts = [e.corpus(t).select(F.lit(t.upper()).alias("target"), F.when(F.lit(t != "client"), F.col("id")).alias("id"), "serial_number", "trademark_name", "applicant_name", "class_indices", "agent_details", F.col("text_vec").isNotNull().alias("has_text")) for t in ("myipo", "client")]
    return parts[0].unionByName(parts[1])


@_query(f"""SELECT 'OTHER' AS source, id AS qid, serial_number, trademark_name, description, vec IS NOT NULL AS has_logo FROM {_STORED} WHERE category = 'OTHER'
  UNION ALL SELECT 'CLIENT', row_number() OVER (ORDER BY n NULLS FIRST, d NULLS FIRST, s_suppkey), NULL, coalesce(n, 'suppliers.pdf'), coalesce(d, 'Extracted from PDF'), s_suppkey % 3 > 0
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS n, CASE WHEN s_suppkey % 5 > 0 THEN 'of ' || s_nationkey END AS d FROM supplier WHERE s_suppkey % 4 > 0)""")
def engine_query_items(spark, sf_dir):
    """What is compared, from a category and from the clients that have a name of their own; clients are numbered without gaps."""
    e = _stocked(spark, sf_dir)
    parts = [e.query_items(s).select(F.lit(s).alias("source"), "qid", "serial_number", "trademark_name", "description", F.col("logo_vec").isNotNull().alias("has_logo")) for s in ("OTHER", "CLIENT")]
    # Clients without a name come first; among them the order is that of the description, which is not unique.
    unnamed = e.clients().where("applicant_name = 'suppliers.pdf'").count()
    named = parts[1].where("trademark_name <> 'suppliers.pdf'").withColumn("qid", F.col("qid") - unnamed)
    return parts[0].unionByName(named)


@_query(f"SELECT 'logo' AS kind, id, logo AS content FROM {_STORED} WHERE id = 50 UNION ALL SELECT 'logo', id, logo FROM {_STORED} WHERE id = 51 UNION ALL SELECT 'evidence', id, NULL FROM {_STORED} WHERE id = 50")
def engine_get_blob(spark, sf_dir):
    e = _stocked(spark, sf_dir)
    asked = [("logo", 50), ("logo", 51), ("evidence", 50), ("client-logo", -1)]
    return reduce(DataFrame.unionByName, [e.get_blob(kind, i).toDF("content").select(F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("id"), F.col("content").cast("string").alias("content")) for kind, i in asked])


@_query(f"""SELECT row_number() OVER (ORDER BY doc_id, page, class_y) AS id, serial_number, class_indices, applicant_name, description, CASE WHEN half = 0 THEN '8' ELSE '7' END AS batch_number, '2025' AS batch_year, 'MYIPO' AS category, 384 AS dim
  FROM (SELECT *, CAST(substr(serial_number, 3) AS BIGINT) % 2 AS half FROM ({_RECORDS}))""")
def engine_ingest_journal(spark, sf_dir):
    """Marks after a journal is taken in, and after half of it is again, as another batch."""
    e, words = _engine(spark), _journal(spark, sf_dir)
    e.ingest_journal(words, batch="7", year="2025", start_page=1)
    e.ingest_journal(words.where("top < 400"), batch="8", year="2025", start_page=1)
    return e.marks().select("id", "serial_number", "class_indices", "applicant_name", "description", "batch_number", "batch_year", "category", F.size("text_embedding").alias("dim"))


@_query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, string_agg(o_orderkey, ',' ORDER BY rank) FILTER (rank <= 3) AS matches, string_agg(o_orderkey, ',' ORDER BY rank) AS all_matches FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20 GROUP BY o_custkey")
def topk_arrays(spark, sf_dir):
    top = A.top_of_each(_t(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 20)
    packed = A.as_arrays(top, ["o_custkey"], ["o_orderkey"], 3)
    keys = lambda c: F.array_join(F.transform(c, lambda x: x["o_orderkey"].cast("string")), ",").alias(c)
    return packed.select(F.col("o_custkey").cast("long").alias("o_custkey"), keys("matches"), keys("all_matches"))


@_query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name END AS name FROM part")
def translated_names(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(F.lit('Mark translation: "'), n, F.lit('".'))).when(k == 1, F.concat(F.lit("Mark transliteration: "), n, F.lit(" The mark is limited."))).when(k == 2, F.concat(F.lit('Mark: "'), n, F.lit('"')))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.translated_name(line).alias("name"))


@_query("SELECT count(*) AS deleted FROM supplier WHERE s_suppkey IN (1, 2, 3)")
def delete_count(spark, sf_dir):
    """How many rows a catalog's delete says that it removed."""
    catalog = dml.Catalog(spark, _engine(spark).catalog.root)
    catalog.commit("suppliers", _t(spark, sf_dir, "supplier", "s_suppkey"))
    ids = spark.createDataFrame([(1,), (2,), (3,), (-5,)], "s_suppkey long")
    return spark.range(1).select(F.lit(catalog.delete("suppliers", ids, "s_suppkey")).cast("long").alias("deleted"))


@_query("SELECT c_custkey, c_name, CASE WHEN c_custkey = 7 THEN 'editor' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark, sf_dir):
    return dml.updated(_t(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey") == 7, c_mktsegment=F.lit("editor"))


@_query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'NATION_100'")
def insert_unique(spark, sf_dir):
    n = _t(spark, sf_dir, "nation", "n_nationkey", "n_name")
    new = spark.createDataFrame([(100, "NATION_100"), (101, "NATION_3")], n.schema)
    return dml.inserted(n, new, ("n_name",))[0]


@_query("SELECT user_id, arg_min(event_id, ts) AS event_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY user_id")
def dedupe_first(spark, sf_dir):
    return A.first_of_each(_t(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


# ---------------------------------------------------------- order, ranges, groups


@_query("""SELECT event_id, previous, next FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM events) WHERE event_type = 'purchase'""")
def asof_prev_next(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return J.previous_and_next(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, ["user_id"], "ts", "click").select("event_id", "previous", "next")


@_query("""WITH clicks AS (SELECT ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY ts)
  SELECT e.event_id, p.click AS previous, n.click AS next FROM events e ASOF LEFT JOIN clicks p ON e.ts > p.ts ASOF LEFT JOIN clicks n ON e.ts < n.ts WHERE e.event_type = 'purchase'""")
def asof_without_key(spark, sf_dir):
    """The nearest click of anybody: one sequence of all events, cut into parts that carry their values on."""
    e = _t(spark, sf_dir, "events", "event_id", "event_type", "ts")
    clicks = e.where("event_type = 'click'").select("ts", F.col("event_id").alias("click"))
    return J.previous_and_next(e.where("event_type = 'purchase'").select("ts", "event_id"), clicks, [], "ts", "click", part_rows=1000).select("event_id", "previous", "next")


def _contained(spark, sf_dir, customers):
    items = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").select("o_orderkey", F.col("o_custkey").alias("page"), *[F.col("o_totalprice").alias(c) for c in ("x0", "x1")], *[F.lit(0.0).alias(c) for c in ("top", "bottom")])
    boxes = customers.select(F.col("c_custkey").alias("page"), "c_custkey", (F.col("c_acctbal") * 10).alias("bx0"), (F.col("c_acctbal") * 40).alias("bx1"), F.lit(0.0).alias("by0"), F.lit(0.0).alias("by1"))
    return J.inside(items, boxes, ["page"], axis="x").select("o_orderkey", "c_custkey")


@_query("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice >= c.c_acctbal * 10 AND o.o_totalprice <= c.c_acctbal * 40")
def range_containment(spark, sf_dir):
    return _contained(spark, sf_dir, _t(spark, sf_dir, "customer", "c_custkey", "c_acctbal"))


@_query("""SELECT l_orderkey, l_linenumber, b.key FROM lineitem JOIN (SELECT s_suppkey AS key, s_acctbal * 8 AS low, s_acctbal * 8 + s_suppkey % 40 * 10 AS high FROM supplier) b ON l_extendedprice BETWEEN low AND high""")
def interval_join(spark, sf_dir):
    """Prices in the ranges of all suppliers, without a key: one page holds everything."""
    flat = [F.lit(0.0).alias(c) for c in ("x0", "x1")]
    items = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").select("l_orderkey", "l_linenumber", *flat, F.col("l_extendedprice").alias("top"), F.col("l_extendedprice").alias("bottom"))
    low = F.col("s_acctbal") * 8
    boxes = _t(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").select(F.col("s_suppkey").alias("key"), F.lit(0.0).alias("bx0"), F.lit(0.0).alias("bx1"), low.alias("by0"), (low + F.col("s_suppkey") % 40 * 10).alias("by1"))
    return J.inside(items, boxes, []).select("l_orderkey", "l_linenumber", "key")


@_query("SELECT event_id, CAST(entry AS BIGINT) AS entry FROM (SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS entry FROM events) WHERE entry > 0")
def segments_without_key(spark, sf_dir):
    """All events as one sequence that purchases divide."""
    e = _t(spark, sf_dir, "events", "event_id", "event_type", "ts")
    return segment.segmented(e, [], "ts", F.col("event_type") == "purchase", part_rows=1000).select("event_id", "entry")


@_query("""SELECT conv_id, CAST(entry AS BIGINT) AS entry, count(*) AS lines FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations) WHERE entry > 0 GROUP BY ALL""")
def segment_by_marker(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return segment.segmented(c, ["conv_id"], "turn", F.col("role") == "user").groupBy("conv_id", "entry").agg(F.count("*").alias("lines"))


@_query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def argmax_per_group(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return A.best_of_each(items, ["l_suppkey"], [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber")])


@_query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 3""")
def topk_per_group(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = A.top_of_each(items, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@_query("""SELECT user_id, start, length FROM (SELECT user_id, min(event_id) AS start, count(*) AS length FROM (
  SELECT user_id, event_id, f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN value < 30 THEN 1 ELSE 0 END AS f FROM events)) WHERE f = 1 GROUP BY user_id, g)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1""")
def longest_run(spark, sf_dir):
    return A.widest_runs(_t(spark, sf_dir, "events", "user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") < 30)


@_query("SELECT conv_id, round(turn / 3.0, 1) AS y, string_agg(role, ' ' ORDER BY turn, role) AS line FROM conversations GROUP BY ALL")
def lines_from_words(spark, sf_dir):
    words = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role").select("conv_id", F.col("role").alias("text"), F.col("turn").cast("double").alias("x0"), (F.col("turn") / 3.0).alias("top"))
    return A.lines_of(words, ["conv_id"])


@_query("SELECT s_suppkey, n_name, coalesce(CASE WHEN s_acctbal > 4000 THEN s_name END, c_name) AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN customer ON c_custkey = s_suppkey")
def coalescing_lookup(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), "n_name")
    a = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 4000, F.col("s_name")).alias("name"))
    b = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return J.first_blob(s, a, b, "name").withColumnRenamed("id", "s_suppkey")


# ------------------------------------------------------------------ extraction

_LINE = "'CLASS : ' || p_size || ', 35  TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || ' ' || (1 + p_partkey % 28) || CASE WHEN p_partkey % 2 = 0 THEN ' January 2025' ELSE ' MAR 2024' END"


def _line() -> F.Column:
    k = F.col("p_partkey")
    return F.concat(F.lit("CLASS : "), F.col("p_size"), F.lit(", 35  TM"), F.lpad(k.cast("string"), 10, "0"), F.lit(" "), 1 + k % 28, F.when(k % 2 == 0, " January 2025").otherwise(" MAR 2024"))


@_query(f"""SELECT p_partkey, regexp_extract(line, '(?:TM|JV|WM|MM|[A-Z]{{2}})[0-9]{{8,12}}') AS serial_number, regexp_extract(line, '[0-9]{{1,2}} (?:January|MAR) [0-9]{{4}}') AS registration_date,
  trim(regexp_extract(line, 'CLASS\\s*:\\s*([0-9,\\s]+)', 1)) AS class_indices, CAST(make_date(CAST(CASE WHEN p_partkey % 2 = 0 THEN 2025 ELSE 2024 END AS BIGINT), CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END, 1 + p_partkey % 28) AS VARCHAR) AS day
  FROM (SELECT p_partkey, {_LINE} AS line FROM part)""")
def regex_field_extract(spark, sf_dir):
    lines = _t(spark, sf_dir, "part").select("p_partkey", _line().alias("line"))
    c = F.col("line")
    return lines.select("p_partkey", X.serial_of(c).alias("serial_number"), X.date_text(c).alias("registration_date"), X.class_text(c).alias("class_indices"), X.date_of(c).cast("string").alias("day"))


_NOTED = "'; ' || p_name || ' All included in Class ' || p_size || '. Mark translation: small thing. Registration of this Trademark is limited. CLASS : ' || p_size || ' ' || p_type || '  end'"


@_query(f"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, 'Mark\\s+translation:[^.]+\\.\\s*', '', 'g'), '(?i)Registration of this trademark[^.]+\\.', '', 'g'), '(?i)CLASS\\s*:\\s*[0-9,\\s]+', '', 'g'), '\\bCLASS\\s+[0-9]+\\b', '', 'g'), '\\s+', ' ', 'g')), '^[;:,. ]+', '') AS description,
  trim(regexp_replace(line, '(?i)All included in Class [0-9]+\\.?', '', 'g')) AS scrubbed FROM (SELECT p_partkey, {_NOTED} AS line FROM part)""")
def description_cleanup(spark, sf_dir):
    k = [F.lit("; "), F.col("p_name"), F.lit(" All included in Class "), F.col("p_size"), F.lit(". Mark translation: small thing. Registration of this Trademark is limited. CLASS : "), F.col("p_size"), F.lit(" "), F.col("p_type"), F.lit("  end")]
    lines = _t(spark, sf_dir, "part").select("p_partkey", F.concat(*k).alias("line"))
    return lines.select("p_partkey", X.clean_description(F.col("line")).alias("description"), X.scrubbed(F.col("line")).alias("scrubbed"))


@_query("""SELECT p_partkey, round(CAST(0.25 + CASE WHEN p_partkey % 2 = 0 THEN 0.10 ELSE 0 END + CASE WHEN p_size > 10 THEN 0.15 ELSE 0 END + 0.20 + CASE WHEN p_partkey % 5 = 0 THEN 0.10 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 0.20 ELSE 0 END AS DOUBLE), 6) AS score FROM part""")
def completeness_score(spark, sf_dir):
    k = F.col("p_partkey")
    record = {"serial_number": k.cast("string"), "registration_date": F.when(k % 2 == 0, "1 Jan 2025"), "class_indices": F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(""), "applicant_name": F.col("p_brand"), "agent_details": F.when(k % 5 == 0, "agent"), "description": F.when(k % 7 == 0, F.repeat(F.lit("x"), 51)).otherwise(F.repeat(F.lit("x"), 50))}
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(X.completeness(record), 6).alias("score"))


@_query("""SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS normalized, regexp_replace(p_name, '\\s+', '', 'g') AS spaceless, p_name || ' ' || p_type AS combined, regexp_replace(p_name || '?*', '[\\\\/*?:"<>|]', '', 'g') AS file_safe,
  p_type = upper(p_type) AND lower(p_type) <> p_type AS is_upper, CASE WHEN p_partkey % 2 = 0 THEN 'empty' ELSE p_name END AS embeddable FROM part""")
def text_functions(spark, sf_dir):
    n = F.col("p_name")
    odd = F.when(F.col("p_partkey") % 4 == 0, " n/a ").when(F.col("p_partkey") % 2 == 0, "  ").otherwise(n)
    return _t(spark, sf_dir, "part").select("p_partkey", X.normalized(n).alias("normalized"), X.without_spaces(n).alias("spaceless"), X.combined(n, F.col("p_type")).alias("combined"), X.file_safe(F.concat(n, F.lit("?*"))).alias("file_safe"), X.is_upper(F.col("p_type")).alias("is_upper"), X.embeddable(odd).alias("embeddable"))


@_query("""SELECT c_custkey, CASE WHEN n <= 2 THEN 'weak' WHEN n <= 4 THEN 'medium' ELSE 'strong' END AS strength, c_custkey % 2 = 0 AS is_email, c_custkey < 100 AS batch_ok, c_custkey % 60 + 2000 <= 2025 AND c_custkey % 7 > 0 AS year_ok FROM (
  SELECT c_custkey, (length(p) >= 8)::INT + regexp_matches(p, '[A-Z]')::INT + regexp_matches(p, '[a-z]')::INT + regexp_matches(p, '[0-9]')::INT + regexp_matches(p, '[!@#$%^&*(),.?":{}|<>]')::INT AS n FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment || '#a1' END AS p FROM customer))""")
def validation(spark, sf_dir):
    k = F.col("c_custkey")
    p = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.lower("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("#a1")))
    mail = F.when(k % 2 == 0, F.concat("c_name", F.lit("@example.org"))).when(k % 3 == 0, F.concat("c_name", F.lit("@example"))).otherwise(F.col("c_name"))
    year = F.concat(F.when(k % 7 == 0, "x").otherwise(""), (k % 60 + 2000).cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", X.password_strength(p).alias("strength"), X.is_email(mail).alias("is_email"), X.batch_is_valid(k.cast("string")).alias("batch_ok"), X.year_is_valid(year, F.lit(2025)).alias("year_ok"))


@_query("SELECT trim(split_part(line, ';', 1)) AS owner, trim(substr(line, strpos(line, ';') + 1)) AS address, id FROM (SELECT p_partkey AS id, p_brand || ' SDN ; ' || p_type || '; ' || p_size AS line FROM part)")
def owner_split(spark, sf_dir):
    line = F.concat("p_brand", F.lit(" SDN ; "), "p_type", F.lit("; "), F.col("p_size"))
    owner, address = X.owner_parts(line)
    return _t(spark, sf_dir, "part").where(X.has_company_word(line)).select(F.col("p_partkey").alias("id"), owner.alias("owner"), address.alias("address"))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts laid out as pages of words, two blocks on each."""
    k, half = F.col("p_partkey"), F.col("p_partkey") % 2
    lines = [F.concat(F.lit("CLASS : "), F.col("p_size")), F.concat(F.lit("TM"), F.lpad(k.cast("string"), 10, "0"), F.lit(" 1 January 2025")), F.concat("p_name", F.lit(" for all that is "), "p_type"), F.concat(F.upper("p_brand"), F.lit(" SDN BHD ; 1 ROAD")), F.lit("AGENT : A & B")]
    rows = _t(spark, sf_dir, "part").select(F.floor(k / 40).cast("string").alias("doc_id"), F.floor(k % 40 / 2).cast("int").alias("page"), half.alias("half"), F.posexplode(F.array(*lines)).alias("line_no", "line"))
    words = rows.select("doc_id", "page", "half", "line_no", F.posexplode(F.split("line", " ")).alias("at", "text"))
    top = 100.0 + F.col("half") * 300 + F.col("line_no") * 40
    return words.select("doc_id", "page", F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), "text", (F.col("at") * 50.0).alias("x0"), (F.col("at") * 50.0 + 40).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


@_query(f"SELECT doc_id, page, CAST(class_y AS DOUBLE) AS class_y, serial_number, registration_date, trademark_name, class_indices, applicant_name, applicant_address, agent_details, description, CAST(completeness AS DOUBLE) AS completeness FROM ({_RECORDS})")
def block_fields_parse(spark, sf_dir):
    return extract.records(_journal(spark, sf_dir)).withColumn("completeness", F.round("completeness", 6))


@_query(f"SELECT doc_id, page, records, CAST(floor(row_number() OVER (PARTITION BY doc_id ORDER BY page) * 100 / count(*) OVER (PARTITION BY doc_id)) AS INTEGER) AS percent FROM (SELECT doc_id, page, count(*) AS records FROM ({_RECORDS}) GROUP BY ALL)")
def extraction_progress(spark, sf_dir):
    words = _journal(spark, sf_dir)
    return extract.page_status(words, extract.records(words))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    entry = F.concat(F.lit("CLASS:"), F.col("p_size"), F.lit(" TM"), F.lpad(k.cast("string"), 10, "0"), F.lit(" 18 April 2025\n"), "p_name", F.lit(" of every kind\n"), "p_brand", F.lit(" COMPANY SDN BHD MALAYSIA;\nAGENT : one two three\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]), "")
    return _t(spark, sf_dir, "part").groupBy(F.floor(k / 20).cast("string").alias("doc_id")).agg(text.alias("text"))


#: What each part's entry says; a blank line before the next entry keeps the last line in either reading.
_ENTRIES = """SELECT CAST(p_size AS VARCHAR) AS class_index, 'TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS serial_number, '18 April 2025' AS application_date, '' AS priority_date, '' AS consent_numbers,
  p_name || ' of every kind' AS description, p_brand || ' COMPANY SDN BHD MALAYSIA;' AS company_name, 'one two three' AS agent_details FROM part"""


@_query(_ENTRIES)
def entry_records(spark, sf_dir):
    return extract.entry_records(readers.plain_pages(_plain(spark, sf_dir))).drop("at")


@_query(_ENTRIES)
def entry_records_compat(spark, sf_dir):
    return extract.entry_records(readers.plain_pages(_plain(spark, sf_dir)), compat=True).drop("at")


#: Contexts cut by place from each text, whose numbers are unique; a pattern that takes in what ends the agent stands for one that looks ahead.
_HITS = r"""WITH texts AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, max(p_partkey) AS latest, string_agg('CLASS:' || p_size || ' TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || ' 18 April 2025' || chr(10) || p_name || ' of every kind' || chr(10) || p_brand || ' COMPANY SDN BHD MALAYSIA;' || chr(10) || 'AGENT : one two three' || chr(10), '' ORDER BY p_partkey) AS text FROM part GROUP BY 1),
placed AS (SELECT text, serial_number, strpos(text, serial_number) AS place, CASE WHEN p_partkey = latest THEN 1000 ELSE 500 END AS reach FROM (SELECT p_partkey, CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, 'TM' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS serial_number FROM part) JOIN texts USING (doc_id)),
around AS (SELECT serial_number, substr(text, greatest(1, place - 500), place - greatest(1, place - 500) + 26 + reach) AS c FROM placed),
named AS (SELECT *, regexp_extract(substr(c, strpos(c, serial_number) + 12, 500), '[A-Z][^;
]{20,};') AS company, strpos(c, '18 April 2025') AS dated FROM around)
SELECT replace(trim(regexp_extract(substr(c, 1, 200), '(?i)CLASS\s*[:]?\s*([\d,\s]+)', 1)), ' ', '') AS class_index, serial_number, '18 April 2025' AS application_date, '' AS priority_date, '' AS consent_numbers,
  CASE WHEN dated > 1 AND company <> '' AND strpos(c, company) > dated THEN substr(trim(regexp_replace(substr(c, dated + 13, greatest(0, strpos(c, company) - dated - 13)), '\s+', ' ', 'g')), 1, 500) ELSE '' END AS description,
  company AS company_name, trim(regexp_extract(c, '(?is)AGENT\s*[:]?\s*(.*?)(?:
\s*
|
CLASS\s*[:]|
TM\d|
?\z)', 1), chr(10) || ' ') AS agent_details FROM named"""


@_query(_HITS)
def hit_records(spark, sf_dir):
    return extract.hit_records(_plain(spark, sf_dir)).drop("at")


_PAGE_LINES = 8


def _pages(blob: bytes) -> int:
    return -(-(blob.count(b"\n") + 1) // _PAGE_LINES)


def _page_words(blob: bytes, page: int) -> list[dict]:
    """The words of a page of lines, laid out on a grid; a page with a certain word can't be read."""
    lines = blob.decode().split("\n")[(page - 1) * _PAGE_LINES : page * _PAGE_LINES]
    if any("@" in x for x in lines):
        raise ValueError("damaged")
    return [{"page_w": 600.0, "page_h": 800.0, "text": w, "x0": 50.0 * i, "x1": 50.0 * i + 40, "top": 20.0 * y, "bottom": 20.0 * y + 10} for y, x in enumerate(lines) for i, w in enumerate(x.split(" ")) if w]


@_query(f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST((i - 1) // {_PAGE_LINES} + 1 AS INTEGER) AS page, CASE WHEN bool_or(contains(line, '@')) THEN 'damaged' ELSE 'read' END AS status,
    CASE WHEN bool_or(contains(line, '@')) THEN 0 ELSE CAST(sum(len(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS BIGINT) END AS words FROM lines GROUP BY ALL HAVING words > 0 OR status = 'damaged'""")
def page_errors(spark, sf_dir):
    """Texts read as documents of pages: the words of every page that can be read, and the pages that can't."""
    readers.small_batches(spark)
    texts = readers.spread(_t(spark, sf_dir, "documents", "doc_id", "text")).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    words, errors = pages.page_words(texts, _pages, _page_words)
    read = words.groupBy("doc_id", "page").agg(F.lit("read").alias("status"), F.count("*").alias("words"))
    return read.unionByName(errors.select("doc_id", "page", F.col("error").alias("status"), F.lit(0).cast("long").alias("words")))


@_query("SELECT s_suppkey || '_' || s_name || '.txt' AS file, CAST(length(s_name) AS BIGINT) AS bytes FROM supplier")
def file_for_each_row(spark, sf_dir):
    """A file for each supplier, written in two steps, read back."""
    path = f"{_shared(spark)}/files-{uuid.uuid4().hex}".removeprefix("file:")
    named = _t(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit("_"), X.file_safe(F.col("s_name"), 30), F.lit(".txt")).alias("file"), F.col("s_name").alias("content"))
    files.write(named, path)
    return readers.files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.length("content").cast("long").alias("bytes"))


@_query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment || ' \"q\", x' AS said FROM customer")
def csv_round_trip(spark, sf_dir):
    """Rows written as CSV with quotes and commas in them, read back."""
    path = f"{_shared(spark)}/csv-{uuid.uuid4().hex}"
    rows = _t(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").select("c_custkey", "c_name", "c_acctbal", F.concat("c_mktsegment", F.lit(' "q", x')).alias("said"))
    writers.csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_lines_round_trip(spark, sf_dir):
    """Rows written as JSON lines, read back."""
    path = f"{_shared(spark)}/json-{uuid.uuid4().hex}"
    rows = _t(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    writers.json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@_query("SELECT event_type, count(*) AS n, CAST(floor(count(*) * 100 / (SELECT count(*) FROM events)) AS INT) AS percent FROM events GROUP BY event_type")
def progress_percent(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_type")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", A.progress(F.col("n"), F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
