"""Indexes that let a search or a nearest-neighbour query read less, against plain scans."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import knn as K
from lodestone.operators import pivots, search, trigrams

WORDS = ["alpha", "Bravo", "char-lie", "DELTA", "écho", "ΟΔΟΣ", "100%", "a_b", "back\\slash", "😀😁😂x", "zz"]


@pytest.fixture(scope="module")
def marks(spark):
    rng = random.Random(8)
    rows = [(i, f"TM {i:05d} {i % 7}", " ".join(rng.choices(WORDS, k=3)), rng.choice([None, "", "Acme Sdn Bhd", "acme"]), "common words in all of them" + " rare needle" * (i == 77), str(i % 45)) for i in range(400)]
    rows += [rows[5]] * 3 + [(None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "id long, serial_number string, trademark_name string, applicant_name string, description string, class_indices string").repartition(3)


@pytest.fixture(scope="module")
def index(marks, tmp_path_factory):
    return trigrams.Index.build(marks, str(tmp_path_factory.mktemp("index") / "t"), parts=64, buckets=8)


@pytest.mark.parametrize("words", ["alpha", "ALPHA", "bravo char", "needle", "rare needle", "tm000", "TM 0004", "zz", "z", "al_ha", "%needle%common", "common%needle", "éch", "οδος", "οδο", "😀😁😂", "100\\%", "a\\_b", "k\\\\s", "nothing here", "%", "", None, "acme", "_____", "xyzxyzxyz"])
def test_index_changes_no_result(marks, index, words):
    for filters in ({}, {"class_filter": "3"}):
        want = search.search(marks, words, **filters).collect()
        got = trigrams.search(index, words, **filters).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    if words and words.strip():
        assert index.matches(words).count() == marks.where(search.words_match(words)).count()


def test_index_reads_little(index):
    files = lambda parts: index.rows().where(F.col("part").isin(parts)).select("_metadata.file_path").distinct().count()
    every = files(list(range(64)))
    assert index.parts_with("needle") and len(index.parts_with("needle")) == files(index.parts_with("needle")) == 1 < every / 10
    assert index.parts_with("xyzxyz") == [] and len(index.parts_with("zz")) == 64
    plan = index.narrowed("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan.replace("\n", "") or "PartitionFilters: [(part" in plan


def test_index_of_nothing(spark, marks, tmp_path):
    empty = trigrams.Index.build(marks.where("false"), f"{tmp_path}/t", parts=4, buckets=4)
    assert empty.matches("alpha").collect() == empty.matches("z").collect() == [] and empty.narrowed("al").columns == marks.columns


def test_postings_list_rows_together(spark, tmp_path):
    texts = spark.range(3000).select("id", F.concat(F.lit("Wörter 😀 that all rows have "), F.col("id")).alias("text"))
    index = trigrams.Index.build(texts.repartition(3), f"{tmp_path}/t", ("text",), serial=None, parts=8, buckets=4)
    posted = spark.read.parquet(f"{index.path}/postings")
    # 26 grams of the words, 2 with a blank before digits, 1000 of digits: in each of three tasks once at most.
    assert posted.count() <= 3 * 1200 < posted.agg(F.sum("n")).first()[0] == posted.agg(F.sum(F.size("rows"))).first()[0]
    assert posted.count() < 3000 * 26 / 10
    assert index.matches("😀%have").count() == 3000 and index.matches("örter😀").count() == 0 and index.matches("wÖrter").count() == 3000
    assert [r["id"] for r in index.matches("2345").collect()] == [2345]


def test_grams_are_put_together_in_any_pieces(monkeypatch):
    texts = [(7, "abcabc", None), (8, "bcab", "ab"), (7, "xabc", "\U0001f600bc")]
    batches = lambda: iter([pa.RecordBatch.from_pylist([dict(zip(("row", "a", "b"), t, strict=True)) for t in texts])])
    number = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(g))
    want = sorted((f, number(g), row) for row, *own in texts for f, t in enumerate(own) for g in {(t or "")[i : i + 3] for i in range(len(t or "") - 2)})
    for together in (1, 4, 1 << 21):
        monkeypatch.setattr(trigrams, "TOGETHER", together)
        got = [r for b in trigrams.posted(batches()) for r in b.to_pylist()]
        assert sorted((r["field"], r["gram"], row) for r in got for row in r["rows"]) == want and all(r["n"] == len(r["rows"]) for r in got)


def test_patterns_are_tried_only_where_all_their_runs_are(spark, tmp_path):
    """At each of 100,000 places of a run, the pattern alone looks through the rest of the text: minutes for these rows."""
    texts = [(i, "the" * 100_000 + ("licen" if i == 3 else "")) for i in range(8)]
    index = trigrams.Index.build(spark.createDataFrame(texts, "id long, text string"), f"{tmp_path}/t", ("text",), serial=None, parts=1, buckets=2)
    before = time.monotonic()
    assert [r["id"] for r in index.matches("THE%Licen").collect()] == [3] and time.monotonic() - before < 60
    assert index.promising("the%licen").count() == 1 and index.promising("the").count() == 8


def test_literal_runs():
    assert trigrams.literal_runs("%ab_c\\%d%%e\\\\f") == ["ab", "c%d", "e\\f"] and trigrams.literal_runs("%_") == []


# --------------------------------------------------------------------------------- pivots


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in (centres[i % 30] + rng.normal(scale=0.05, size=8)) * rng.uniform(0.9, 1.1)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(700)]  # a third of all rows are copies
    return rows + [(5000, [0.0] * 8), (5001, None), (5002, [float("-inf")] + [0.0] * 7)]


@pytest.fixture(scope="module")
def vectors(spark, clustered):
    return spark.createDataFrame(clustered, "id long, vector array<double>").repartition(3)


def test_pivots_change_no_result_and_read_little(spark, clustered, vectors, tmp_path):
    index = pivots.Index.build(vectors, f"{tmp_path}/p", pivots=32, rings=16)
    assert index.rows().count() == len(clustered) - 1 and index.rows().columns == vectors.columns
    assert sum(p.rows for p in index.parts) == len(clustered) - 1
    # An infinite component makes products that aren't numbers; a scan puts those first, and so does the index.
    plain = vectors.where("id <> 5002")
    own = pivots.Index.build(plain, f"{tmp_path}/q", pivots=32, rings=16)
    rng = np.random.default_rng(4)
    for q, k in [(clustered[7][1], 10), (clustered[0][1], 750), (rng.normal(size=8).tolist(), 5), ([0.0] * 8, 3), (clustered[11][1], 5000), ([-x for x in clustered[3][1]], 4)]:
        want = [tuple(r) for r in K.nearest(plain.where("vector is not null"), q, k).select("id", "sim").collect()]
        assert [tuple(r) for r in own.nearest(q, k).select("id", "sim").collect()] == want
    read = own.needed(clustered[7][1], 10)
    assert 0 < len(read) <= len(own.parts) / 4 and sum(p.rows for p in own.parts if p.part in read) < len(clustered) / 4
    assert index.needed(clustered[7][1], 10)[0] == pivots.ODD


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]])
def test_pivots_of_few_rows(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = pivots.Index.build(df, f"{tmp_path}/p")
    assert [r["id"] for r in index.nearest([1.0, 2.0], 3).collect()] == [i for i, v in rows if v]


def test_bounds_hold(clustered):
    rng = np.random.default_rng(5)
    v = np.array([x for _, x in clustered[:1500]])
    own = pivots.chosen(v / np.linalg.norm(v, axis=1, keepdims=True), 12)
    part, angle, length = pivots.placed(v, own, 6)
    index = pivots.Index(None, "", "v", None, own, 6, ())
    for q in [*rng.normal(size=(20, 8)), v[3], -v[3], own[0]]:
        for p in np.unique(part):
            at = part == p
            held = pivots.Part(int(p), int(at.sum()), (angle[at].min(), angle[at].max()), (length[at].min(), length[at].max()))
            assert (v[at] @ q).max() <= index.bound(q, held)
