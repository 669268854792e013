"""Reading by pages, the sink of files, and progress."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dml, numbering
from lodestone.sources import files, pages
from lodestone.streaming import ingest, progress


@pytest.fixture
def reader():
    """A counter and a reader of pages between form feeds, made here since workers don't have this module."""

    def count(blob):
        if blob == b"bad":
            raise ValueError("not a document")
        return blob.count(b"\f") + 1

    def read(blob, page):
        for w in blob.decode().split("\f")[page - 1].split():
            if w == "boom":
                raise RuntimeError(f"page {page}")
            yield {"page_w": 1.0, "page_h": 1.0, "text": w, "x0": 0.0, "x1": 1.0, "top": 0.0, "bottom": 1.0}

    return count, read


@pytest.mark.parametrize("run", [1, 2, 32])
def test_a_bad_page_loses_itself_only(spark, reader, run):
    docs = [("a", b"w1\fw2 boom w3\fw4\f\fw5 w6"), ("b", b"bad"), ("c", b"x"), ("d", None), ("e", b"")]
    words, errors = pages.page_words(spark.createDataFrame(docs, "path string, content binary"), *reader, pages=run)
    assert sorted((r["doc_id"], r["page"], r["text"]) for r in words.collect()) == [("a", 1, "w1"), ("a", 3, "w4"), ("a", 5, "w5"), ("a", 5, "w6"), ("c", 1, "x")]
    assert sorted(map(str, errors.collect())) == sorted(["Row(doc_id='a', page=2, error='page 2')", "Row(doc_id='b', page=None, error='not a document')"])
    words, errors = pages.page_words(spark.createDataFrame(docs, "path string, content binary"), *reader, start_page=3, pages=run)
    assert words.count() == 3 and errors.count() == 1


def there(path):
    return {p.name: p.read_bytes() for p in path.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_files_are_there_at_once_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i}.bin", bytes([i]) * i) for i in range(40)] + [("none", None)], "file string, content binary").repartition(4)
    files.write(rows, str(out))
    want = {f"{i}.bin": bytes([i]) * i for i in range(40)} | {"none": b""}
    assert there(out) == want
    bad = rows.withColumn("file", F.when(F.col("file") == "7.bin", "a/b").otherwise(F.concat(F.lit("new-"), "file")))
    with pytest.raises(Exception, match="no name of a file"):
        files.write(bad, str(out))
    assert there(out) == want and not any((out / files.WRITING).rglob("*.bin"))
    files.write(rows.limit(3), str(out), overwrite=True)
    assert len(there(out)) == 3
    files.write(rows.limit(0), str(out))
    assert len(there(out)) == 3


def test_a_task_that_ran_twice_leaves_one_copy(tmp_path):
    from pyspark.sql import Row

    writer = files.FilesWriter(str(tmp_path / "o"), False)
    rows = [Row(file="a", content=b"1"), Row(file="b", content=b"2")]
    writer.write(iter(rows[:1]))  # an attempt that was lost half-way
    kept = writer.write(iter(rows))
    writer.write(iter(rows))  # one that was not needed
    writer.commit([kept, writer.write(iter([])), None])
    assert there(tmp_path / "o") == {"a": b"1", "b": b"2"} and kept.files == 2


def test_steps(spark, tmp_path):
    said = []
    steps = progress.Steps(said.append)
    got = steps.done("inserting", spark.range(50).repartition(3), lambda df: df.write.parquet(f"{tmp_path}/t"), total=200, most=F.max("id"))
    assert got == {"current": 50, "most": 49} and spark.read.parquet(f"{tmp_path}/t").count() == 50
    with pytest.raises(Exception, match="exists"):
        steps.done("inserting", spark.range(1), lambda df: df.write.parquet(f"{tmp_path}/t"))
    lines = list(map(json.loads, said))
    assert lines[0] == {"status": "inserting", "current": 50, "total": 200, "percentage": 25, "most": 49} and lines[1]["status"] == "error"
    assert json.loads(progress.line("x", 1, 0)) == {"status": "x", "current": 1, "total": 0}


def test_stream_reports_each_batch(spark, tmp_path):
    catalog, said = dml.Catalog(spark, str(tmp_path / "cat")), []
    catalog.commit("t", spark.createDataFrame([], "id long, serial_number string, over string, keep string"))
    feed = spark.createDataFrame([(i, f"s{i}", "o", "k") for i in range(6)], "seq long, serial_number string, over string, keep string")
    feed.coalesce(1).write.parquet(str(tmp_path / "in"))
    listener = progress.Listener(said.append, total=12)
    spark.streams.addListener(listener)
    try:
        ingest.upsert_stream(spark, str(tmp_path / "in"), feed.schema, catalog, "t", str(tmp_path / "ck"), overwrite=("over",), keep=("keep",)).awaitTermination(90)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    lines = list(map(json.loads, said))
    assert lines[0]["status"] == "started" and lines[-1]["status"] == "complete"
    assert [x for x in lines if x["status"] == "t"][-1] == {"status": "t", "current": 6, "total": 12, "percentage": 50, "batch": 0} and catalog.read("t").count() == 6


@pytest.mark.parametrize("n", [0, 1, 700])
def test_numbers_are_dense_and_in_order(spark, tmp_path, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 701).alias("k"), F.lit("x").alias("seq2")).repartition(5)
    got = sorted((r["k"], r["seq"]) for r in numbering.numbered(rows, ["k"], f"{tmp_path}/n", first=3).collect())
    assert [s for _, s in got] == list(range(3, n + 3))


def test_texts_and_pictures_go_in_small_batches(spark, smallest):
    """Python workers hold whole Arrow batches, so queries over texts and pictures lower their rows."""
    from lodestone.registry import queries

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query in ("page_errors", "picture_operators"):
            spark.conf.set(name, "10000")
            queries()[query](spark, smallest)
            assert int(spark.conf.get(name)) <= 512, query
    finally:
        spark.conf.set(name, before)
