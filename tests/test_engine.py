"""Similarities, neighbours, tables, pictures, sinks and the engine as a whole."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import images as I
from lodestone.functions import similarity as S
from lodestone.functions import text as X
from lodestone.operators import aggregates as A
from lodestone.operators import buckets, contain, dml, search
from lodestone.operators import joins as J
from lodestone.operators import knn as K
from lodestone.plans import api
from lodestone.plans import compare as C
from lodestone.sources import readers, writers
from lodestone.streaming import ingest

settings.register_profile("few", max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
settings.load_profile("few")


def test_sequence_ratio_is_difflib_and_not_symmetric(spark):
    rng = random.Random(4)
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), (None, "a"), ("A" * 250, "a" * 200 + "b")] + [("".join(rng.choice("abC ") for _ in range(9)), "".join(rng.choice("abC ") for _ in range(7))) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a string, b string").select(S.sequence_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for a, b in pairs]


def test_python_rounding(spark):
    got = spark.createDataFrame([(0.02675,), (0.01005,), (None,)], "x double").select(S.python_percent(F.col("x"))).collect()
    assert [r[0] for r in got] == [round(2.675, 2), round(1.005, 2), None]


def fused(t, l, pixel, name, other, image):
    """The rule in plain Python."""
    if not name and not image or (max(t, l) < 0.3 if image else t < 0.3):
        return None
    literal = 0.0 if not name or not other else 1.0 if name == other else 0.85 if name in other or other in name else 0.0
    fuzzy = difflib.SequenceMatcher(None, name.lower(), other.lower()).ratio() if name and other else 0.0
    text = max(literal, 0.9 * t, 0.95 * fuzzy)
    pixel = pixel if image else 0.0
    img = 0.4 * l if pixel < 0.25 and l > 0.70 else max(l, pixel)
    img = 1.0 if img > 0.92 else img
    least = 0.35 if name else 0.45
    return (text, img) if img >= least or text >= least else None


def test_fusion_rule(spark):
    rng = random.Random(1)
    cases = []
    for i in range(300):
        cases.append((i, i + 1000, rng.choice([0.0, 0.29, 0.3, 0.5, 0.95]), rng.choice([0.0, 0.3, 0.7, 0.71, 0.93]), rng.choice(["", "ACME", "TIDE"]), rng.choice(["", "ACME", "ACMEX", "DIET"]), rng.choice([True, False]), rng.choice([0, 5, -1, 2**62])))
    pairs = spark.createDataFrame([(c[0], c[1], c[2], c[3]) for c in cases], "qid long, id long, t double, l double")
    q = spark.createDataFrame([(c[0], "S", c[4], None, c[6], 0) for c in cases], "qid long, serial_number string, trademark_name string, applicant_name string, has_img boolean, phash long")
    d = spark.createDataFrame([(c[1], "D", c[5], None, c[7]) for c in cases], "id long, serial_number string, trademark_name string, applicant_name string, phash long")
    got = {r["qid"]: (r["text_sim"], r["img_sim"]) for r in C.scored(pairs, q, d).collect()}
    for i, _, t, l, name, other, image, h in cases:
        want = fused(t, l, max(0.0, 1 - (h & (2**64 - 1)).bit_count() / 64), name, other, image)
        assert (i in got) == (want is not None), i
        if want:
            assert got[i] == pytest.approx(want)


def test_nearest_each_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r["qid"], r["rank"]): r["id"] for r in K.nearest_each(df.where("id % 7 = 0").withColumnRenamed("id", "qid"), df, 5).collect()}
    for q in range(0, 60, 7):
        order = sorted(range(60), key=lambda i: (-float(v[q] @ v[i]), i))[:5]
        assert [got[q, k] for k in range(1, 6)] == order
    assert K.nearest_each(df.where("id < 0").withColumnRenamed("id", "qid"), df, 5).count() == 0
    assert [r["id"] for r in K.nearest(df.where("vector is not null"), [1.0, 0, 0, 0], 3).collect()] == sorted(range(60), key=lambda i: (-v[i][0], i))[:3]


def test_containment(spark):
    p = spark.createDataFrame([(1, "ab-c"), (2, "ABC"), (3, ""), (4, "bcd"), (5, None)], "item_id long, text string")
    t = spark.createDataFrame([(10, "x abc y"), (11, "a b c"), (12, "C"), (13, "zzz"), (14, None)], "doc_id long, text string")
    for chars in (contain.BLOCK_CHARS, 3):  # one block, and a grid
        got = sorted((r["item_id"], r["doc_id"], r["score"]) for r in contain.literal_matches(p, t, "item_id", "doc_id", block_chars=chars).collect())
        assert got == [(1, 10, 0.85), (1, 11, 1.0), (1, 12, 0.85), (2, 10, 0.85), (2, 11, 1.0), (2, 12, 0.85), (4, 12, 0.85)]


@given(st.lists(st.text("AB", min_size=1, max_size=5), max_size=12), st.text("AB", min_size=1, max_size=7))
def test_finder(passages, text):
    got = sorted(contain.Finder(list(enumerate(passages))).matches(text))
    assert got == [(i, 1.0 if p == text else 0.85) for i, p in enumerate(passages) if p in text or text in p]


def test_previous_and_next_is_strict(spark):
    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 5, "c"), ("j", 2, "d")], "k string, at int, name string")
    right = spark.createDataFrame([("k", 1, 10), ("k", 5, 50), ("k", 9, 90)], "k string, at int, v int")
    got = {r["name"]: (r["previous"], r["next"]) for r in J.previous_and_next(left, right, ["k"], "at", "v").collect()}
    assert got == {"a": (None, 50), "b": (10, 90), "c": (10, 90), "d": (None, None)}


marks = st.lists(st.tuples(st.integers(0, 5), st.text("ab", max_size=2), st.text("xy", max_size=2)), max_size=8)


@given(current=st.dictionaries(st.integers(0, 5), st.text("cd", max_size=2), max_size=5), batch=marks)
def test_upsert_against_one_by_one(spark, current, batch):
    table = {k: {"id": i, "over": v, "keep": v} for i, (k, v) in enumerate(current.items())}
    df = spark.createDataFrame([(r["id"], k, r["over"], r["keep"]) for k, r in table.items()], "id long, serial_number long, over string, keep string")
    rows = spark.createDataFrame([(n, k, a, b) for n, (k, a, b) in enumerate(batch)], "seq long, serial_number long, over string, keep string")
    for k, a, b in batch:
        if k in table:
            table[k]["over"] = a
        else:
            table[k] = {"id": None, "over": a, "keep": b}
    out = dml.upserted(df, rows, overwrite=("over",), keep=("keep",))
    got = {r["serial_number"]: r for r in out.collect()}
    assert {k: (r["over"], r["keep"]) for k, r in got.items()} == {k: (r["over"], r["keep"]) for k, r in table.items()}
    assert len({r["id"] for r in got.values()}) == len(got)
    again = {r["serial_number"]: (r["over"], r["keep"]) for r in dml.upserted(out, rows, overwrite=("over",), keep=("keep",)).collect()}
    assert again == {k: (r["over"], r["keep"]) for k, r in table.items()}


def test_catalog(spark, tmp_path):
    c = dml.Catalog(spark, str(tmp_path / "cat"))
    users = lambda *rows: spark.createDataFrame([(i, n, m, "h", "viewer", True, None) for i, n, m in rows], schema.USERS)
    c.create("users", schema.USERS)
    c.create("users", schema.USERS)
    assert c.version("users") == 1 and c.read("users").count() == 0
    c.insert("users", users((1, "a", "a@x"), (2, "b", "b@x")), ("username", "email"))
    with pytest.raises(ValueError):
        c.insert("users", users((3, "c", "a@x")), ("username", "email"))
    with pytest.raises(ValueError):
        c.insert("users", users((3, "c", "c@x"), (4, "c", "d@x")), ("username", "email"))
    c.update("users", F.col("id") == 2, role=F.lit("admin"))
    assert [r["role"] for r in c.read("users").orderBy("id").collect()] == ["viewer", "admin"]
    ids = spark.createDataFrame([(2,), (77,)], "id long")
    e = api.Engine(c)
    assert e.user_by_email("b@x").first()["role"] == "admin" and [r["id"] for r in e.users().collect()] == [1, 2]
    assert c.delete("users", ids) == 1
    assert [r["id"] for r in c.read("users").collect()] == [1] and c.version("users") == 4


def test_search_semantics(spark):
    rows = [(1, "T M1", "Acme Corp", None, "x", "9"), (2, "TM2", "ACMECORP", "o", None, "19, 3"), (3, "TM 3", None, None, None, None), (4, "TM4", "A_C", "", "", "3, 9")]
    df = spark.createDataFrame(rows, "id long, serial_number string, trademark_name string, applicant_name string, description string, class_indices string").withColumns({"batch_number": F.lit("1"), "batch_year": F.lit("2025")})
    ids = lambda **k: [r["id"] for r in search.search(df, **k).collect()]
    assert ids() == [4, 3, 2, 1]
    assert ids(words="Acme Corp") == [2]  # spaces are dropped from the words alone
    assert ids(words="Acme Corp", normalize_columns=True) == [2, 1]
    assert ids(words="tm1") == [1] and ids(words="tm3") == [3]
    assert ids(words="A_M") == [2, 1]  # wildcards stay wildcards
    assert ids(class_filter="9") == [4, 2, 1] and ids(class_filter="9", exact_class=True) == [4, 1]
    assert ids(ids=[]) == [] and ids(ids=[3, 1]) == [3, 1] and ids(ids=None, batch="1", year="2024") == []


def test_images():
    rng = np.random.default_rng(0)
    for shape in [(7, 9), (7, 9, 3), (7, 9, 4)]:
        p = rng.integers(0, 256, shape).astype(np.uint8)
        assert (I.decode(I.encode(p)) == p).all()
    assert (I.decode(b"P5\n3 2\n255\n" + bytes(range(6))) == np.arange(6).reshape(2, 3)).all()
    page = np.full((50, 90), 255, np.uint8)
    page[10:30, 5:25] = 0
    page[12:28, 60:80] = 100
    assert I.tight_crop(page).shape == (24, 79)
    assert I.logo_beside_text(page).shape[1] <= 26
    assert I.logo_zone(page).shape == (25, 30)
    assert I.logo_zone(np.full((9, 9), 255, np.uint8)) is None
    assert I.without_white(page)[:, :, 3].max() == 255
    parts = I.logo_parts(page)
    assert [x[:4] for x in parts] == [(10, 30, 5, 25), (12, 28, 60, 80)] and I.largest_part(parts)[:4] == (10, 30, 5, 25)
    assert I.has_picture(page) and not I.has_picture(np.full((5, 5), 200, np.uint8))
    assert I.longest_gap(np.array([0, 1, 1, 0, 1, 1, 1, 0], bool)) == (4, 3)
    noisy = np.clip(page.astype(int) + rng.integers(-3, 4, page.shape), 0, 255).astype(np.uint8)
    differ = lambda a, b: ((I.perceptual_hash(a) ^ I.perceptual_hash(b)) & (2**64 - 1)).bit_count()
    assert differ(page, noisy) < 20 < differ(page, page[::-1, ::-1])
    textured = rng.integers(0, 256, (60, 60)).repeat(2, 0).repeat(2, 1).astype(np.uint8)
    assert I.edge_similarity(page, page) == 1.0 > I.edge_similarity(page, textured)
    assert I.key_point_score(textured, textured) > 0.5 > I.key_point_score(textured, textured[::-1])
    assert I.key_point_score(page, np.zeros((9, 9), np.uint8), over="first") == 0.0
    assert I.snapshot(page, (0, 10, 45, 25), (45, 25)).shape == (30, 90)
    # resizing keeps the mean
    assert I.resized(page, 8, 8).mean() == pytest.approx(page.mean())
    assert I.attempt(I.decode, b"junk") is None


def test_pictures_that_cannot_be_read(spark):
    df = spark.createDataFrame([(b"junk",), (None,), (I.encode(np.zeros((4, 4), np.uint8)),)], "b binary")
    got = df.select(I.hash_of(F.col("b")), I.is_picture(F.col("b")), I.picture(F.col("b"), I.logo_beside_text, keep=True), I.picture(F.col("b"), I.tight_crop)).collect()
    assert got[0][0] is None and not got[0][1] and bytes(got[0][2]) == b"junk" and got[0][3] is None
    assert got[1][0] is None and got[1][2] is None and got[2][3] is not None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "é\n", "x")], "k int, a string, b string")
    writers.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("k").first()["a"] == 'a "q", b'
    writers.json_lines(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert writers.as_json(df).orderBy("json").first()[0] == '{"k":1,"a":"a \\"q\\", b","b":null}'
    blobs = spark.createDataFrame([(1, "a/b:c" + "d" * 40, b"12"), (2, None, b"3"), (3, "x", None)], "id long, n string, b binary")
    folder = str(tmp_path)

    def put(name, data):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)

    assert {(r["file"], r["bytes"]) for r in writers.file_for_each(blobs, "n", "b", put).collect()} == {("1_abc" + "d" * 27 + ".png", 2), ("2_no_name.png", 1)}
    assert (tmp_path / "2_no_name.png").read_bytes() == b"3"


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"w1 w2")
    (tmp_path / "b.png").write_bytes(b"bad")
    found = readers.files(spark, str(tmp_path))
    assert {r["is_pdf"] for r in found.collect()} == {True, False}

    def read(blob):
        if blob == b"bad":
            raise ValueError("not a document")
        for i, w in enumerate(blob.decode().split()):
            yield {"page": i + 1, "page_w": 1.0, "page_h": 1.0, "text": w, "x0": 0.0, "x1": 1.0, "top": 0.0, "bottom": 1.0}

    words, failed = readers.layout_words(found, read, start_page=2)
    assert [r["text"] for r in words.collect()] == ["w2"] and failed.first()["error"] == "not a document"


def journal(spark, names):
    rows = []
    for i, (serial, name) in enumerate(names):
        for at, line in enumerate([f"CLASS : {i + 1}", f"{serial} 1 January 2025", f"Mark translation: '{name}'.", "goods All included in Class 9.", "OWNER INC ; street", "AGENT : x"]):
            for n, w in enumerate(line.split()):
                y = 100.0 + 30 * at
                rows.append(("j", 4 + i, 600.0, 800.0, w, 50.0 * n, 50.0 * n + 40, y, y + 8))
    return spark.createDataFrame(rows, schema.WORDS)


def test_engine(spark, tmp_path):
    e = api.Engine(dml.Catalog(spark, str(tmp_path / "cat")))
    e.ingest_journal(journal(spark, [("TM2025000001", "Blue Sky"), ("TM2025000002", "Red Sea")]), batch="1", year="2025")
    e.ingest_journal(journal(spark, [("TM2025000002", "Red Lake")]), batch="2", year="2025")
    got = {r["serial_number"]: r for r in e.marks().collect()}
    assert {k: (r["trademark_name"], r["batch_number"], r["category"], r["description"]) for k, r in got.items()} == {"TM2025000001": ("Blue Sky", "1", "MYIPO", "goods"), "TM2025000002": ("Red Lake", "2", "MYIPO", "goods")}
    assert [r["display_name"] for r in e.list_marks(batch="2", year="2025").collect()] == ["2/2025.pdf"]
    assert e.text_search("redlake").count() == 0 and e.text_search("lake").count() == 1
    client = spark.createDataFrame([(None, [1.0] + [0.0] * 511, "", None)], "logo_data binary, logo_embedding array<float>, applicant_name string, description string")
    e.ingest_clients(client, "file.pdf")
    row = e.search_clients("file").first()
    assert (row["applicant_name"], row["upload_date"]) == ("file.pdf", None)
    q = e.marks().select(F.col("id").alias("qid"), "serial_number", "trademark_name", "applicant_name", F.lit(False).alias("has_img"), F.lit(None).cast("long").alias("phash"), F.col("text_embedding").alias("text_vec"), F.col("logo_embedding").alias("logo_vec"))
    best = {r["qid"]: r["id"] for r in e.compare(q, "myipo").where("rank = 1").collect()}
    assert all(k == v for k, v in best.items()) and len(best) == 2
    assert e.compare(q, "client").count() == 0
    assert e.compare(q, "myipo", exclude_self=True).where("qid = id").count() == 0
    assert e.delete_marks([got["TM2025000001"]["id"], -1]) == 1 and e.marks().count() == 1
    assert e.get_blob("logo", got["TM2025000002"]["id"]).count() == 1


def test_image_search_filters_after_the_nearest(spark, tmp_path):
    c = dml.Catalog(spark, str(tmp_path / "cat"))
    e = api.Engine(c)
    rows = [(i, f"TM{i}", None, "9" if i > 9 else "3", None, f"n{i}", None, None, None, None, None, None, None, None, [0.95 + 0.001 * i, 0.0], None, None, "X", False, None) for i in range(12)]
    c.commit(api.MARKS, spark.createDataFrame(rows, schema.MARKS))
    assert [r["id"] for r in e.image_search([1.0, 0.0]).collect()] == list(range(11, 1, -1))
    assert [r["id"] for r in e.image_search([1.0, 0.0], class_filter="9").collect()] == [11, 10]
    assert e.image_search([1.0, 0.0], words="n1").count() == 2  # n1 itself is not among the ten nearest


def test_stream(spark, tmp_path):
    c = dml.Catalog(spark, str(tmp_path / "cat"))
    s = "id long, serial_number string, over string, keep string"
    c.commit("t", spark.createDataFrame([(1, "a", "old", "k")], s))
    feed = spark.createDataFrame([(1, "a", "new", "z"), (2, "b", "new", "z")], "seq long, serial_number string, over string, keep string")
    feed.write.parquet(str(tmp_path / "in"))
    q = ingest.upsert_stream(spark, str(tmp_path / "in"), feed.schema, c, "t", str(tmp_path / "ck"), overwrite=("over",), keep=("keep",))
    q.awaitTermination(60)
    assert {(r["serial_number"], r["over"], r["keep"]) for r in c.read("t").collect()} == {("a", "new", "k"), ("b", "new", "z")}


def test_tiers_and_labels(spark):
    df = spark.createDataFrame([(69.99, 0.0), (70.0, 0.0), (0.0, 80.0)], "i double, t double")
    assert [tuple(r) for r in df.select(S.tier(F.col("i"), F.col("t")), S.has_badge(F.col("i"), F.col("t"))).collect()] == [("low", False), ("high", False), ("high", True)]
    r = spark.range(1).select(X.normalized(X.normalized(F.lit("a-B c9é"))), X.file_safe(F.lit('a\\/*?:"<>|b')), X.or_na(F.lit("")), A.progress(F.lit(2), F.lit(3))).first()
    assert tuple(r) == ("ABC9", "ab", "N/A", 66)


def test_commit_survives_a_crash_at_every_step(spark, tmp_path, monkeypatch):
    """Whatever step fails, the old version stays, creating again changes nothing, and the next commit works."""
    from pyspark.sql import readwriter

    catalog = dml.Catalog(spark, str(tmp_path / "crash"))
    schema = "id long, name string"
    one, two = (spark.createDataFrame([(i, str(i))], schema) for i in (1, 2))
    catalog.create("t", one.schema)
    catalog.commit("t", one)

    def fail(*_, **__):
        raise RuntimeError("killed")

    steps = [(readwriter.DataFrameWriter, "parquet"), (dml.Catalog, "_list")]
    for owner, step in steps:
        with monkeypatch.context() as m:
            m.setattr(owner, step, fail)
            with pytest.raises(RuntimeError):
                catalog.commit("t", two)
        catalog.create("t", one.schema)
        assert [r["id"] for r in catalog.read("t").collect()] == [1]
    at = catalog.version("t")
    assert catalog.commit("t", two, base=at) == at + 1
    with pytest.raises(OSError):
        catalog.commit("t", one, base=at)  # a second writer that began at the same version
    assert [r["id"] for r in dml.Catalog(spark, str(tmp_path / "crash")).read("t").collect()] == [2]


def test_table_in_buckets(spark, tmp_path, monkeypatch):
    """The same rows as a table of whole snapshots after the same changes; a small change writes few buckets, a failed one nothing that is seen."""
    catalog = dml.Catalog(spark, str(tmp_path / "cat"))
    rows = spark.createDataFrame([(i, f"s{i}", f"o{i}", f"k{i}") for i in range(400)], "id long, serial_number string, over string, keep string")
    table, whole = buckets.Table(catalog, "b"), rows
    table.create(rows.schema, "serial_number", 64)
    assert table.read().collect() == [] and table.delete(rows.select("id")) == 0
    table.insert(rows)
    how = {"overwrite": ("over",), "keep": ("keep",)}
    batches = [[(0, "s7", "n", "x"), (1, "new", "n", "x"), (2, None, "n", "x"), (3, "new", "m", "y")], [(i, f"s{i * 90}", "z", "z") for i in range(4)], []]
    for b in batches:
        batch = spark.createDataFrame(b, "seq long, serial_number string, over string, keep string")
        before = table.current()[1].folders
        table.upsert(batch, **how)
        whole = spark.createDataFrame(dml.upserted(whole, batch, **how).collect(), rows.schema)
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, whole.collect()))
        after = table.current()[1].folders
        assert sum(after[x] != before.get(x) for x in after) <= len(b)
    # One in a hundred keys: what is written is about the share of the buckets that they are in.
    written = lambda: {str(p): p.stat().st_size for p in (tmp_path / "cat" / "b").rglob("*.parquet")}
    before = written()
    table.upsert(spark.createDataFrame([(i, f"s{i * 100}", "y", "y") for i in range(4)], "seq long, serial_number string, over string, keep string"), **how)
    assert len(set(written()) - set(before)) <= 4 and sum(written().values()) - sum(before.values()) < sum(before.values()) / 5
    at = table.current()
    table.update(F.col("id") == 5, over=F.lit("updated"))
    assert table.read().where("over = 'updated'").count() == 1
    assert table.delete(spark.createDataFrame([(5,), (6,), (-1,)], "id long")) == 2 and table.read().where("id in (5, 6)").count() == 0
    with pytest.raises(OSError):
        table._write(*at, rows.limit(1), [0])  # a second writer that began at an older version
    seen = sorted(map(tuple, table.read().collect()))
    from pyspark.sql import readwriter

    def fail(*_, **__):
        raise RuntimeError("killed")

    for owner, step in [(readwriter.DataFrameWriter, "parquet"), (dml.Catalog, "_list")]:
        with monkeypatch.context() as m:
            m.setattr(owner, step, fail)
            with pytest.raises(RuntimeError):
                table.delete(rows.select("id"))
        assert sorted(map(tuple, table.read().collect())) == seen
    with pytest.raises(ValueError):
        table.update(F.lit(True), serial_number=F.lit("x"))


def test_containment_of_any_kind_of_id(spark):
    passages = spark.createDataFrame([("p1", "some words"), ("p2", "other")], "pid string, text string")
    texts = spark.createDataFrame([("t1", "here are some words"), ("t2", "Other")], "tid string, text string")
    got = {(r["pid"], r["tid"]) for r in contain.literal_matches(passages, texts, "pid", "tid").collect()}
    assert got == {("p1", "t1"), ("p2", "t2")}
