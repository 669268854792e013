"""Operators that deal one hot key, or none at all, to many tasks: against plain restatements, and the size of their tasks."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.topk import Best
from lodestone.operators import joins as J
from lodestone.operators import knn as K
from lodestone.operators import scan, segment

# ----------------------------------------------------------------------------------- grid


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 4, "cell_rows": 9}, {"block_rows": 1, "cell_rows": 1000}])
def test_grid_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(f"k{i:03d}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)] + [(f"c{i}", [1.0, 1.0, 1.0, 1.0]) for i in range(45)]
    rows += [("n", None), ("m", [1.0, None, 1.0, 1.0]), ("s", [1.0, 2.0]), ("t", [2.0, 2.0]), ("e", [])]
    asked = [(i, v) for i, (_, v) in enumerate(rows[:20] + rows[100:104] + rows[-5:])] + [(3, rows[3][1]), (3, [9.0, 9.0, 9.0, 9.0])]
    q, c = spark.createDataFrame(asked, "qid int, vector array<double>"), spark.createDataFrame(rows, "id string, vector array<double>")
    got = defaultdict(list)
    for r in sorted(K.nearest_each(q.repartition(2), c.repartition(3), 7, **sizes).collect(), key=lambda r: (r["qid"], r["rank"])):
        got[r["qid"]].append((r["id"], r["sim"]))
    usable = lambda v: v is not None and None not in v
    want = defaultdict(list)
    for i, v in {(i, tuple(v)) for i, v in asked if usable(v)}:
        met = [(k, sum(a * b for a, b in zip(v, w, strict=True))) for k, w in rows if usable(w) and len(w) == len(v)]
        want[i] += sorted(met, key=lambda m: (-m[1], m[0]))[:7]
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_grid_of_a_hundred_thousand_queries(spark):
    """Neither side reaches the driver, and a task holds one block."""
    vector = lambda seed: F.array(*[((F.xxhash64("id", F.lit(seed + i)) % 100) / 100).cast("double") for i in range(3)])
    q, c = spark.range(100_000).withColumn("vector", vector(0)).withColumnRenamed("id", "qid"), spark.range(300).withColumn("vector", vector(5))
    found = K.nearest_each(q, c, 1)
    assert found.count() == 100_000 == found.select("qid").distinct().count()
    some = {r["qid"]: r for r in found.where("qid % 9973 = 0").collect()}
    rows = np.array([r["vector"] for r in c.orderBy("id").collect()])
    for r in q.where("qid % 9973 = 0").collect():
        sims = rows @ np.array(r["vector"])
        assert math.isclose(some[r["qid"]]["sim"], sims.max()) and math.isclose(sims[some[r["qid"]]["id"]], sims.max())


def test_best_holds_little_of_a_batch():
    """The first batch doesn't put all of its scores in order."""
    scores = np.random.default_rng(3).random((500, 4000))
    best = Best(500, 5)
    tracemalloc.start()
    best.add(scores, np.arange(4000).astype(object))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * scores.nbytes
    row, value, score = best.held()
    assert len(row) == 2500 and all(set(value[row == r]) == set(np.argsort(-scores[r])[:5]) for r in range(0, 500, 50))


def test_grid_in_small_steps(spark, monkeypatch):
    """The same neighbours, ties by key, however few products a task holds at once."""
    vector = lambda seed: F.array(*[(F.xxhash64("id", F.lit(seed + i)) % 4).cast("double") for i in range(3)])
    q, c = spark.range(40).withColumn("vector", vector(0)).withColumnRenamed("id", "qid"), spark.range(500).withColumn("vector", vector(5))
    found = []
    for products in (K.PRODUCTS, 90):
        monkeypatch.setattr(K, "PRODUCTS", products)
        found.append(sorted(map(tuple, K.nearest_each(q, c, 7).collect())))
    assert len(found[0]) == 280 and found[0] == found[1]


def test_best_keeps_the_first_of_ties():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 4, (5, 40)).astype(float)
    best = Best(5, 3)
    for at in range(0, 40, 7):
        best.add(scores[:, at : at + 7], np.arange(40).astype(object)[at : at + 7])
    got = defaultdict(list)
    for r, v, s in zip(*best.held(), strict=True):
        got[int(r)].append((-s, v))
    assert {r: sorted(v) for r, v in got.items()} == {r: sorted((-scores[r, i], i) for i in range(40))[:3] for r in range(5)}


# -------------------------------------------------------------------------------- interval


@pytest.mark.parametrize("axis, sizes", [("y", None), ("x", None), ("y", (3, 5))])
def test_inside_against_all_pairs(spark, axis, sizes):
    rng = random.Random(5)
    odd = [None, math.nan, math.inf, -math.inf, 0.0]
    side = lambda: rng.choice(odd) if rng.random() < 0.06 else round(rng.uniform(-40, 90), 1)

    def span(wide):
        a = side()
        return (a, a + rng.choice([0, 0.1, 2, 7.5, wide])) if a is not None and rng.random() < 0.93 else (a, side())

    pages = [None] + [1] * 6 + [2, 3]  # two thirds are on one page
    items = [(i, rng.choice(pages), *span(3), *span(3)) for i in range(300)]
    boxes = [(i, rng.choice(pages), *span(60), *span(500)) for i in range(120)]
    li = spark.createDataFrame(items, "item int, page int, x0 double, x1 double, top double, bottom double").repartition(3)
    lb = spark.createDataFrame(boxes, "box int, page int, bx0 double, bx1 double, by0 double, by1 double").repartition(2)
    got = Counter((r["item"], r["box"]) for r in J.inside(li, lb, ["page"], axis, sizes).collect())
    # Every pair of a page, compared by the engine itself, whose order of values that are no numbers holds.
    every = li.join(lb, "page").where("x0 >= bx0 and x1 <= bx1 and top >= by0 and bottom <= by1").collect()
    assert got == Counter((r["item"], r["box"]) for r in every) and len(got) > 30
    assert J.inside(li, lb.where("false"), ["page"], axis, sizes).count() == J.inside(li.where("false"), lb, ["page"], axis, sizes).count() == 0


def test_inside_meets_few_on_one_page(spark):
    """Of a million pairs on one page only those of near bins are made."""
    items = spark.range(2000).select(F.col("id").alias("item"), F.lit(1).alias("page"), *[F.lit(0.0).alias(c) for c in ("x0", "x1")], *[F.col("id").cast("double").alias(c) for c in ("top", "bottom")])
    boxes = spark.range(500).select(F.col("id").alias("box"), F.lit(1).alias("page"), *[F.lit(0.0).alias(c) for c in ("bx0", "bx1")], (F.col("id") * 4.0).alias("by0"), (F.col("id") * 4.0 + 3).alias("by1"))
    found = J.inside(items, boxes, ["page"])
    assert found.count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan.split("Join Inner")[1].split("\n")[0]
    made = items.withColumn("bin", F.floor(F.col("top") / 4)).join(boxes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("by0") / 4), F.floor(F.col("by1") / 4)))), ["page", "bin"]).count()
    assert made == 2000


def test_inside_never_broadcasts_items(spark, smallest):
    """Words made from a small table look few to Spark, and would all be sent through the driver."""
    from lodestone.registry import queries

    for name in ("block_fields_parse", "extraction_progress"):
        plan = queries()[name](spark, smallest)._jdf.queryExecution().sparkPlan().toString()
        assert "BuildLeft" not in plan and "BroadcastHashJoin [doc_id" not in plan, name


def test_inside_sends_few_boxes_to_the_items(spark):
    """A few boxes go to the items, which aren't shuffled; more than that are shuffled, with the same result."""
    items = spark.range(3000).select(F.col("id").alias("item"), *[F.lit(0.0).alias(c) for c in ("x0", "x1")], *[(F.col("id") % 700).cast("double").alias(c) for c in ("top", "bottom")])
    boxes = spark.range(60).select(F.col("id").alias("box"), *[F.lit(0.0).alias(c) for c in ("bx0", "bx1")], (F.col("id") * 11.0).alias("by0"), (F.col("id") * 12.0 + 3).alias("by1"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, dealt = J.inside(items, boxes, []), J.inside(items, boxes, [], few=59)
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in (sent, dealt)]
        assert "BroadcastHashJoin" in plans[0] and "BuildRight" in plans[0] and "SortMergeJoin" in plans[1]
        got = [Counter((r["item"], r["box"]) for r in x.collect()) for x in (sent, dealt)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = Counter((i, b) for i in range(3000) for b in range(60) if b * 11 <= i % 700 <= b * 12 + 3)
    assert got == [want, want]


@pytest.mark.parametrize("axis", ["x", "y"])
def test_inside_shuffles_an_item_for_few_sizes(spark, axis):
    """Boxes of nine sizes and of none, among them backward ones: an item is shuffled for three, not for each, and meets all that hold it."""
    rng = random.Random(11)
    odd = [(None, 1.0), (math.nan, 2.0), (5.0, 4.0), (0.0, math.nan), (-math.inf, -math.inf), (math.inf, math.inf)]
    spans = odd + [(a, a + wide) for wide in (0, 0.3, *(2.0**k for k in range(2, 10))) for a in (rng.uniform(-400, 400) for _ in range(12))]
    points = [*odd, (-math.inf, math.inf), (math.nan, math.nan), *((a, a + rng.choice([0, 0, 0.2, 3])) for a in (rng.uniform(-420, 900) for _ in range(400)))]
    points += [(b, b) for _, b in spans[6:40]] + [(a, a) for a, _ in spans[6:40]]  # on the edges
    flat, (p, b) = ("0.0D", "0.0D"), (("x0", "x1"), ("bx0", "bx1")) if axis == "x" else (("top", "bottom"), ("by0", "by1"))
    other = (("top", "bottom"), ("by0", "by1")) if axis == "x" else (("x0", "x1"), ("bx0", "bx1"))
    table = lambda rows, key, own, rest: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{key} int, {own[0]} double, {own[1]} double").selectExpr("*", *[f"{v} AS {c}" for v, c in zip(flat, rest, strict=True)])
    items, boxes = table(points, "item", p, other[0]).repartition(3), table(spans, "box", b, other[1]).repartition(2)
    found = J.inside(items, boxes, [], axis, few=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    copies = [line.split("ELSE array(")[1].split(" END")[0].count("struct(size") for line in plan.split("\n") if "Generate" in line and "ELSE array(" in line]
    assert "SortMergeJoin" in found._jdf.queryExecution().sparkPlan().toString() and copies == [3]  # and one, that is constant, for boxes that no bin holds
    got = Counter((r["item"], r["box"]) for r in found.collect())
    every = items.crossJoin(boxes).where(f"{p[0]} >= {b[0]} and {p[1]} <= {b[1]}").collect()
    assert got == Counter((r["item"], r["box"]) for r in every) and len(got) > 1000


def test_inside_shares_bins_of_near_sizes():
    """However sizes lie: a box covers few bins, and a bin is not much wider than its boxes."""
    rng = random.Random(3)
    for sizes in [[], [4], [-20, *range(4, 10)], list(range(-20, 51)), *(rng.sample(range(-20, 51), rng.randrange(1, 30)) for _ in range(50))]:
        shared = J._shared_bins(sizes)
        assert shared.keys() == set(sizes) and all(-3 <= b - s <= 2 for s, b in shared.items())
        assert len(set(shared.values())) <= -(-71 // 6)
    assert J._shared_bins([-20, *range(4, 10)]) == {-20: -20} | dict.fromkeys(range(4, 10), 6)


# ------------------------------------------------------------------------------ sequences


def sequences(seed, n):
    rng = random.Random(seed)
    keys = ["hot"] * 5 + [None, "a", "b"]
    return [(rng.choice(keys), rng.choice([None, *range(0, 60)]), i) for i in range(n)]


@pytest.mark.parametrize("part_rows", [1, 7, 60, None])
@pytest.mark.parametrize("on", [["k"], []])
def test_previous_and_next_in_parts(spark, part_rows, on):
    left, right = sequences(1, 90), [(k, at, None if i % 9 == 0 else i) for k, at, i in sequences(2, 60)]
    a, b = spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, at int, v int")
    if not on:
        a, b = a.drop("k"), b.drop("k")
    got = {r["i"]: (r["previous"], r["next"]) for r in J.previous_and_next(a.repartition(3), b.repartition(2), on, "at", "v", part_rows).collect()}
    place = lambda at: -1 if at is None else at  # nulls come before all
    for k, at, i in left:
        same = [(place(t), v) for j, t, v in right if (j == k or not on) and v is not None]
        before, behind = [(t, v) for t, v in same if t < place(at)], [(-t, v) for t, v in same if t > place(at)]
        assert got[i] == (max(before)[1] if before else None, max(behind)[1] if behind else None), (k, at, i)


@pytest.mark.parametrize("part_rows", [1, 7, None])
@pytest.mark.parametrize("on", [["k"], []])
def test_segments_in_parts(spark, part_rows, on):
    rows = sequences(3, 150)
    df = spark.createDataFrame(rows, "k string, at int, i int").repartition(3)
    got = {r["i"]: r["entry"] for r in segment.segmented(df, on, "at", F.col("i") % 5 == 0, part_rows=part_rows).collect()}
    place = lambda at: -1 if at is None else at
    for k, at, i in rows:
        want = sum(1 for j, t, x in rows if x % 5 == 0 and (j == k or not on) and place(t) <= place(at))
        assert got.get(i, 0) == want


def test_one_sequence_is_many_tasks(spark):
    """A third of all rows, or all of them, under one key: no part holds more than a few times its share."""
    rows = spark.range(30_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("at"), "id")
    cut, several = scan.in_parts(rows, "at", 2000)
    sizes = [r["count"] for r in cut.groupBy("k", scan.PART).count().collect()]
    assert several and len(sizes) == 15 and max(sizes) < 4000 and sum(sizes) == 30_000
    assert not scan.in_parts(rows.withColumn("at", F.col("at").cast("string")), "at", 2000)[1]
    done = segment.segmented(rows, ["k"], "at", F.col("id") % 1000 == 0, part_rows=2000)
    assert {r["entry"]: r["count"] for r in done.groupBy("entry").count().collect()} == {i + 1: 1000 for i in range(30)}
