"""Personal data, fingerprints, near duplicates, quality, encoding and mixing against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import llm
from lodestone.llm import bpe, common, iblt, mixing, pii, quality, shingles, simhash

from llm_helpers import rows_of

DOCS = ["op1_pii", "op3_simhash", "op4_sketch", "op6_quality", "op7_bpe", "op8_mixing"]


@pytest.mark.parametrize("name", DOCS)
def test_one_row_for_each_row(spark, small, name):
    got = llm.queries()[name](spark, small).collect()
    want = Counter(r["doc_id"] for r in rows_of(spark, small))
    assert Counter(r["doc_id"] for r in got) == want


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    got = llm.queries()[name](spark, empty).collect()
    assert len(got) == (1 if name == "op10_chat" else 0)


# ------------------------------------------------------------------------- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


TRICKY = ["a@b.c_d@e.f", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "1234.1.1.1 255.255.255.255", "4111-1111 1111 1111", "9" * 20_000, "z" * 20_000 + "@b.c", "\U0001f600 a@b.co", "+5((((((((", "1.1.1.1 " * 700, "0000000255.1.1.1", "a@b.c@d.e", "+1 (743) 555-3824 5", "+12345678901234567"]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: r["b"] for r in pii.find(df).select("doc_id", pii._written("base").alias("b")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(TRICKY)}


@given(st.lists(st.text("a1@. -+(", max_size=40), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_base_spans_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["b"] for r in pii.spans(df).select("doc_id", pii._written("base").alias("b")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def test_whole_query_against_plain_spans(spark, smallest):
    docs = {r["doc_id"]: r["text"] for r in rows_of(spark, smallest)}
    for r in pii.query(spark, smallest).collect():
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]


def test_context_discovers_and_leaves_others_alone(spark):
    rows = [(i, f"please call me at +1 (212) 555-{1000 + i} or write") for i in range(20)]
    rows += [(100, "please call me at 555-0199-22 or write"), (101, "the price was at 99887766 or so"), (102, "please call me at 04db04db04db04dbeb or write"), (103, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find(df).select("doc_id", pii._written("spans").alias("s")).collect()}
    assert got[100] == "phone:18:29" and got[101] == got[102] == got[103] == ""
    again = {r["doc_id"]: r["s"] for r in pii.find(df.union(df)).select("doc_id", pii._written("spans").alias("s")).collect()}
    assert again == got  # copies aren't more evidence


def test_context_discovers_spaced_forms(spark):
    rows = [(i, f"please call me at +1 (212) 555-{1000 + i} or write") for i in range(20)]
    cards = [c for c in range(4111111111110000, 4111111111110400) if luhn(str(c))][:20]
    spaced = lambda c: " ".join(str(c)[k : k + 4] for k in range(0, 16, 4))
    rows += [(50 + i, f"charge it to card {spaced(c)} before noon") for i, c in enumerate(cards)]
    bad = spaced(cards[-1] + 1)
    more = {100: "please call me at 555 867 5309 or write", 101: "please call me at (212) 555-0199 or write", 102: f"charge it to card {bad} before noon", 103: "the total of 12 345 678 was paid"}
    df = spark.createDataFrame([*rows, *more.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find(df).select("doc_id", pii._written("spans").alias("s")).where("doc_id >= 100").collect()}
    assert got == {100: "phone:18:30", 101: "phone:18:32", 102: "card:18:37", 103: ""}


def test_many_spans_in_one_long_text(spark):
    """Two thousand identifiers of all kinds in 60 KB, with blocks of text cut anywhere: found and replaced as by plain code."""
    rng = random.Random(2)
    words = [rng.choice(["+1 (212) 555-%04d" % rng.randrange(10**4), f"a{i}@b.example", "10.0.0.%d" % rng.randrange(300), "%08d é" % rng.randrange(10**8), "plain text"]) for i in range(3000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = pii.find(df).select("*", pii._written("base").alias("b")).first()
    assert got["b"] == base_spans(df.first()["text"]) and len(got["base"]) > 1000
    text, at, out = df.first()["text"], 0, []
    for s in got["spans"]:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{pii.KINDS[s['kind']].upper()}>"]
        at = max(at, s["end"])
    assert pii.stage(spark, df, "").first()["text"] == "".join(out) + text[at:]


def test_redaction(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").withColumn("n_chars", F.lit(0).cast("long"))
    out = {r["doc_id"]: r for r in pii.stage(spark, df, small).where("doc_id is not null").collect()}
    assert out[7]["text"] == "mail me at <EMAIL> or <PHONE>, not 10.0.0.256 but <IP>\nnext line" and out[7]["n_chars"] == len(out[7]["text"])
    assert out[-4]["text"] == "<CARD> is a card" and out[3]["text"] is None and out[3]["n_chars"] is None
    assert pii.stage(spark, df, small).count() == df.count() and pii.stage(spark, df, small).columns == df.columns


# --------------------------------------------------------------------- near duplicates


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, limit=4):
    """Smallest key reachable over links, by all pairs."""
    values = sorted(set(fps.values()))
    a = np.array(values, np.uint64)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= limit)[0]:
            parent[find(values[i + 1 + j])] = find(v)
    least = {}
    for k, v in fps.items():
        least[find(v)] = min(k, least.get(find(v), k))
    return {k: least[find(v)] for k, v in fps.items()}


def test_simhash_query(spark, smallest):
    docs = {r["doc_id"]: r["text"] for r in rows_of(spark, smallest)}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    got = simhash.query(spark, smallest).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_simhash_odd_rows(spark, small):
    by = {r["doc_id"]: r for r in simhash.query(spark, small).where("doc_id is not null").collect()}
    assert by[1]["component_id"] == by[2]["component_id"] == 1  # case aside
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 3
    assert by[9]["fingerprint"] == f"{plain_fingerprint('x' * 60_000):016x}"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = simhash.stage(spark, docs, small)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and ids[1] == 1 and ids[2] == 0 and ids[6] == 1 and ids[3] == 1 and ids[None] == 1


def test_stage_keeps_one_of_each_similar_group(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for g in range(30):
        words = [f"w{v}" for v in rng.integers(0, 400, 20 + 8 * g)]
        for i in range(6):
            own = list(words)
            for at in rng.integers(0, len(own), i):
                own[at] = f"x{rng.integers(0, 9999)}"
            texts[10 * g + i] = " ".join(own)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    alike = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    parent = {i: i for i in sets}
    for i, j in sorted(alike):
        a, b = parent[i], parent[j]
        parent = {k: min(a, b) if v in (a, b) else v for k, v in parent.items()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert any((fps[i] ^ fps[j]).bit_count() > simhash.LIMIT for i, j in alike)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.stage(spark, df, "").collect()} == set(parent.values())


def test_completion_finds_all_that_probing_leaves(spark, monkeypatch):
    monkeypatch.setattr(shingles, "found", lambda reps, radius: reps.select(F.col("h").alias("a"), F.col("h").alias("b")).where("false"))
    rng = np.random.default_rng(12)
    texts = {}
    for g in range(12):
        words = [f"v{g}x{v}" for v in range(60 + 12 * g)]
        for i in range(12):
            own = words[: len(words) - int(rng.integers(0, 12))]
            for at in rng.integers(0, len(own), int(rng.integers(0, 5))):
                own[at] = f"x{rng.integers(0, 9999)}"
            texts[100 * g + i] = " ".join(own)
    sets = {i: set(shingles.shingles(t.encode()).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}
    for i, j in ((i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
        a, b = parent[i], parent[j]
        parent = {k: min(a, b) if v in (a, b) else v for k, v in parent.items()}
    assert len(set(parent.values())) < len(parent) - 40
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.stage(spark, df, "").collect()} == set(parent.values())


def test_merged_components_equal_those_of_all_links(spark, tmp_path):
    rng = np.random.default_rng(8)
    first, more = ([tuple(map(int, x)) for x in rng.integers(0, 120, (n, 2)) if x[0] != x[1]] for n in (50, 30))
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = common.connected_components(frame(first), "a", "b").toDF("h", "root")
    for some in (more, more[:0]):
        got = sorted(map(tuple, shingles.merged(roots, frame(some), str(tmp_path)).collect()))
        assert got == sorted(map(tuple, common.connected_components(frame(first + some), "a", "b").collect()))


def test_order_of_shingles_counts_all_texts(spark):
    """Of more than 20,000 texts, a phrase that only those hold which a sample by every second hash would leave out."""
    one = spark.range(20_500).select(F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id")) for c in "abcdefgh"]).alias("text"))
    phrase = min((f"some {i} words are common" for i in range(500)), key=lambda p: shingles.shingles(p.encode())[0])
    common = shingles.shingles(phrase.encode())[0]
    some = one.limit(300).select(F.concat_ws(" ", "text", F.lit(phrase)).alias("text")).where("pmod(xxhash64(text), 2) = 1")
    got = shingles.filed(one.union(some).select(F.hash("text").alias("doc_id"), "text"), "doc_id", "text")
    assert some.count() > 100
    assert got.where(F.array_contains("prefix", int(common))).count() == 0  # else it is the first one by its hash


def test_classes_follow_counts():
    sets = [np.unique(np.array([5, 9, k << 52 | k << 22, -k - 1], np.int64)) for k in range(1, 40)]
    blocks = {}
    for part in (sets[:13], sets[13:]):
        for block, own, n in zip(*shingles._counted(part).to_pydict().values(), strict=True):
            blocks.setdefault(block, []).append((own, n))
    classes = np.zeros((shingles.BLOCKS, shingles.PLACES), np.uint8)
    for block, own in blocks.items():
        classes[block] = np.frombuffer(shingles._classes(*zip(*own, strict=True)), np.uint8)
    flat = classes.ravel()
    assert set(flat[shingles.cells(np.array([5, 9]))]) == {int(shingles.STEPS * np.log2(39))} and (flat > 0).sum() == 1
    assert shingles.prefix(np.array([5, 9, 1 << 60, 2 << 60, 3 << 60, 4 << 60]), flat).tolist() == [1 << 60, 2 << 60]


def test_stage_with_an_id_of_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (3, a + " more"), (5, b), (None, b + " more")]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == [(3, a + " more"), (5, b)]
    kept = simhash.stage(spark, spark.createDataFrame(rows[:2], "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == [(5, a), (5, b)]


@pytest.mark.parametrize("dense", [512, 3])
def test_links_on_clusters(spark, dense):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = {}
    for i in range(400):
        v = int(centres[i % 12])
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            v ^= 1 << int(b)
        fps[i] = v
    df = spark.createDataFrame([(i, simhash.signed(v)) for i, v in fps.items()], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(df, dense=dense).collect()}
    want = plain_components(fps)
    assert {i: got[simhash.signed(v)] for i, v in fps.items()} == want


def test_plan_covers_all_close_pairs(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(simhash.signed(int(v)),) for v in rng.integers(0, 2**64, 500, dtype=np.uint64)], "fp long")
    parts = simhash.plan(df)
    assert sorted(b for p in parts for b in p.bits) == list(range(64))
    assert sum(p.limit for p in parts) == simhash.LIMIT - len(parts) + 1
    cost, limits = simhash.allocate([np.array([0.0, 5, 6, 9]), np.array([0.0, 1, 50, 99])], 1)
    assert sum(limits) == 1 and cost == min(c for c in (6 + 1 + 0, 9 + 1, 5 + 50, 9 + 0 * 1 + 1) if c == cost)


@pytest.mark.parametrize("n", [0, 1, 2])
@pytest.mark.parametrize("limit", [simhash.LIMIT, shingles.RADIUS])
def test_plan_of_few_fingerprints_is_small(spark, n, limit):
    fps = spark.createDataFrame([(7 * i,) for i in range(n)], "fp long")
    parts = simhash.plan(fps, limit)
    assert sum(p.limit for p in parts) == limit - len(parts) + 1
    assert sum(simhash.keys_of(len(p.bits), p.limit) for p in parts) <= simhash.MOST_KEYS
    assert simhash.candidates(fps, limit).count() == max(0, n - 1)


# ------------------------------------------------------------------------ fingerprints


@given(st.lists(st.binary(max_size=6), max_size=60), st.lists(st.binary(max_size=6), max_size=60))
@settings(max_examples=60, deadline=None)
def test_sketches_recover_differences(a, b):
    x, y = iblt.digests(b"\n".join(a)), iblt.digests(b"\n".join(b))
    ((only_x, only_y),) = iblt.differences([x], [y])
    assert (set(only_x.tolist()), set(only_y.tolist())) == (set(x.tolist()) - set(y.tolist()), set(y.tolist()) - set(x.tolist()))


def test_sketch_query(spark, smallest):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in rows_of(spark, smallest)), reverse=True)
    got = {r["doc_id"]: r for r in iblt.query(spark, smallest).collect()}
    same = {}
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, value in ((edited, r["near_edited"]), (after, r["near_next"])):
            x, y = (set(iblt.digests(t.encode()).tolist()) for t in (text, other))
            assert value == pytest.approx(2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0)
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    far = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in far]) > 0.95


@pytest.mark.parametrize("n", [1, 2, 5])
def test_sketch_order_with_repeats(spark, n):
    rows = [(7, "same text here")] * n + [(None, None), (3, "")]
    got = iblt.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 7) == n - 1


# ------------------------------------------------------------------------------ quality


def test_quality_separates_held_out(spark):
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("aeinrst"), rng.integers(2, 7))) for _ in range(600)])
    rows = []
    for i in range(600):
        text = " ".join(words[rng.integers(0, 600, 80)])
        rows.append((i, text.upper().replace(" ", "!! ") if i % 3 == 0 else text, int(i % 3 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r["doc_id"]: r["score"] for r in quality.scored(df, model).collect()}
    assert all((got[i] >= quality.THRESHOLD) == bool(y) for i, _, y in rows if i in held)


def test_quality_takes_one_text_for_each_labelled_id(spark, tmp_path):
    """An id that thirty thousand rows share gives one text, whatever their order."""
    rows = [(1, f"good words number {i % 7}", 1) for i in range(3000)] + [(3, "bad bad", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.col("y").alias("quality"))
    got = quality.sample(docs, labels.distinct())[0].collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]
    assert got == quality.sample(docs.orderBy(F.desc("text")), labels.distinct())[0].collect()


def test_quality_query_against_a_plain_restatement(spark, smallest):
    """Every score of the whole table: same rows, dictionaries by the library, sizes piece by piece, a plain fit."""
    import zstandard

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(spark, smallest)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    y = {r["doc_id"]: r["quality"] for r in rows_of(spark, smallest, "labels") if r["quality"] in (0, 1) and not fold(r["doc_id"])}
    used = sorted((y[i], str(i), docs[i]) for i in y if docs.get(i))  # fewer than the bound at this size
    cut = lambda t: [t[a * 512 : (a + 1) * 512] for a in sorted({-(-len(t) // 512) * k // 16 for k in range(16)})]
    made = []
    for label in (1, 0):
        pieces = [(i, p) for lab, i, t in used if lab == label for p in cut(t)]
        made.append(zstandard.train_dictionary(49_152, [p for _, p in sorted(pieces)]).as_bytes())

    def size(piece, content):
        kind = zstandard.ZstdCompressionDict(content)
        return len(zstandard.ZstdCompressor(level=3, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece))

    def differences(t):
        g, b = (sum(size(t[a : a + 512], d) for a in range(0, len(t), 512)) for d in made)
        return ((b - g) / (b + g), (b - g) / len(t)) if t else (0.0, 0.0)

    x = np.array([differences(t) for _, _, t in used])
    label = np.array([lab for lab, _, _ in used], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = lambda v: (lambda a, b: np.column_stack([a * 0 + 1, a, b, a * a, a * b, b * b]))(*np.clip((v - mean) / scale, -6, 6).T)
    design, w = z(x), np.where(label == 1, sum(v == 1 for v in y.values()) / (label == 1).sum(), sum(v == 0 for v in y.values()) / (label == 0).sum())
    beta = np.zeros(6)
    for _ in range(200):  # Newton steps, each halved
        p = 1 / (1 + np.exp(-design @ beta))
        ridge = quality.RIDGE * w.sum() / 100
        beta -= 0.5 * np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(6), design.T @ (w * (p - label)) + ridge * beta)
    got = {r["doc_id"]: r for r in quality.query(spark, smallest).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        want = float(1 / (1 + np.exp(-np.clip(z(np.array([differences(t)])) @ beta, -35, 35)))[0])
        assert got[i]["score"] == pytest.approx(want, abs=1e-3) and got[i]["held_out"] == fold(i) and got[i]["predicted"] == (got[i]["score"] >= 0.7)


def test_quality_without_contrast(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.scored(docs, one).collect()} == {1.0}
    got = {r["doc_id"]: r for r in quality.query(spark, small).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[1]["held_out"] == (zlib.crc32(b"1") % 4 == 2) and got[None]["held_out"] is False
    assert got[3]["score"] == got[4]["score"]


# ----------------------------------------------------------------------------- encoding


@pytest.fixture(scope="module")
def reference():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=60) | st.text("aeinrst th'", max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoder_is_exact(reference, text):
    own = bpe.encoder(*bpe._vocabulary())
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_encoder_on_every_entry_and_long_runs(reference):
    own = bpe.encoder(*bpe._vocabulary())
    for token in range(0, len(own.entry), 17):
        assert own.encode_piece(own.entry[token]) == [token]
    for text in ("a" * 30_000, " " * 20_000 + "x", "ab" * 9_000, "<|endoftext|>", "=" * 9_000, "\x1c\x85\xa0 　"):
        assert own.encode(text) == reference.encode_ordinary(text)


def test_bpe_query(spark, small, reference):
    want = Counter()
    for r in rows_of(spark, small):
        ids = reference.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.query(spark, small).collect()) == want
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 8")
    for r in bpe.decode(bpe.encode(df, *bpe._vocabulary()), *bpe._vocabulary()).collect():
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()


# ------------------------------------------------------------------------------- mixing


def plain_targets(sizes):
    """Shares by weight, capped and reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def check_mix(rows, got, slack):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    targets = plain_targets(dict(sizes))
    source = {i: s for i, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= slack(s), (s, taken[s], targets[s])


def test_mixing_query(spark, smallest):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in rows_of(spark, smallest)]
    got = mixing.query(spark, smallest).collect()
    largest = Counter()
    for _, s, t in rows:
        largest[s] = max(largest[s], len((t or "").split()))
    check_mix(rows, got, lambda s: largest[s] / 2 + 1)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.query(spark, smallest).repartition(7).collect()))


def test_mixing_of_large_sources_is_near(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[int(i % 7 > 3) + int(i % 11 == 0)], "w " * int(rng.integers(0, 60))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.rounded(df).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).collect()
    check_mix(rows, got, lambda s: 5)


def test_mixing_odd_rows(spark, small):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in rows_of(spark, small)]
    got = mixing.query(spark, small).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got} >= {2**53 + 1, None}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = mixing.stage(spark, docs, small)
    assert out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    assert sum(copies[r["doc_id"]] for r in got if r["doc_id"] in (1, 8, 9)) == sum(r["taken"] // r["size"] for r in got if r["doc_id"] in (1, 8, 9))
