"""Hard negatives, language identification and token alignment against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import rows_of
from pyspark.sql import functions as F

from lodestone import llm
from lodestone.llm import align, common, embed, langid, negatives, pii

# ------------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score double, row string"


def brute_negatives(rows):
    """Of (id, vector, label): plain loops over all pairs; equal anchors count once."""
    usable = []
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for anchor in sorted({r for r in usable if r[0] % 50 == 0}):
        others = list(usable)
        others.remove(anchor)
        met = sorted((-max(-(2**53), min(2**53, sum(a * b for a, b in zip(anchor[1], v, strict=True)))), i, y) for i, v, y in others if len(v) == len(anchor[1]))
        for p, pid, _ in [m for m in met if m[2] == anchor[2]][:5]:
            found = [(n, nid) for n, nid, y in met if y != anchor[2] and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(anchor[0], pid, rank, nid, -p, -n) for rank, (n, nid) in enumerate(found, 1)]
    return sorted(out)


def odd_vectors():
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in np.round(rng.normal(0.4, 0.5, 4), 1)], int(rng.integers(0, 4))) for i in range(-60, 260)]
    rows += [(50, [0.5, 0.5, 0.5, 0.5], 1)] * 3 + [(50, [0.5, 0.5, 0.5, 0.25], 1), (51, [0.5, 0.5, 0.5, 0.5], 1), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(100, None, 1), (150, [1.0, None, 1.0, 1.0], 2), (200, [1.0, math.nan, 1.0, 1.0], 2), (300, [math.inf, 0.0, 0.0, 0.0], 2), (350, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(400, [], 3), (401, [], 3), (402, [], 2), (450, [1.0, 2.0], 1), (451, [1.0, 2.0], 1), (452, [1.0, 1.5], 2), (500, [0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(550, [1e9, 3.0], 5), (551, [1e9, 2.0], 5), (552, [6e8, 9.0], 6), (1000 + 50, [2.0**40, 1.0], 5)]
    return rows + [(2000 + i, [0.9, 0.9, 0.9, 0.9], 2) for i in range(170)]  # a third of all rows are copies


@pytest.mark.parametrize("sizes", [(16_384, 4_000_000, 1024), (5, 4_000_000, 2), (16_384, 60, 1)])
def test_negatives_against_all_pairs(spark, tmp_path, monkeypatch, sizes):
    for name, n in zip(("WAVE_ROWS", "WAVE_VALUES", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, n)
    rows = odd_vectors()
    spark.createDataFrame([(*r, 0.5, "x") for r in rows], VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, negatives.query(spark, str(tmp_path)).collect()))
    assert got == brute_negatives(rows) and len(got) > 50


def test_negatives_without_anchors(spark, tmp_path):
    for i, rows in enumerate(([], [(1, [1.0], 1, 0.5, "x")], [(50, [1.0], 1, 0.5, "x")], [(50, None, 1, 0.5, "x")])):
        spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/{i}/embeddings.parquet")
        assert negatives.query(spark, f"{tmp_path}/{i}").collect() == []


def test_negatives_in_sql(spark, smallest):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{smallest}/embeddings.parquet'")
    want, got = con.sql(llm.oracle_sql()["op11_negatives"]), llm.queries()["op11_negatives"](spark, smallest)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 9)), max_size=60), st.integers(1, 4), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_best_in_any_order(hits, k, step):
    best = negatives.Best(4, k)
    for i in range(0, len(hits), step):
        r, s, ids = (np.array(x, np.int64) for x in zip(*hits[i : i + step], strict=True))
        best.add(r, s.astype(float), ids)
    for row in range(4):
        want = sorted((-s, i) for r, s, i in hits if r == row)[:k]
        assert [(-s, i) for s, i in zip(best.scores[row].tolist(), best.ids[row].tolist(), strict=True) if s > -math.inf] == want


# ------------------------------------------------------------------------------ collisions


def test_windows_of_sorted_projections():
    rng = np.random.default_rng(9)
    za, zb = rng.normal(size=(17, 64)), rng.normal(size=(40, 64))
    zb[3] = zb[4]  # ties
    got = embed.collisions(za, zb, 0.5, np.argsort(zb, axis=0, kind="stable"))
    assert got.tolist() == (np.abs(za[:, None] - zb[None]) <= 0.5).sum(axis=2).tolist()


# ------------------------------------------------------------------------------ language


def plain_bundle(text):
    """The bundle of a text by loops over its letters."""
    kept = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    if not kept:
        return np.zeros(langid.DIM)
    letters = "\0" + "\0".join(kept) + "\0"
    own = {c: langid.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in set(letters)}
    out = np.zeros(langid.DIM)
    for i in range(max(1, len(letters) - 2)):
        a, b, c = letters[i : i + 3]
        out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out / np.linalg.norm(out)


@pytest.mark.parametrize("cached, at_once", [(16_384, 12_288), (3, 2)])
def test_bundles(monkeypatch, cached, at_once):
    monkeypatch.setattr(langid, "CACHED", cached)
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    texts = ["Hello, world! hello", "x", "", None, "123 !?", "Straße İx Ünïcode日本語テキスト", "a-b-c " * 500, "hello world hello"]
    got = langid.Bundler().bundles(texts)
    assert np.allclose(got, [plain_bundle(t or "") for t in texts], atol=1e-5)


def test_language_query(spark, tmp_path):
    """Held-out texts of all tables are told apart; their labels, and other columns, make no difference."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit("s")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.query(spark, "/root/testdata/sf0.01").collect()}
    blind = {r["doc_id"]: r for r in langid.query(spark, str(tmp_path)).collect()}
    assert set(got) == set(blind) and all((r["held_out"], r["lang_pred"], round(r["score"], 9)) == (blind[i]["held_out"], blind[i]["lang_pred"], round(blind[i]["score"], 9)) for i, r in got.items())
    rows = [r for r in rows_of(spark, "/root/testdata/sf0.01") if r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = [r["lang"] == got[r["doc_id"]]["lang_pred"] for r in tested]
    assert len(right) > 200 and sum(right) / len(right) > 0.98
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "es", "und"} and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(spark, small, empty, tmp_path):
    got = langid.query(spark, small).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows_of(spark, small))
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert by[3] == by[4] == by[5] == {("und", 0.0)} and {p for p, _ in by[8]} == {"en"}
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert langid.query(spark, empty).collect() == []
    # Nothing can be learnt: no language, or only where it may not be read.
    spark.createDataFrame([(1, "some words", None), (2, "more words", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["lang_pred"], r["score"]) for r in langid.query(spark, str(tmp_path)).collect()} == {("und", 0.0)}


def test_profiles_of_a_bounded_sample(spark):
    words = {"aa": "alpha bravo charlie", "bb": "xylo zyx quux"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[n].split(), k=4)), n) for i, n in enumerate(["aa"] * 300 + ["bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, part = langid.fit(docs), langid.fit(docs, rows=40)
    assert whole.names == part.names == ["aa", "bb"] and not np.allclose(whole.prototypes, part.prototypes)
    assert part.predict(["bravo alpha", "zyx", "quux xylo", None, "7"])[0] == ["aa", "bb", "bb", "und", "und"]


# ------------------------------------------------------------------------------ alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "x ", "x  ", " x", "a\n b", "a\n  b", "a \n\n  b  ", "▁x", "é é", "a  b", "<|endoftext|> <s></s>", "x" * 5000, "ab" * 3000 + "!", "日本語 テキスト 😀😀" * 50, "\t", "a\x1c b", " a", "ab​  c", "don't we'll", "1 22 333 4444", "a\r\n\r\nb", "word " * 3000]


@pytest.fixture(scope="module")
def tokens():
    return align.Tokens(*PATHS)


def plain_groups(tokens, text):
    """The groups of a text, token by token; none if it has no tokens."""
    if not text:
        return []
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    if not b"".join(tokens.a_bytes[i] for i in a) == b"".join(tokens.b_bytes[i] for i in b) == (" " + text).encode():
        return []
    ends = [np.cumsum([len(own[i]) for i in ids]).tolist() for ids, own in ((a, tokens.a_bytes), (b, tokens.b_bytes))]
    shared, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in shared:
        to, until = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append((a[i:to], b[j:until]))
        i, j = to, until
    return out


def plain_alignment(tokens, rows):
    groups = [plain_groups(tokens, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ))
    return out


@pytest.mark.parametrize("hot, cached", [(align.HOT, align.CACHED), (7, 40), (0, 40)])
def test_alignment_against_plain_groups(spark, smallest, tokens, monkeypatch, hot, cached):
    monkeypatch.setattr(align, "CACHED", cached)
    align.aligner.cache_clear()
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark, smallest)][:120] + list(enumerate(ODD, 10_000)) + [(None, "no id"), (1, "twice"), (1, "twice")] + [(20_000 + i, "a large group of copies") for i in range(80)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, pairs int").repartition(3)
    got = [tuple(r) for r in align.aligned(df, *PATHS, hot=hot).collect()]
    none = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=none) == sorted(plain_alignment(tokens, rows), key=none)


def test_alignment_of_empty_tables(spark, empty):
    got = align.query(spark, empty)
    assert got.collect() == [] and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@given(st.text(alphabet=st.sampled_from("ab .\n\t'▁é日😀1-"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_segments_are_tokenized_apart(text):
    own = align.aligner(*PATHS)
    numbers, digests, _, _ = own.documents([text])
    want = plain_alignment(own.tokens, [(0, text)])[0]
    assert tuple(numbers[0].tolist()) == want[1:5] and digests == [want[7]]


def test_ranks_give_the_file_s_own_ids(tokens):
    assert tokens.divides
    for text in [" " + t for t in ODD if t] + ["".join(map(chr, range(0x20, 0x2000)))]:
        assert tokens.a_ids(text) == tokens.a.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.randoms())
@settings(max_examples=100, deadline=None)
def test_borders(lengths, rng):
    total = sum(lengths)
    cuts = sorted(rng.sample(range(1, total), rng.randint(0, total - 1))) if total > 1 else []
    other = np.diff([0, *cuts, total])
    a, b = align.borders(np.array(lengths), other)
    shared = sorted(set(np.cumsum(lengths).tolist()) & set(np.cumsum(other).tolist()))
    assert a.tolist() == [np.searchsorted(shared, e) for e in np.cumsum(lengths)] and b.tolist() == [np.searchsorted(shared, e) for e in np.cumsum(other)]


# --------------------------------------------------------------------- discovered spans


def plain_patterns(h):
    clean = lambda c: regex.sub(r"^[^\p{L}0]+|[^\p{L}0:=]+$", "", regex.sub("[0-9]", "0", c.lower()))
    words, after = [[w for w in re.split(r"[ \t\n\x0b\f\r]+", h[c]) if w] for c in ("before", "after")]
    one, two, then = (words or [""])[-1], (["", *words])[-2] if len(words) > 1 else "", (after or [""])[0]
    return [f"before {clean(two)} {clean(one)}", f"around {clean(one)} {clean(then)}"]


def plain_discovery(rows):
    """{doc_id: spans that patterns add}, by loops over all hits; rows have doc_id, base and other."""
    edges = {(p, h["text"].lower(), h["kind"]) for r in rows for h in (*r["base"], *r["other"]) for p in plain_patterns(h)}
    seeds = Counter((p, k) for p, _, k in edges if k >= 0)
    fit = {x for x, n in seeds.items() if n >= pii.SEEDS}
    graph = {e for e in edges if e[0] in {p for p, _ in fit}}
    strings, known = defaultdict(set), {s for _, s, k in graph if k >= 0}
    for p, s, _ in graph:
        strings[p].add(s)
    total = {(p, k): len({s for q, s, j in graph if (q, j) == (p, k)}) for p, k in fit}
    confidence = {(p, k): n / (len(strings[p]) + 1) for (p, k), n in total.items()}
    for _ in range(pii.ROUNDS):
        doubt = defaultdict(lambda: 1.0)
        for (p, k), c in confidence.items():
            for s in strings[p] - known:
                doubt[s, k] *= 1 - min(c, 0.999999)
        confidence = {(p, k): (n + sum(1 - doubt[s, k] for s in strings[p] - known)) / (len(strings[p]) + 1) for (p, k), n in total.items()}
    sure = {x for x, c in confidence.items() if c >= pii.CONFIDENCE}
    out = {}
    for r in rows:
        met = {((h["start"], k, h["end"]), p) for h in r["other"] for p in plain_patterns(h) for k in range(4) if (p, k) in sure and regex.search(pii._SHAPE[pii.KINDS[k]], h["text"])}
        out[r["doc_id"]] = {span for span, n in Counter(s for s, _ in met).items() if n > 1}
    return out


def contexts(seed, n=400):
    """Documents that name identifiers in few contexts; some in forms that no base pattern takes, and other numbers elsewhere."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    forms = {
        "phone": (["please call me at {} or write", "tel: {} (office)", "reach us on {} any day"], lambda: f"+1 212 555 {digits(4)}", lambda: rng.choice([f"212-555-{digits(4)}", f"(212) 555 {digits(4)}", f"212 555 {digits(4)}"])),
        "email": (["mail me under {} soon", "contact {} for more"], lambda: f"u{digits(5)}@example.org", lambda: f"u{digits(5)}@localhost"),
        "ip": (["the server at {} went down", "login from {} was refused"], lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: ".".join(str(rng.randrange(300, 900)) for _ in range(4))),
    }
    elsewhere = ["order {} was sent", "costs {} in all", "see page {} there", "item {} of the list"]
    docs, hidden = [], {}
    for i in range(n):
        kind = rng.choice(list(forms))
        said, plain, odd = forms[kind]
        unseen = rng.random() < 0.2
        value = (odd if unseen else plain)()
        line = rng.choice(said).format(value)
        start = rng.choice(["", "Hello. ", "In short: "]) + ("x " if rng.random() < 0.1 else "")
        if unseen:
            at = len(start) + line.index(value)
            hidden[i] = (at, pii.KINDS.index(kind), at + len(value))
        docs.append((i, start + line + " " + rng.choice(elsewhere).format(digits(rng.choice([6, 8, 12])))))
    return docs, hidden


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_against_plain_rounds(spark, seed):
    docs, _ = contexts(seed)
    df = spark.createDataFrame(docs + [(10_000, None), (10_001, "")], "doc_id long, text string")
    found = [r.asDict(recursive=True) for r in pii.spans(df).select("doc_id", "base", "other").collect()]
    want = plain_discovery(found)
    base = {r["doc_id"]: {(h["start"], h["kind"], h["end"]) for h in r["base"]} for r in found}
    got = {r["doc_id"]: {(s["start"], s["kind"], s["end"]) for s in r["spans"]} for r in pii.find(df).collect()}
    assert got == {i: base[i] | want[i] for i in got} and sum(map(len, want.values())) > 40


def test_discovery_of_hidden_identifiers(spark):
    """How much of what no base pattern takes is found by its context, and how much else is."""
    right = wrong = missed = 0
    for seed in (3, 4):
        docs, hidden = contexts(seed, 600)
        for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect():
            added = {(s["start"], s["kind"], s["end"]) for s in r["spans"]} - {(s["start"], s["kind"], s["end"]) for s in r["base"]}
            want = {hidden[r["doc_id"]]} if r["doc_id"] in hidden else set()
            right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
    print(f"\nhidden identifiers: precision {right / max(1, right + wrong):.3f}, recall {right / max(1, right + missed):.3f} of {right + missed}")
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.8


# ---------------------------------------------------------------------------- hot keys


def test_one_component_of_all_rows_is_many_tasks(spark):
    """What is dealt for the joins of a star lies evenly in all partitions, not by the hub."""
    nodes = spark.range(30_000).withColumnRenamed("id", "u").withColumn("m", F.lit(0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put small partitions together
    try:
        sizes = [r["count"] for r in common.apart(nodes, "u").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 2 * 30_000 / len(sizes)
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert common.connected_components(star, "a", "b").groupBy("root").count().collect() == [(0, 3000)]
