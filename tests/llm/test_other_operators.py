"""Embeddings, pages, urls, conversations and the pipeline against plain restatements."""

import hashlib
import html
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone import llm
from lodestone.llm import chat, common, embed, html_crf, url_filter

# --------------------------------------------------------------------------- components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, kind):
    rng = random.Random(6)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(70, i) for i in range(60)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], "none": [(3, 3)]}[kind]
    parent = list(range(100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in {x for a, b in edges if a != b for x in (a, b)}}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most", [7, 1 << 18])
def test_components_that_few_tasks_hold_take_few_jobs(spark, monkeypatch, most):
    """A long chain over many tasks, by edges that fit into one task together and by some that don't."""
    monkeypatch.setattr(common, "EDGES", most)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"chain {most}", "")
    try:
        edges = spark.range(60).selectExpr("(id * 37) % 60 AS a").selectExpr("a", "a + 1 AS b").repartition(8)
        got = common.connected_components(edges, "a", "b").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(61)]
    jobs = len(tracker.getJobIdsForGroup(f"chain {most}"))
    assert most == 7 or 0 < jobs <= 16, jobs


# --------------------------------------------------------------------------- embeddings


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [v / np.linalg.norm(v) for _, v in ok]
    n, parent = Counter(), list(range(len(ok)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    named = defaultdict(list)
    for a, (i, _) in enumerate(ok):
        named[find(a)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in named.items()}
    out = Counter((i, n[a], least[find(a)]) for a, (i, _) in enumerate(ok))
    for i, v in rows:
        if not (v and all(x is not None and np.isfinite(x) for x in v) and any(v)):
            out[i, 0, i] += 1
    return out


@pytest.mark.parametrize("block", [embed.BLOCK, 16])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + 0.16 * rng.standard_normal(16) * (i >= 12)]) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [None] * 16), (1005, [-0.0] * 15 + [2.0]), (1006, [0.0] * 15 + [1.0]), (1007, [0.0] * 15 + [2.0])]
    rows += [(1008, [float("inf")] + [1.0] * 15), (1009, [1.0, 2.0]), (1010, [2.0, 4.0]), (1010, [2.0, 4.0]), (None, rows[0][1]), (None, [5.0, -1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, c int, n string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embed.near_duplicates(df).collect())
    assert got == brute(rows)


def test_embedding_query(spark, smallest):
    rows = [(r["vec_id"], r["embedding"]) for r in rows_of(spark, smallest, "embeddings")]
    got = embed.query(spark, smallest).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_blocks_of_a_key_meet_once(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[:] = x[0] + 0.01 * x
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = embed.plan(8, 512)
    side = lambda a: {"x": a, "keys": np.zeros((len(a), p.tables), int), "z": a @ embed.directions(8)}
    i, j = embed._compare(side(unit), side(unit), True, 0, p, 0.95)
    assert len(i) == 300 * 299 // 2
    i, j = embed._compare(side(unit[:100]), side(unit[100:]), False, 0, p, 0.95)
    assert len(i) == 100 * 200
    assert not len(embed._compare(side(unit), side(unit), True, 1, p, 0.95)[0])  # met in table 0 already


def test_recall_at_the_threshold():
    p = embed.plan(64, 1 << 14)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    share = (embed.keys(x, p) == embed.keys(y, p)).any(axis=1)
    count = (np.abs((x - y) @ embed.directions(64)) <= p.half).sum(axis=1) >= p.bound
    assert (share & count).mean() > 0.997


# -------------------------------------------------------------------------------- pages


def test_field_on_new_pages():
    model, rng, right, all_blocks, exact = html_crf.field(), random.Random(77), 0, 0, 0
    for _ in range(150):
        page, wanted = html_crf.labelled_page(rng)
        blocks = html_crf.leaves(page)
        labels, got = html_crf.labels_of(blocks, wanted), model.decode(blocks)
        right += sum(a == b for a, b in zip(labels, got, strict=True))
        all_blocks += len(blocks)
        exact += labels == got
    assert right / all_blocks > 0.97 and exact / 150 > 0.75


def test_viterbi_is_the_best_chain():
    model, rng = html_crf.field(), random.Random(5)
    for _ in range(20):
        blocks = html_crf.leaves(html_crf.labelled_page(rng)[0])[:9]
        own = [sum(model.weights.get(x, 0.0) for x in f) for f in html_crf.features(blocks)]

        def score(y, own=own):
            return sum(o for o, b in zip(own, y, strict=True) if b) + sum(model.steps[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(([int(c) for c in f"{i:0{len(blocks)}b}"] for i in range(2 ** len(blocks))), key=score) if blocks else []
        assert score(model.decode(blocks)) == pytest.approx(score(best))


def test_main_text_of_page_query(spark, smallest):
    pages = {r["page_id"]: r for r in rows_of(spark, smallest, "pages")}
    got = html_crf.query(spark, smallest).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", article))).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


ODD_PAGES = [None, "", "   ", "<", "<p", "<script>x", "plain &amp; simple", "<!-- c", "<p>a<b>b</b> c<p>d &#x41;&nbsp;e", "<div " * 500, "<b>" * 3000 + "x", "<title>t</title><article><p>One sentence that is long enough, surely.</p><script>1</script></article>", "</p></div>x", "<p class='ad>x</p>"]


def test_odd_pages(spark):
    df = spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_crf.extracted(df).collect()}
    assert len(got) == len(ODD_PAGES) and got[0] == got[1] == got[2] == "" and got[5] == ""
    assert got[11] == "One sentence that is long enough, surely."
    assert [b.text for b in html_crf.leaves(ODD_PAGES[8])] == ["ab c", "d A e"]


# --------------------------------------------------------------------------------- urls


def plain_url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host, best = host.translate({c: c + 32 for c in range(65, 91)}), None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return host, path, *(best or (None, None))


URLS = [None, "", "nothing", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "x://com?/", "http://com/", "http://xcom/", "a://" + "q" * 5000 + "/", "a://b://c/d", "http://É.net/es/1", "http://a.b.net/fr/1#x", "://", "http://bestcasinopoker.org/x", "http://thecatsat.org/x", "http://museumofmusic.org/"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "<p>best of the cat sat the cat</p>" if i % 2 else None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judged(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in (("allow", "block") if verdict is None else (verdict,))
    verdicts = {URLS[i]: r["verdict"] for i, r in got.items()}
    assert verdicts["http://bestcasinopoker.org/x"] == "block" and verdicts["http://museumofmusic.org/"] == verdicts["http://thecatsat.org/x"] == verdicts[None] == "allow"


def split_plainly(label, counts, total):
    """The likeliest words of a label, by trying every last word of every beginning."""
    unknown, each = url_filter.costs(total)
    if len(label) > url_filter.LABEL:
        return [label]
    best = [(0.0, [])]
    for end in range(1, len(label) + 1):
        ways = []
        for start in range(end):
            word = label[start:end]
            if word in counts and len(word) <= url_filter.WORD:
                ways.append((best[start][0] + math.log(counts[word] / total), -start, word))
            ways.append((best[start][0] + (unknown - (end - start) * each), -start, word))
        score, back, word = max(ways)
        best.append((score, [*best[-back][1], word]))
    return best[-1][1]


def counts_plainly(pages):
    n = Counter(w for side in url_filter.LISTS.values() for w in set(side.split()))
    for r in pages:
        n.update(w for w in regex.split(r"\P{L}+", re.sub("<[^<>]*>", " ", r["html"] or "").lower()) if 0 < len(w) <= url_filter.WORD)
    return n


@pytest.mark.parametrize("label", ["thecatsat", "abab", "bbaab", "q" * 63, "q" * 64, "cat" * 21, "élan", "x"])
def test_segmentation(spark, label):
    counts = {"the": 50, "cat": 5, "sat": 5, "he": 9, "at": 20, "a": 4, "ab": 3, "b": 2, "ba": 1, "lan": 2}
    hosts = spark.createDataFrame([(label + ".", )], "host string")
    got = url_filter.segmented(hosts, spark.createDataFrame(list(counts.items()), "word string, n long")).first()["tokens"]
    assert got == split_plainly(label, counts, sum(counts.values()))


def weights_plainly(told, spark):
    """Log odds by bucket, from {(host, verdict): buckets}; held-out hosts are not learned from."""
    hosts, side = defaultdict(set), {"block": Counter(), "allow": Counter()}
    for (host, verdict), at in told.items():
        if zlib.crc32(host.encode()) % url_filter.FOLDS != url_filter.HELD:
            for x in at:
                hosts[x].add(host)
                side[verdict][x] += 1
    learned = [x for x in hosts if len(hosts[x]) >= url_filter.SEEN]
    e = url_filter.SMOOTH
    base = math.log((sum(side["block"][x] for x in learned) + e) / (sum(side["allow"][x] for x in learned) + e))
    total = {v: Counter() for v in side}
    for x in learned:
        b, a = side["block"][x] + e, side["allow"][x] + e
        if abs(math.log(b / a) - base) >= url_filter.SURE * math.sqrt(1 / a + 1 / b):
            for v in side:
                total[v][x] += side[v][x]
    for v, words in url_filter.LISTS.items():
        for x in bucket(spark, (words + " " + url_filter.NEUTRAL).split()):
            total[v][x] += url_filter.LISTED
    known = set(total["block"]) | set(total["allow"])
    named = set(bucket(spark, "com example com en www example com en net es net fr".split()))
    return {x: math.log((total["block"][x] + e) / (total["allow"][x] + e)) for x in known - named}


def bucket(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    return [r[0] for r in df.select(F.pmod(F.xxhash64("w"), F.lit(url_filter.BUCKETS)).cast("int")).collect()]


@pytest.mark.parametrize("seen", [url_filter.SEEN, 1])
def test_url_query_against_plain_viterbi_and_bayes(spark, smallest, monkeypatch, seen):
    """Every host, path, rule and verdict of the whole table; with one host enough, words are learned as well."""
    monkeypatch.setattr(url_filter, "SEEN", seen)
    monkeypatch.setattr(url_filter, "SURE", url_filter.SURE if seen > 1 else 0.5)
    pages = rows_of(spark, smallest, "pages")
    counts = counts_plainly(pages)
    total = sum(counts.values())
    words, urls = {}, {}
    for r in pages:
        host, path, rule, verdict = urls[r["page_id"]] = plain_url(r["url"])
        words[host] = [w for label in re.split("[.-]", host) if label for w in split_plainly(label, counts, total)]
    paths = {i: [re.sub("^[0-9]+$", "0", w) for w in regex.findall(r"\p{L}+|\p{N}+", u[1].lower())] for i, u in urls.items()}
    every = sorted({w for ws in [*words.values(), *paths.values()] for w in ws})
    at = dict(zip(every, bucket(spark, every), strict=True))
    told = defaultdict(set)
    for i, (host, _, rule, verdict) in urls.items():
        if rule:
            told[host, verdict] |= {at[w] for w in [*words[host], *paths[i]]}
    odds = weights_plainly(told, spark)
    if seen == 1:
        assert len(odds) > len(weights_plainly({}, spark))
    got = {r["page_id"]: r for r in url_filter.judged(spark.read.parquet(f"{smallest}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    blocked = 0
    for i, (host, path, rule, verdict) in urls.items():
        score = sum(odds.get(at[w], 0.0) for w in [*words[host], *paths[i]]) + math.log(url_filter.PRIOR)
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
        own = "block" if score > 0 else "allow"
        blocked += own == "block"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or own)
    assert blocked
    right = {r["verdict"]: r["right"] for r in url_filter.accuracy(spark.createDataFrame(list(got.values()))).collect()}
    assert set(right) == {"allow", "block"}


def test_url_ties_hot_host_and_long_pages(spark):
    """A host that most pages share, an even score, and a page of a megabyte."""
    rows = [(i, f"http://hot.thecatsat.org/{i}", None) for i in range(3000)] + [(5000, "http://zzz.org/", "word " * 200_000), (5001, "http://casino.org/", "casino")]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and len({r["score"] for i, r in got.items() if i < 3000}) == 1
    assert got[5000]["verdict"] == "allow" and got[5001]["verdict"] == "block"


# -------------------------------------------------------------------------------- chats

PARTS = st.sampled_from(["\\", "</turn>", ": ", "\\### ", "#", "a", "\n", "User", "Assistant", "<", "/turn>", "\U0001f600", " "])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "=", "=user", "User", "x: \\y", "</turn>"]), st.lists(PARTS, max_size=8).map("".join)), max_size=4))
@settings(max_examples=400, deadline=None)
def test_template_is_reversible(turns):
    formatted = "".join(chat.format_turn(*t) for t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns
    loss = [chat.unescape(formatted[a:b]) for a, b in chat.loss_mask(formatted)]
    assert loss == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a", "system": ""},
        {"question": "q", "answer": "a", "extra": {"deep": [1, 2]}},
    ]
    for r in records:
        assert chat.canonical(r) == want
    assert chat.canonical({"instruction": "q", "input": "more", "output": "a"})[0] == ("user", "q\n\nmore")
    assert chat.canonical({"prompt": "q", "response": "a", "system": "s"})[0] == ("system", "s")
    assert chat.canonical({"else": 1}) is None and chat.canonical(None) is None and chat.canonical({"messages": []}) == []
    assert chat.fingerprint(records[0]) == chat.fingerprint({"messages": [{"content": "z", "role": "y"}]}) != chat.fingerprint(records[1])
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "not json"), (99, None)]
    got = {r["k"]: r for r in chat.format_records(spark.createDataFrame(rows, "k int, record string")).collect()}
    assert len({got[i]["formatted"] for i in range(5)}) == 1 and got[98]["formatted"] is None and got[99]["fingerprint"] is None
    (mask,) = got[0]["mask"]
    assert got[0]["formatted"][mask["start"] : mask["end"]] == "a"


def check_chat(rows, got):
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, *((-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant")))]:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r["conv_id"]])
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.format_turn(role, t)) for _, _, role, t in turns)


def test_chat_query(spark, smallest):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of(spark, smallest, "conversations")]
    check_chat(rows, chat.query(spark, smallest).collect())


def test_odd_chats(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "x"), (2**53 + 1, 3, None, "y"), (None, 0, "assistant", "\\"), (None, 1, "assistant", "</turn>" * 4000), (3, 0, "=odd: \\", "")]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    check_chat(rows, chat.query(spark, str(tmp_path)).collect())


# ----------------------------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, smallest, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    want, got = con.sql(llm.oracle_sql()[name]), llm.queries()[name](spark, smallest)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


# ----------------------------------------------------------------------------- pipeline


def test_pipeline(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    seen, at = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        at = common.checkpoint(stage(spark, at, smallest))
        seen.append(at)
    assert [s.columns for s in seen[:-1]] == [docs.columns] * 5
    texts = [Counter(r["doc_id"] for r in s.collect()) for s in seen]
    assert set(texts[1]) < set(texts[0]) and set(texts[2]) < set(texts[1]) and texts[3] == texts[2] and set(texts[4]) <= set(texts[3]) and texts[5] == texts[4]
    assert all(n <= 3 for n in texts[4].values())
    assert not seen[3].where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, smallest).collect())) == sorted(map(tuple, at.collect()))


def test_pipeline_on_odd_and_empty_tables(spark, small, empty):
    for folder in (small, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, common.checkpoint(stage(spark, docs, folder))
            assert docs.columns == before.columns, name
            for r in docs.collect():
                assert folder == empty or all(r[c] == f"{c} of {r['doc_id']}" for c in docs.columns[4:]), name
        assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_rows_keep_their_roles(spark):
    """Names that other layouts use for roles are roles of their own in a table of turns."""
    rows = [(1, 0, "human", "q"), (1, 1, "bot", "a"), (1, 2, "assistant", "b"), (2, 0, "User", "x"), (3, None, None, None)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["loss_chars"] == 1 and got[1]["turns_sha256"] == hashlib.sha256(b"human\nq\nbot\na\nassistant\nb\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"User\nx\n").hexdigest() and got[3]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()


@pytest.mark.parametrize("page, want", [("<p>One.</p>", "One."), ("just text", "just text"), ("<body><div class='content'><p>Hello world, this is the story.</p><p>More.</p></div><div class='sidebar'><p>Read this too, friends.</p></div>", "Hello world, this is the story. More.")])
def test_short_pages_without_marks(page, want):
    assert html_crf.main_text(page, html_crf.field()) == want


def test_reading_is_linear_in_nesting():
    """A broken page of thirty thousand unclosed elements, stray end tags among them, is read at once."""
    began = time.perf_counter()
    found = html_crf.leaves("<div>" * 15_000 + "</p><b>x" * 15_000)
    assert "".join(b.text for b in found) == "x" * 15_000 and found[0].tags == ("div",)
    assert time.perf_counter() - began < 20
