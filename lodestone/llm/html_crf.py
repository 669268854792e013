"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its open
elements. Their tags, the words of their classes and ids, and the text itself give the features of
a block; the chain has two labels, article and rest, with weights for the step from block to block.
The field is trained on labelled pages that this module builds from many layouts, by gradient steps
on the likelihood from the forward-backward pass, and decoded by Viterbi. Training is a constant
amount of work on the driver and doesn't depend on the input.

Scripts, styles, head, comments and other text that a page doesn't show are never blocks.

Defined results: a null, empty or blank page has an empty text; broken markup is read as far as it
goes, unclosed elements end with their parent, an unclosed script hides the rest; repeated rows
each give their row; an empty table gives no rows; other columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not shown; it ends at their own end tag only.
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN_TAGS = frozenset("head svg math object audio video canvas".split())
#: A start tag closes an open element of these, up to the nearest one that bounds the search.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BOUNDS = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote html select".split())

#: Words in classes and ids that a feature is made of.
CUES = frozenset(
    "ad ads advert advertisement article author banner body bottom breadcrumb breadcrumbs byline comment comments consent content cookie "
    "copyright disclaimer entry footer form header legal links login main masthead menu meta nav navbar navigation newsletter notice "
    "page pagination popup post promo related reply search share sidebar signup social sponsor sponsored story subscribe tags text "
    "toolbar top widget wrapper".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|[^<]++|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@dataclass
class Leaf:
    """A leaf block: its text with white space as single spaces, its open block tags and links, cues, and what share of it is links."""

    text: str
    tags: tuple[str, ...]
    cues: tuple[str, ...]
    linked: float


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order."""
    out: list[Leaf] = []
    # Each open element with the tags and cues of itself and all around it, so a leaf needn't walk up.
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []
    open_: Counter[str] = Counter()
    hidden = links = 0
    text: list[str] = []
    in_links = 0
    state = None

    def flush():
        nonlocal text, in_links, state
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                tags, cues = state
                out.append(Leaf(words, tags, cues, min(1.0, in_links / len(words))))
        text, in_links, state = [], 0, None

    def pop(n):
        nonlocal hidden, links
        for name, _, _ in stack[n:]:
            open_[name] -= 1
            hidden -= name in HIDDEN_TAGS
            links -= name == "a"
        del stack[n:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                if not hidden:
                    if state is None and not m.group().isspace():
                        state = stack[-1][1:] if stack else ((), ())
                    text.append(m.group())
                    in_links += len(m.group()) if links else 0
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK_TAGS or name in HIDDEN_TAGS:
                flush()
            for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[i][0] == name:
                    pop(i)
                    break
                if name not in BLOCK_TAGS and stack[i][0] in BLOCK_TAGS:
                    break  # an inline end tag doesn't end a block
            continue
        if name in RAW_TAGS:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            text.append(" ")
        if name in _CLOSES and any(open_[x] for x in _CLOSES[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[name]:
                    pop(i)
                    break
                if stack[i][0] in _BOUNDS:
                    break
        if name not in VOID_TAGS and not m.group(3).endswith("/"):
            attributes = m.group(3)
            cues = ()
            if attributes:
                words = {w for v in _NAMES.findall(attributes) for w in re.findall("[a-z]+", v.lower())}
                cues = tuple(sorted(words & CUES))
            tags, around = stack[-1][1:] if stack else ((), ())
            if (name in BLOCK_TAGS or name == "a") and name not in tags:
                tags = (*tags, name)
            if new := [c for c in cues if c not in around]:
                around = (*around, *new)
            stack.append((name, tags, around))
            open_[name] += 1
            hidden += name in HIDDEN_TAGS
            links += name == "a"
    flush()
    return out


def features(blocks: list[Leaf]) -> list[list[str]]:
    """The features of each block."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        f = ["always", f"words:{min(6, words.bit_length())}", f"linked:{round(b.linked * 2)}", "stop" if b.text[-1] in ".!?…\"”" else "no stop"]
        f += [f"in:{t}" for t in b.tags if t in BLOCK_TAGS or t == "a"]
        f += [f"cue:{c}" for c in b.cues]
        if b.tags:
            f.append(f"leaf:{next((t for t in reversed(b.tags) if t in BLOCK_TAGS), 'none')}")
        commas = b.text.count(",")
        f.append(f"commas:{min(3, commas)}")
        if any(c in b.text for c in "©|»›·"):
            f.append("mark")
        if sum(map(str.isdigit, b.text)) * 4 > n:
            f.append("digits")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        out.append(f)
    return out


# ------------------------------------------------------------------ labelled pages


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page in one of many layouts, and the texts of its article's blocks."""
    letters = rng.choice(["th he in er an re on at nd ou ea", "de la que el os ción as ra do ñe", "der ein ung sch ich ge ver äu ö", "le ou é ent ai è que eau re on"]).split()
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    mark = rng.choice(["", "", "", "", "!!", "***", " |"])

    def sentence(a=3, b=18):
        words = [word() + ("," if rng.random() < 0.1 else "") + mark for _ in range(rng.randint(a, b))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "?", "!", ""])

    wanted: list[str] = []
    used: list[str] = []

    def say(text, keep=False):
        if keep:
            wanted.append(text)
        used.append(text)
        return html.escape(text)

    def name(*words):
        w = rng.choice(words)
        return rng.choice([f' class="{w}"', f' id="{w}"', f' class="{w} {word()}"', f' class="{word()}-{w}"'])

    links = lambda n: "".join(f'<li><a href="/{word()}">{say(" ".join(word() for _ in range(rng.randint(1, 3))))}</a></li>' for _ in range(n))
    rest = {
        "nav": lambda: rng.choice([f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>", f"<div{name('menu', 'nav', 'navbar', 'breadcrumb')}><ul>{links(rng.randint(2, 8))}</ul></div>", f"<ul{name('menu', 'navigation')}>{links(5)}</ul>"]),
        "header": lambda: rng.choice([f"<header><h2>{say(sentence(1, 4))}</h2><p>{say(sentence(2, 8))}</p></header>", f"<div{name('header', 'masthead', 'top', 'banner')}>{say(sentence(1, 6))}</div>"]),
        "ad": lambda: rng.choice([f'<div class="ad">{say(sentence(3, 14))}</div>', f"<div{name('ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}><p>{say(sentence(3, 20))}</p></div>"]),
        "notice": lambda: f"<div{name('cookie', 'consent', 'notice', 'popup', 'disclaimer')}><p>{say(sentence(4, 20))}</p><button>{say(word())}</button></div>",
        "form": lambda: f"<form{rng.choice(['', name('newsletter', 'subscribe', 'login', 'search', 'signup')])}><label>{say(sentence(1, 5))}</label><p>{say(sentence(3, 12))}</p><select><option>{say(word())}</option></select><button>{say(word())}</button></form>",
        "side": lambda: rng.choice([f"<aside><h3>{say(sentence(1, 4))}</h3><p>{say(sentence(3, 20))}</p></aside>", f"<div{name('sidebar', 'widget', 'related', 'social', 'share')}><h3>{say(word())}</h3><ul>{links(4)}</ul><p>{say(sentence(3, 15))}</p></div>"]),
        "comments": lambda: f"<{(t := rng.choice(['section', 'div']))}{name('comments', 'comment', 'reply')}><h3>{say(word())}</h3>" + "".join(f'<div class="comment"><p>{say(sentence(2, 25))}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
        "footer": lambda: rng.choice([f"<footer>&copy; {say(word())} &middot; {say(sentence(2, 20))}</footer>", f"<footer><p>{say(sentence(2, 20))}</p></footer>", f"<div{name('footer', 'copyright', 'legal', 'bottom')}>{say(sentence(2, 16))}</div>"]),
    }

    def paragraph():
        text = " ".join(sentence(*((1, 5) if short else (3, 18))) for _ in range(1 if short else rng.choice([1, 1, 2, 3, 6])))
        kind = rng.random()
        said = say(text, True)
        if kind < 0.72:
            return f"<p>{said}</p>"
        if kind < 0.8:
            return f"<p><b>{said}<br>"
        if kind < 0.86:
            return f"<ul><li>{said}</li></ul>"
        if kind < 0.9:
            return f"<blockquote>{said}</blockquote>"
        if kind < 0.94:
            return f"<h2>{said}</h2>"
        if kind < 0.97:
            return f"<table><tr><td>{said}</td></tr></table>"
        return f"<div>{said}</div>"

    # Some pages hold hardly more than a few short paragraphs, marked by nothing.
    bare = rng.random() < 0.2
    short = bare and rng.random() < 0.7
    before = [] if bare and rng.random() < 0.7 else [rest[k]() for k in rng.sample(["nav", "header", "ad", "notice", "form", "side"], rng.randint(0, 4))]
    inside = [f"<h1>{say(sentence(1, 12), True)}</h1>"] if rng.random() < (0.3 if bare else 0.85) else []
    for _ in range(rng.choice([1, 1, 2, 3] if bare else [1, 1, 2, 3, 5, 9, 16])):
        inside.append(paragraph())
        if rng.random() < 0.06:
            inside.append(rest[rng.choice(["ad", "side", "form", "notice"])]())
    if rng.random() < 0.15:
        inside.append(rest["comments"]())
    start, end = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post entry">', "</div>"), ('<section class="story">', "</section>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ("", "")][7 if bare else 0 :])
    after = [] if bare and rng.random() < 0.6 else [rest[k]() for k in rng.sample(["ad", "notice", "form", "side", "comments", "nav", "footer", "footer"], rng.randint(0, 5))]
    head = f"<!DOCTYPE html><html><head><title>{word()}</title><script>var t='</p>';</script></head>" if rng.random() < 0.8 else ""
    wrap = rng.choice([("<body>", "</body></html>"), ("<body>", ""), ('<body><div class="wrapper">', "</div></body>")])
    return head + wrap[0] + "".join(before) + start + "".join(inside) + end + "".join(after) + wrap[1], wanted


def labels_of(blocks: list[Leaf], wanted: list[str]) -> list[int]:
    """1 for the blocks of the article, matched in order."""
    left, out = [" ".join(t.split()) for t in wanted], []
    for b in blocks:
        hit = bool(left) and b.text == left[0]
        out.append(int(hit))
        if hit:
            left.pop(0)
    if left:
        raise ValueError("a labelled block was not read")
    return out


# ----------------------------------------------------------------------- the field


@dataclass(frozen=True)
class Field:
    """Weights: of each feature for article over rest, and of each step from label to label."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """The likeliest labels of the whole chain, by Viterbi."""
        get, steps = self.weights.get, self.steps
        best0 = best1 = 0.0
        back = []
        for i, f in enumerate(features(blocks)):
            own = sum([get(x, 0.0) for x in f])
            if i == 0:
                best1 = own
                back.append((0, 0))
                continue
            a, b, c, d = best0 + steps[0][0], best1 + steps[1][0], best0 + steps[0][1], best1 + steps[1][1]
            back.append((int(b > a), int(d >= c)))
            best0, best1 = max(a, b), max(c, d) + own
        out, label = [], int(best1 >= best0)
        for pair in reversed(back):
            out.append(label)
            label = pair[label]
        return out[::-1]


def train(pages: int = 600, rounds: int = 250, seed: int = 9, ridge: float = 0.02) -> Field:
    """Maximise the penalised likelihood of labelled pages; all chains advance together, padded."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, wanted = labelled_page(rng)
        blocks = leaves(page)
        data.append((features(blocks), labels_of(blocks, wanted)))
    names = sorted({x for fs, _ in data for f in fs for x in f})
    index = {x: i for i, x in enumerate(names)}
    longest = max(len(fs) for fs, _ in data)
    y = np.zeros((pages, longest), int)
    mask = np.zeros((pages, longest), bool)
    rows, cols = [], []
    for p, (fs, labels) in enumerate(data):
        y[p, : len(fs)], mask[p, : len(fs)] = labels, True
        for t, f in enumerate(fs):
            rows += [p * longest + t] * len(f)
            cols += [index[x] for x in f]
    rows, cols = np.array(rows), np.array(cols)
    w, steps = np.zeros(len(names)), np.zeros((2, 2))
    total = mask.sum()
    m = [np.zeros_like(w), np.zeros_like(steps)]
    v = [np.zeros_like(w), np.zeros_like(steps)]
    pair = mask[:, 1:]
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    for step in range(1, rounds + 1):
        own = np.bincount(rows, weights=w[cols], minlength=pages * longest).reshape(pages, longest)
        emit = np.stack([np.zeros_like(own), own], axis=2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, 0, None] + steps[0], forward[:, t - 1, 1, None] + steps[1]) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(steps[:, 0] + ahead[:, 0, None], steps[:, 1] + ahead[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        one = np.exp(forward[:, :, 1] + backward[:, :, 1] - z)
        gradient_w = np.bincount(cols, weights=(one - y).ravel()[rows], minlength=len(names)) / total + ridge / 100 * w
        joint = forward[:, :-1, :, None] + steps + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, :, None, None]
        gradient_s = (np.where(pair[:, :, None, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=(0, 1)) - seen_steps) / total + ridge / 100 * steps
        for i, (x, g) in enumerate(((w, gradient_w), (steps, gradient_s))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field({n: float(x) for n, x in zip(names, w, strict=True)}, tuple(tuple(float(x) for x in r) for r in steps))


@lru_cache(maxsize=1)
def field() -> Field:
    return train()


def main_text(page: str, model: Field) -> str:
    blocks = leaves(page)
    return " ".join(b.text for b, label in zip(blocks, model.decode(blocks), strict=True) if label) if blocks else ""


def extracted(df: DataFrame, column: str = "html", to: str = "text", model: Field | None = None) -> DataFrame:
    """The frame with the main text of every page; nothing shuffles."""
    own = model or field()
    keep = [c for c in df.columns if c not in (column, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py() or "", own) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, to])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{to}` string"])
    return df.select(*keep, F.col(column).cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", ("page_id", "url", "html"))).withColumn("n_chars", F.char_length("text").cast("long"))


#: The query in SQL for pages whose article is one article element of paragraphs, as in the test tables.
SQL = r"""SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages)"""
