"""HTML extraction by a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks: the text between two block-level tags, with the elements that are open
there. Each block gets binary features of its ancestors (tag names, words of class, id and role), of
its text (length, links, punctuation, closing words) and of its place. Two labels, main text or not,
form a chain in page order; weights are fitted by the likelihood of labelled pages (forward-backward,
L2) and pages are decoded by Viterbi. The main text is the blocks labelled so, in page order.

Labelled pages are made by `labelled_pages`: layouts of articles, posts and plain divisions with menus,
headers, footers, sidebars, notices, adverts, forms and comments around and inside, filled with invented
words. PAGES of them bound the training, which runs once on the driver in seconds and is the same each
time; the weights (some hundred numbers) go out with the tasks.

Defined results: null and empty pages, and pages without main text, have an empty text and 0 characters;
unclosed and stray tags are handled as browsers do in the plain cases; scripts, styles, templates and
the head never are text, nor what stands inside video, audio, canvas, object, svg or select, which their parent's end
closes if nothing else does; formulas are text; character references are decoded; nothing is capped.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

PAGES = 160
SEED = 7
ROUNDS = 80
PENALTY = 0.02

#: Elements by what they do to text.
RAW = frozenset("script style noscript template textarea iframe title".split())
CONCEALED = frozenset("svg object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br button label legend option summary caption".split())
SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACES = re.compile(r"[\s ]+")
PART = re.compile(r"[a-z]+")

ship_by_value(__name__)


class Open:
    """An open element and what all elements down to it have in common; sets are shared with the parent where nothing is new."""

    __slots__ = ("name", "mine", "tags", "words", "own", "linked", "hidden", "head", "path", "near")

    def __init__(self, name: str, words: list[str], above: Open | None, at: int, paths: dict, known: frozenset[str] | None) -> None:
        tags, held = (above.tags, above.words) if above else (frozenset(), frozenset())
        more = {w for w in words if w not in held and (known is None or w in known)}
        self.name, self.mine = name, words
        self.tags = tags if name in tags else tags | {name}
        self.words = held | more if more else held
        self.own = name if name in BLOCK else above.own if above else None
        self.linked = name == "a" or (above is not None and above.linked)
        self.hidden = name in CONCEALED or (above is not None and above.hidden)
        self.head = name == "head" or (above is not None and above.head)
        self.path = paths.setdefault((above.path if above else 0, name), len(paths) + 1)  # one number for each sequence of names
        self.near = at if name in BLOCK or name == "p" else above.near if above else -1  # the innermost block or paragraph


#: What text outside all elements has.
ROOT = Open("", [], None, -1, {}, None)
ROOT.tags, ROOT.path = frozenset(), 0


def blocks_of(page: str, known: frozenset[str] | None = None) -> list[tuple[str, Open, int]]:
    """(text, innermost open element, characters in links) of each leaf block; of attributes' words only the known ones, if given.

    Time and memory grow with the page, however deep its elements are nested.
    """
    out: list = []
    stack: list[Open] = []
    count: dict[str, int] = {}
    paths: dict = {}
    parts: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text and not (stack and stack[-1].head):
                out.append((text, stack[-1] if stack else ROOT, linked))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if stack and stack[-1].hidden:
            return
        parts.append(piece)
        if stack and stack[-1].linked:
            linked += len(piece)

    def push(name: str, words: list[str]) -> None:
        stack.append(Open(name, words, stack[-1] if stack else None, len(stack), paths, known))
        count[name] = count.get(name, 0) + 1

    def cut(i: int) -> None:
        for gone in stack[i:]:
            count[gone.name] -= 1
        del stack[i:]

    while True:
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if tag[1]:
            if count.get(name):
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if not tag[3].endswith("/"):
                at = close.end() if close else len(page)
            continue
        if name == "body" and stack:
            kept = [e.mine for e in stack if e.name == "html"] if count.get("html") else []
            cut(0)
            for words in kept:
                push("html", words)
        if name in CLOSES_P and count.get("p") and stack[stack[-1].near].name == "p":
            cut(stack[-1].near)
        if name in SAME:
            ends = next((pair for pair in ({"dt", "dd"}, {"td", "th"}) if name in pair), {name})
            if any(count.get(e) for e in ends):
                keepers = SAME[name].split()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in keepers:
                        break
                    if stack[i].name in ends:
                        cut(i)
                        break
        if name in VOID or tag[3].endswith("/"):
            continue
        push(name, [w for m in ATTRIBUTE.finditer(tag[3]) for w in PART.findall((m[2] or m[3] or m[4] or "").lower())])
    flush()
    return out


def features_of(blocks: list) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for i, (text, place, linked) in enumerate(blocks):
        n = len(text)
        names = [f"in:{t}" for t in place.tags if t not in ("html", "body")] + [f"word:{w}" for w in place.words]
        names.append(f"own:{place.own or 'none'}")
        names.append(f"length:{min(n.bit_length(), 10)}")
        names.append(f"links:{min(4, 5 * linked // max(1, n))}")
        names.append(f"stop:{text[-1] in '.!?…:;'}")
        names.append(f"mark:{any(c in text for c in '©»›·')}")
        names.append("first" if i == 0 else "last" if i == len(blocks) - 1 else "amid")
        if i and blocks[i - 1][1].path == place.path:
            names.append("as-before")
        out.append(names)
    return out


class Chain:
    """Weights of a chain with labels 0 (not) and 1 (main text)."""

    def __init__(self, names: dict[str, int], nodes: np.ndarray, steps: np.ndarray) -> None:
        self.names, self.nodes, self.steps = names, nodes, steps
        self.words = frozenset(n.removeprefix("word:") for n in names if n.startswith("word:"))

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.empty((len(features), 2))
        for i, own in enumerate(features):
            known = [self.names[f] for f in own if f in self.names]
            out[i] = self.nodes[known].sum(axis=0)
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best labels, by Viterbi."""
        (a, b), (c, d) = self.steps.tolist()
        rows = scores.tolist()
        zero, one = rows[0]
        back = []
        for s0, s1 in rows[1:]:
            from0, from1 = (0, zero + a) if zero + a >= one + c else (1, one + c), (0, zero + b) if zero + b > one + d else (1, one + d)
            back.append((from0[0], from1[0]))
            zero, one = from0[1] + s0, from1[1] + s1
        at = int(one > zero)
        labels = [at]
        for pair in reversed(back):
            at = pair[at]
            labels.append(at)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "", self.words)
        if not blocks:
            return ""
        labels = self.decode(self.scores(features_of(blocks)))
        return " ".join(b[0] for b, label in zip(blocks, labels) if label)


def _expected(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of neighbouring labels, by forward-backward."""
    n = len(scores)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for i in range(1, n):
        forward[i] = np.logaddexp(forward[i - 1, 0] + steps[0], forward[i - 1, 1] + steps[1]) + scores[i]
    for i in range(n - 2, -1, -1):
        ahead = scores[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(steps[:, 0] + ahead[0], steps[:, 1] + ahead[1])
    total = np.logaddexp(forward[-1, 0], forward[-1, 1])
    one = np.exp(forward + backward - total)
    two = np.zeros((2, 2))
    if n > 1:
        joint = forward[:-1, :, None] + steps[None] + (scores[1:] + backward[1:])[:, None, :] - total
        two = np.exp(joint).sum(axis=0)
    return one, two


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Chain:
    """Weights of the largest penalised likelihood, by adaptive gradient steps over all pages."""
    names = {f: i for i, f in enumerate(sorted({f for features, _ in pages for own in features for f in own}))}
    rows = [[np.array([names[f] for f in own]) for own in features] for features, _ in pages]
    nodes, steps = np.zeros((len(names), 2)), np.zeros((2, 2))
    seen_nodes, seen_steps = np.full_like(nodes, 1e-6), np.full_like(steps, 1e-6)
    flat = [(np.concatenate(r), np.repeat(np.arange(len(r)), [len(x) for x in r])) for r in rows]
    for _ in range(rounds):
        up_nodes, up_steps = -penalty * nodes, -penalty * steps
        for (ids, owner), (_, labels) in zip(flat, pages):
            n = len(labels)
            scores = np.zeros((n, 2))
            np.add.at(scores, owner, nodes[ids])
            one, two = _expected(scores, steps)
            wrong = np.eye(2)[labels] - one
            np.add.at(up_nodes, ids, wrong[owner])
            real = np.zeros((2, 2))
            np.add.at(real, (labels[:-1], labels[1:]), 1.0)
            up_steps += real - two
        seen_nodes += up_nodes**2
        seen_steps += up_steps**2
        nodes += 0.5 * up_nodes / np.sqrt(seen_nodes)
        steps += 0.5 * up_steps / np.sqrt(seen_steps)
    return Chain(names, nodes, steps)


def labelled_pages(count: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """(page, its main blocks) of invented pages."""
    rng = random.Random(seed)
    letters = "aaabcdeeeefghiiklmnnooprrssttuuvéüñ"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 11))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 1, high: int = 16) -> str:
        noise = rng.choice(["", "", "", " |", " $", "%%%", "***", "###", "&amp;&amp;"])
        return words(low, high).capitalize() + noise + rng.choice([".", ".", ".", "?", ""])

    def block(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(n))

    def boiler(kind: str) -> str:
        """A part that is not main text."""
        text = block(1, 3)
        if kind == "nav":
            return rng.choice(['<nav>{}</nav>', '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<div class="breadcrumbs">{}</div>']).format(f"<ul>{links(rng.randint(2, 8))}</ul>")
        if kind == "header":
            return rng.choice(["<header>{}</header>", '<div class="header">{}</div>', '<div id="site-header">{}</div>', '<div class="masthead">{}</div>']).format(f"<a href='/'>{words(1, 3)}</a> <p>{sentence()}</p>")
        if kind == "footer":
            return rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>']).format(f"&copy; {words(1, 3)} &middot; {sentence()}")
        if kind == "aside":
            return rng.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="related">{}</div>', '<aside class="widget">{}</aside>', '<div class="share social">{}</div>']).format(rng.choice([f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>", f"<p>{text}</p>"]))
        if kind == "ad":
            return rng.choice(['<div class="ad">{}</div>', '<div class="ads banner">{}</div>', '<div class="advert">{}</div>', '<div id="advertisement">{}</div>', '<div class="sponsored promo">{}</div>', '<ins class="ad-slot">{}</ins>']).format(rng.choice([text, f"<p>{text}</p>"]))
        if kind == "notice":
            return rng.choice(['<div class="cookie-notice">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="notice">{}</div>', '<div role="alert" class="alert">{}</div>', '<div class="consent popup">{}</div>', '<div class="newsletter subscribe">{}</div>', '<div role="dialog" class="modal">{}</div>', '<dialog>{}</dialog>']).format(f"<p>{text}</p><button>{words(1, 2)}</button>")
        if kind == "form":
            return f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button><p>{sentence()}</p></form>'
        items = "".join(f'<{t}><b>{words(1, 2)}</b><p>{block(1, 3)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 4))
        return rng.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="comment-thread replies">{}</div>', '<section id="discussion" class="reader-comments">{}</section>', '<div class="responses">{}</div>']).format(items)

    kinds = ["nav", "header", "footer", "aside", "ad", "notice", "form", "comment"]
    for _ in range(count):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(SPACES.sub(" ", html.unescape(re.sub(r"<[^>]*>", "", text))).strip(" "))
            return text

        opening, closing = rng.choice(
            [("<article>", "</article>")] * 4
            + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<div class="post entry">', "</div>"), ('<section class="story">', "</section>"), ('<div class="text"><div>', "</div></div>"), ("<div>", "</div>")]
        )
        body = []
        if rng.random() < 0.8:
            body.append(f"<{h}>{keep(sentence())}</{h}>" if (h := rng.choice(["h1", "h1", "h2"])) else "")
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            roll = rng.random()
            if roll < 0.6:
                body.append(f"<p>{keep(block())}</p>")
            elif roll < 0.7:
                body.append(f"<p><b>{keep(block())}<br><p>{keep(block())}</p>")
            elif roll < 0.76:
                body.append(f"<h2>{keep(sentence(1, 6))}</h2>")
            elif roll < 0.82:
                body.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(3)) + "</ul>")
            elif roll < 0.86:
                body.append(f"<blockquote>{keep(block())}</blockquote>")
            elif roll < 0.9:
                body.append(f"<table><tr><td>{keep(sentence())}</td><td>{keep(sentence())}</td></tr></table>")
            elif roll < 0.94:
                body.append("<p>" + keep(f'{sentence()} <a href="/y">{words(1, 4)}</a> {sentence()}') + "</p>")
            else:
                body.append(f"<div>{keep(block())}</div>")
            if rng.random() < 0.12:
                body.append(boiler(rng.choice(["ad", "aside", "notice", "form"])))
        if rng.random() < 0.15:
            body.append(boiler("comment"))
        before = "".join(boiler(rng.choice(["nav", "header", "ad", "notice", "form", "aside", "nav"])) for _ in range(rng.randint(1, 4)))
        after = "".join(boiler(rng.choice(kinds)) for _ in range(rng.randint(0, 3))) + (boiler("footer") if rng.random() < 0.8 else "")
        end = rng.choice(["</body></html>", "</body></html>", ""])
        yield (
            f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{words(2, 5)}</title><style>p{{margin:0}}</style></head>"
            f"<body><script>var t=\"</p>\";</script>{before}<!-- {words(1, 2)} -->{opening}{''.join(body)}{closing}{after}{end}",
            main,
        )


def labelled(page: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page's blocks; a block is main text if the page's main blocks have it, in order."""
    blocks, left = blocks_of(page), list(main)
    labels = []
    for text, *_ in blocks:
        hit = bool(left) and text == left[0]
        labels.append(int(hit))
        if hit:
            left.pop(0)
    return features_of(blocks), labels


@lru_cache(maxsize=1)
def trained() -> Chain:
    return fit([labelled(page, main) for page, main in labelled_pages(PAGES, SEED)])


RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _extractor(chain: Chain):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [chain.text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return extract


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """RESULT of each row; rows stay where they are."""
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(_extractor(trained()), RESULT)
