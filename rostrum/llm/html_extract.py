"""HTML main-text extraction with a tree-structured graphical model.

Each element and each run of text of a page is a node with a hidden label, content or not. Its own features give it a
potential (logistic regression); each parent and child have a potential for their pair of labels. Sum-product messages
pass from the leaves up and from the root down, and give the exact marginal of every node; text runs whose marginal is
above one half are content. Both potentials are trained from labelled pages, which `labelled_pages` lays out from a fixed
seed: the layouts of sites, with invented words, where each node's label is known."""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu nav noscript object ol option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never shown.
UNSEEN = frozenset("script style template noscript head title iframe object svg math textarea select option button datalist audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: An element closes these open ones when it starts, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCKS - {"html", "head", "body", "title", "link", "noscript", "template", "button", "object", "iframe", "caption", "legend", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "html"})
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
BLANKS = re.compile(r"\s+")
HINT = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    label: int = 0


def parse(page: str) -> list[Node]:
    """The page's elements and, as nodes of tag "#", its runs of text: what stands in one block between other blocks. Parents
    come before children, in page order. Every string is closed where it ends, so any text can be parsed."""
    nodes = [Node("html", -1)]
    stack = [(0, "html")]  # inline elements are on the stack with their block's node
    opened: dict[str, int] = {}  # how often a tag is on the stack, so that deep pages aren't searched in vain
    run, links, at, n = -1, 0, 0, len(page)

    def add(text: str) -> None:
        nonlocal run
        if run < 0:
            if not text.strip():
                return
            run = len(nodes)
            nodes.append(Node("#", stack[-1][0]))
        nodes[run].text.append(text)
        if links:
            nodes[run].linked += len(text.strip())

    def close(count: int) -> None:
        nonlocal links, run
        for _ in range(count):
            _, tag = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            if tag in BLOCKS:
                run = -1

    def close_to(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in tags:
                close(len(stack) - k)
                return
            if stack[k][1] in stops:
                return

    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            add(html.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        end, tag, rest = m[1], m[2] or m[4], (m[3] or m[5] or "")
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
        elif end:
            end = end.lower()
            if opened.get(end):
                close_to({end}, frozenset())
            elif end == "br":
                add(" ")
        elif tag:
            tag = tag.lower()
            if tag in CLOSES_P:
                close_to({"p"}, SCOPE)
            if tag in CLOSES:
                close_to(*CLOSES[tag])
            if tag[0] == "h" and tag[1:] in "123456" and stack[-1][1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close(1)
            if tag == "html" or (tag == "body" and opened.get(tag)):
                continue
            if tag in BLOCKS or tag in UNSEEN:
                run = -1
                names = []
                for a in ATTRIBUTE.finditer(rest):
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key in ("hidden", "aria-hidden"):
                        names += ["hidden"] * (value != "false")
                    elif key == "style":
                        names += ["hidden"] * ("display:none" in value.replace(" ", ""))
                    else:
                        names += HINT.findall(value)
                nodes.append(Node(tag, stack[-1][0], tuple(names)))
                if tag in RAW and (stop := re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)):
                    at = stop.end()
                elif tag in RAW:
                    at = n
                elif tag not in VOID:
                    stack.append((len(nodes) - 1, tag))
                    opened[tag] = opened.get(tag, 0) + 1
            elif tag == "br" or tag == "wbr" or tag == "img":
                if run >= 0:
                    add(" " if tag == "br" else "")
            elif tag not in VOID and not rest.rstrip().endswith("/"):
                stack.append((stack[-1][0], tag))
                opened[tag] = opened.get(tag, 0) + 1
                links += tag == "a"
    for v in nodes:
        if v.tag == "#":
            v.text = [BLANKS.sub(" ", "".join(v.text)).strip()]
            v.size = len(v.text[0])
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of each node's features: its tag, the words of its class, id and role, and the shape of its text."""
    size, linked, runs = [v.size for v in nodes], [v.linked for v in nodes], [int(v.tag == "#") for v in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        linked[p] += linked[i]
        runs[p] += runs[i]
    total = max(1, size[0])
    out = []
    for i, v in enumerate(nodes):
        f = [f"tag={v.tag}", "links=" + str(min(4, int(5 * linked[i] / max(1, size[i])))), "runs=" + str(min(5, runs[i].bit_length())), "share=" + str(min(4, int(5 * size[i] / total)))]
        f += [f"name={x}" for x in dict.fromkeys(v.names)]
        if v.tag == "#":
            text, up = v.text[0], nodes[v.parent]
            f += [f"in={up.tag}", "size=" + str(min(8, max(0, v.size.bit_length() - 2))), "stop=" + str(text[-1:] in ".!?…:"), "commas=" + str(min(3, text.count(",")))]
            f += [f"inname={x}" for x in dict.fromkeys(up.names)]
        out.append(f)
    return out


def invented(rng: random.Random, least: int, most: int, stop: str = ".") -> str:
    words = ["".join(rng.choice("b c d f g l m n p r s t v th sh an er on".split()) + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    return (" ".join(words)).capitalize() + (stop if rng.random() < 0.9 else "")


def labelled_pages(count: int, seed: int = 3) -> Iterator[tuple[str, set[str]]]:
    """(page, content): pages in many layouts, and the texts of the blocks that are content."""
    rng = random.Random(seed)
    pick = rng.choice
    for _ in range(count):
        content: set[str] = set()

        def own(text: str, content: set[str] = content) -> str:
            content.add(text)
            return html.escape(text, quote=False)

        def para() -> str:
            text = own(invented(rng, *pick([(1, 3), (5, 30), (20, 120), (40, 200)])))
            return pick([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br></p>", f"<p><b>{text}<br>", f"<p><em>{text}</em></p>"])

        def links(n: int) -> str:
            return "".join(f'<li><a href="/x">{invented(rng, 1, 3, "")}</a></li>' for _ in range(n))

        def noise(kind: str) -> str:
            text = invented(rng, 2, 25)
            if kind == "nav":
                name = pick(["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "main-menu"])
                return pick([f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", f'<div class="{name}"><ul>{links(rng.randint(3, 9))}</ul></div>', f'<ul id="{name}">{links(5)}</ul>'])
            if kind == "header":
                return pick([f"<header><a href='/'>{invented(rng, 1, 3, '')}</a><p>{text}</p></header>", f'<div class="{pick(["header", "site-header", "masthead", "top-bar", "branding", "logo"])}">{text}</div>', f'<div role="banner"><h2>{text}</h2></div>'])
            if kind == "footer":
                return pick([f"<footer>&copy; {text}</footer>", f"<footer><p>{text}</p><ul>{links(4)}</ul></footer>", f'<div id="{pick(["footer", "site-footer", "copyright", "colophon", "bottom"])}"><p>&copy; 2020 {text}</p></div>', f'<div role="contentinfo">{text}</div>'])
            if kind == "side":
                name = pick(["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "tags", "archive", "more-stories", "author-box", "toc"])
                body = pick([f"<h3>{invented(rng, 1, 3, '')}</h3><ul>{links(5)}</ul>", f"<h4>{invented(rng, 1, 3, '')}</h4><p>{text}</p>", f"<p>{text}</p><p>{invented(rng, 8, 60)}</p>"])
                return pick([f"<aside>{body}</aside>", f'<aside class="{name}">{body}</aside>', f'<div class="{name}">{body}</div>', f'<section id="{name}">{body}</section>'])
            if kind == "ad":
                name = pick(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner", "ad-box", "sponsor"])
                return pick([f'<div class="{name}">{text}</div>', f'<div id="{name}-1"><p>{text}</p><a href="/b">{invented(rng, 1, 3, "")}</a></div>', f'<section class="{name}"><p>{text}</p></section>', f'<p class="{name}">{text}</p>'])
            if kind == "notice":
                name = pick(["cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "paywall", "disclaimer", "overlay"])
                return pick([f'<div class="{name}"><p>{text}</p><button>{invented(rng, 1, 2, "")}</button></div>', f'<div id="{name}" role="dialog">{text}</div>', f"<dialog>{text}</dialog>", f'<p class="{name}">{text}</p>', f'<div role="alert">{text}</div>'])
            if kind == "form":
                return pick([f"<form><label>{text}</label><input name=q><button>{invented(rng, 1, 2, '')}</button></form>", f'<form class="search"><p>{text}</p><textarea>{text}</textarea></form>', f'<div class="{pick(["search", "login", "signup", "contact-form"])}"><form><label>{text}</label><select><option>{text}<option>{text}</select></form></div>'])
            if kind == "comments":
                name = pick(["comments", "comment-list", "responses", "discussion", "disqus", "replies", "reviews"])
                each = "".join(pick([f'<div class="comment"><b>{invented(rng, 1, 2, "")}</b><p>{invented(rng, 5, 80)}</p></div>', f'<li class="comment"><p>{invented(rng, 5, 80)}</p></li>', f"<article><p>{invented(rng, 5, 60)}</p></article>", f"<p>{invented(rng, 3, 90)}</p>"]) for _ in range(rng.randint(1, 6)))
                return pick([f'<section class="{name}"><h3>{invented(rng, 1, 3, "")}</h3>{each}</section>', f'<div id="{name}">{each}</div>', f'<ol class="{name}">{each}</ol>'])
            if kind == "share":
                return f'<div class="{pick(["share", "social", "share-buttons", "meta", "byline", "post-meta", "pagination", "tools"])}"><a href="/s">{invented(rng, 1, 2, "")}</a> <a href="/t">{invented(rng, 1, 2, "")}</a></div>'
            return pick([f"<script>var a='{text}</p>';</script>", f"<style>.a{{b:{text}}}</style>", f"<!-- {text} -->", f'<div style="display:none">{text}</div>', f"<noscript>{text}</noscript>"])

        title = invented(rng, 3, 12, "")
        inside = [f"<h1>{own(title)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.74:
                inside.append(para())
            elif kind < 0.8:
                inside.append(f"<h{(k := rng.randint(2, 4))}>{own(invented(rng, 1, 7, ''))}</h{k}>")
            elif kind < 0.86:
                inside.append("<ul>" + "".join(f"<li>{own(invented(rng, 2, 25))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.89:
                inside.append(f"<blockquote><p>{own(invented(rng, 6, 60))}</p></blockquote>")
            elif kind < 0.92:
                inside.append("<table>" + "".join(f"<tr><td>{own(invented(rng, 1, 5, ''))}<td>{own(invented(rng, 1, 5, ''))}" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                inside.append(f"<figure><img src=x><figcaption>{own(invented(rng, 3, 15))}</figcaption></figure>")
            elif kind < 0.96:
                inside.append(f"<pre>{own(invented(rng, 3, 20))}</pre>")
            else:
                inside.append(noise(pick(["ad", "share", "side", "notice", "form", "hidden"])))
        if rng.random() < 0.25:
            inside.append(noise("comments"))
        name = pick(["article", "post", "entry", "content", "post-content", "entry-content", "article-body", "story", "main-content", "text", "body-text"])
        core = "".join(inside)
        core = pick([f"<article>{core}</article>", f"<article>{core}</article>", f'<article class="{name}">{core}</article>', f'<main><div class="{name}">{core}</div></main>', f"<main>{core}</main>", f'<div class="{name}">{core}</div>', f'<div id="{name}"><div>{core}</div></div>', f'<div role="main">{core}</div>', f'<section itemprop="articleBody">{core}</section>', f"<div>{core}</div>"])
        before = [noise(k) for k in ("nav", "header", "ad", "notice", "form", "hidden", "side") if rng.random() < 0.45]
        after = [noise(k) for k in ("side", "comments", "footer", "nav", "ad", "notice", "share", "form") if rng.random() < 0.4]
        rng.shuffle(before)
        wrap = pick(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>'])
        end = pick(["</body></html>", ""])
        yield f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{html.escape(title)}</title><style>p{{}}</style></head><body>" + wrap.format("".join([*before, core, *after])) + end, content


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: log potential of (parent's label, child's label), for element and text children
    pairs: tuple[tuple[tuple[float, float], tuple[float, float]], ...]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content, by messages up and then down the tree."""
        n = len(nodes)
        get = self.weights.get
        one = [self.bias + sum(get(x, 0.0) for x in f) for f in features(nodes)]
        own = [(0.0, -50.0 if v.tag in UNSEEN else z) for v, z in zip(nodes, one, strict=True)]
        up = [list(x) for x in own]  # log potentials with all messages from below
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            t = self.pairs[nodes[i].tag == "#"]
            a, b = up[i]
            m = (log_add(t[0][0] + a, t[0][1] + b), log_add(t[1][0] + a, t[1][1] + b))
            sent[i] = m
            p = up[nodes[i].parent]
            p[0] += m[0]
            p[1] += m[1]
        full = [tuple(up[0])] * n
        for i in range(1, n):
            p, t, s = full[nodes[i].parent], self.pairs[nodes[i].tag == "#"], sent[i]
            a, b = p[0] - s[0], p[1] - s[1]
            full[i] = (up[i][0] + log_add(t[0][0] + a, t[1][0] + b), up[i][1] + log_add(t[0][1] + a, t[1][1] + b))
        return [1 / (1 + math.exp(min(500.0, max(-500.0, x[0] - x[1])))) for x in full]

    def extract(self, page: str | None) -> str:
        nodes = parse(page or "")
        p = self.marginals(nodes)
        return "\n".join(v.text[0] for v, x in zip(nodes, p, strict=True) if v.tag == "#" and v.size and x > 0.5)


def log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labels_of(nodes: list[Node], content: set[str]) -> list[int]:
    """A text's label is known; an element is content when over half of the text in it is."""
    good, size = [0] * len(nodes), [0] * len(nodes)
    hidden = [False] * len(nodes)
    for i, v in enumerate(nodes):
        hidden[i] = v.tag in UNSEEN or (v.parent >= 0 and hidden[v.parent])
        if v.tag == "#" and not hidden[i]:
            size[i], good[i] = v.size, v.size * (v.text[0] in content)
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        good[nodes[i].parent] += good[i]
    return [int(2 * g > s) for g, s in zip(good, size, strict=True)]


@functools.cache
def trained(count: int = 500, seed: int = 3) -> Model:
    """The model of `count` labelled pages: regression for the nodes, smoothed counts for the pairs. The node potential is
    what the features say beyond how common content is, which the pairs say already."""
    rows, y, pairs = [], [], np.ones((2, 2, 2))
    for page, content in labelled_pages(count, seed):
        nodes = parse(page)
        labels = labels_of(nodes, content)
        rows += features(nodes)
        y += labels
        for v, k in zip(nodes[1:], labels[1:], strict=True):
            pairs[int(v.tag == "#"), labels[v.parent], k] += 1
    seen: dict[str, int] = {}
    for f in rows:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 3))}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, f in enumerate(rows):
        x[i, [names[k] for k in f if k in names]] = 1
    t, w = np.array(y, dtype=float), np.zeros(x.shape[1])
    for _ in range(12):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (t - p) - 0.5 * w)
    prior = math.log((t.sum() + 1) / (len(t) - t.sum() + 1))
    table = tuple(tuple(tuple(float(np.log(pairs[k, a, b] / pairs[k, a].sum())) for b in (0, 1)) for a in (0, 1)) for k in (0, 1))
    return Model({k: float(w[i]) for k, i in names.items()}, float(w[-1]) - prior, table)


def main_text(pages: DataFrame, count: int = 500, seed: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the main text, blocks joined by a newline, and its code points.

    Character references are decoded, white space inside a block is one space and none at its ends; nothing else is changed
    or cut. Null or empty html, and pages without content, give an empty text. Repeated rows are read each time; an empty
    table gives an empty one; other columns play no part."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    model = pages.sparkSession.sparkContext.broadcast(trained(count, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = model.value.extract
        for batch in batches:
            text = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
