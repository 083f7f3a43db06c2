"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements (unclosed and implied ends are resolved, comments, scripts, styles and
other hidden content dropped, a cut-off end accepted). Every node has a label, content or not; its potential comes
from tag, class and id words, place, text length and share of linked text, and a potential between parent and child
couples their labels. Messages pass from the leaves to the root and back (sum-product), which on a tree gives exact
marginals. The weights are trained on labelled pages written here from a rule (labelled_pages), by gradient ascent on
the log likelihood with those marginals. Blocks of nodes whose marginal exceeds one half are the text.

Cases: null or empty html gives an empty text; a page without block elements is content; pages of any length are read
whole; repeated rows give equal rows; an empty table gives no rows; extra columns aren't read; a marginal of exactly one
half is not content; the words of formulas and drawings are text; character references are decoded once, white space in a block becomes one space, empty blocks vanish.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from glyphreel.llm.common import map_text, table

SECTION = frozenset("html body div section article main nav aside header footer form ul ol dl table tbody thead tfoot tr figure fieldset details dialog center menu hgroup address".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption summary legend label hr".split())
BLOCK = SECTION | LEAF
HEADED = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that isn't shown as text.
HIDDEN = frozenset("script style noscript template textarea select option title head iframe object canvas audio video button desc metadata annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
#: An open element of the value's set ends where the key begins, up to the nearest scope element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}

#: A quote opens a value only behind an equals sign; one that isn't closed before the next tag ends with the tag.
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|([!?])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[\"'][^>]*|[^>=]++|=)*+)(>|\Z))", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("children", "linked", "names", "parent", "size", "stops", "tag")

    def __init__(self, tag: str, parent: int, names: list[str]):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[int] = []
        self.size = self.linked = self.stops = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents before children, and blocks of text in page order with the node that holds them directly."""
    nodes = [Node("#root", -1, [])]
    stack: list[tuple[str, int]] = [("#root", 0)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    hidden = links = at = 0

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                owner = stack[-1][1]
                blocks.append((owner, text))
                nodes[owner].size += len(text)
                nodes[owner].stops += text.count(".") + text.count(",")

    def close_to(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            if tag in HIDDEN:
                hidden -= 1
            if tag == "a":
                links -= 1
            opened[tag] -= 1
            stack.pop()

    def words(text: str) -> None:
        if text and not hidden:
            text = html_lib.unescape(text) if "&" in text else text
            run.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text.strip())

    while m := _TAG.search(html, at):
        words(html[at : m.start()])
        at = m.end()
        end, tag = m[2], (m[3] or "").lower()
        if not tag:
            continue
        if not m[5] and not end:
            break  # the page is cut off inside a tag
        if end:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if opened[tag] else 0
            if depth:
                close_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "hr":
            flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SCOPE.get(tag, ()):
                        break
                    if stack[i][0] in CLOSES[tag]:
                        close_to(i)
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in HEADED) else ():  # a block ends an open paragraph or heading
                if stack[i][0] in HEADED:
                    close_to(i)
                    break
                if stack[i][0] in SECTION or stack[i][0] in ("td", "th", "li", "blockquote"):
                    break
            names = [w for a in _NAMED.finditer(m[4]) for w in _SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if len(w) > 1]
            nodes.append(Node(tag, stack[-1][1], names))
            nodes[stack[-1][1]].children.append(len(nodes) - 1)
            stack.append((tag, len(nodes) - 1))
        else:
            if m[4].endswith("/"):
                continue
            stack.append((tag, stack[-1][1]))
        opened[tag] += 1
        if tag in HIDDEN:
            hidden += 1
        if tag == "a":
            links += 1
    words(html[at:] if not (html.find("<", at) >= 0 and _TAG.search(html, at)) else "")
    close_to(1)
    flush()
    return nodes, blocks


#: Class and id words that count as features; others only count as "named".
KNOWN = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom copyright sidebar side rail widget related recommended more share social follow comment comments commentlist reply replies disqus respond cookie consent notice alert warning popup modal overlay newsletter subscribe signup login search form pagination pager tags toolbar skip disclaimer legal article content main post entry story body text page blog news hentry prose byline author meta date title headline caption lead intro".split()
)


def features(nodes: list[Node]) -> list[list[str]]:
    total, linked, inside = [n.size for n in nodes], [n.linked for n in nodes], [""] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, n in enumerate(nodes):
        p = nodes[n.parent].tag if n.parent >= 0 else "-"
        inside[i] = n.tag if n.tag in ("article", "main", "aside", "nav", "footer", "form") else inside[n.parent] if n.parent >= 0 else ""
        density = int(4 * linked[i] / total[i]) if total[i] else 5
        f = ["b", f"t:{n.tag}", f"t:{n.tag}<{p}", f"l:{min(8, n.size.bit_length())}", f"d:{density}", f"s:{min(3, n.stops)}", f"w:{min(9, total[i].bit_length())}"]
        if n.parent >= 0:
            f.append(f"i:{inside[n.parent]}")
            f.append(f"i:{inside[n.parent]}>{n.tag}")
        f += [f"c:{w}" for w in dict.fromkeys(n.names) if w in KNOWN]
        if n.names and not any(w in KNOWN for w in n.names):
            f.append("c:*")
        out.append(f)
    return out


Pairs = dict[str, list[list[float]]]


def kind(tag: str) -> str:
    return "leaf" if tag in LEAF else "section"


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], unary: list[float], pair: Pairs) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(content) of each node; P of the four label pairs of each node with its parent (root: zeros)."""
    n = len(nodes)
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n  # message to the parent, by its label
    zero, one = [0.0] * n, list(unary)
    for i in range(n - 1, 0, -1):
        t = pair[kind(nodes[i].tag)]
        up[i] = (_log_add(zero[i] + t[0][0], one[i] + t[0][1]), _log_add(zero[i] + t[1][0], one[i] + t[1][1]))
        zero[nodes[i].parent] += up[i][0]
        one[nodes[i].parent] += up[i][1]
    down: list[tuple[float, float]] = [(0.0, 0.0)] * n
    p, edge = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        if i:
            t, q = pair[kind(nodes[i].tag)], nodes[i].parent
            a0, a1 = zero[q] + down[q][0] - up[i][0], one[q] + down[q][1] - up[i][1]
            down[i] = (_log_add(a0 + t[0][0], a1 + t[1][0]), _log_add(a0 + t[0][1], a1 + t[1][1]))
            both = (a0 + t[0][0] + zero[i], a0 + t[0][1] + one[i], a1 + t[1][0] + zero[i], a1 + t[1][1] + one[i])
            m = max(both)
            e = [math.exp(x - m) for x in both]
            s = sum(e)
            edge[i] = tuple(x / s for x in e)
        d = zero[i] + down[i][0] - one[i] - down[i][1]
        p[i] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
    return p, edge


def labelled_pages(n: int = 320, seed: int = 5) -> list[str]:
    """Pages written from templates; data-y marks where content begins (1) and ends (0), for the node and all below."""
    r = random.Random(seed)

    def say(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(a, b)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="#">{say(1, 2)}</a></li>' for _ in range(k))

    def named(*names: str) -> str:
        return f'{r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def para() -> str:
        return r.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", '<p>{} <a href="#">link</a> here.</p>']).format(say(3, 90))

    def extra() -> str:
        return r.choice(
            [
                lambda: f'<div {named("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement")} data-y="0">{say(3, 25)}</div>',
                lambda: f'<aside {named("sidebar", "widget", "related", "rail")} data-y="0"><h3>{say(1, 3)}</h3><p>{say(3, 30)}</p><ul>{links(3)}</ul></aside>',
                lambda: f'<aside data-y="0"><p>{say(3, 40)}</p></aside>',
                lambda: f'<div {named("sidebar", "side", "related", "recommended", "widget")} data-y="0"><h4>{say(1, 3)}</h4><p>{say(4, 30)}</p></div>',
                lambda: f'<div {named("cookie", "notice", "cookie-consent", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer")} data-y="0"><p>{say(4, 40)}</p></div>',
                lambda: f'<form {r.choice(["", named("search", "login", "signup", "newsletter")])} data-y="0"><label>{say(1, 4)}</label><p>{say(2, 15)}</p></form>',
                lambda: f'<div {named("share", "social", "tags", "breadcrumb", "pagination", "toolbar")} data-y="0">{say(1, 4)} <a href="#">{say(1, 3)}</a></div>',
                lambda: f'<section {named("comments", "comment-list", "replies", "respond", "commentlist")} data-y="0"><h3>{say(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{say(3, 50)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>",
                lambda: f'<div {named("comments", "comment-list", "replies", "disqus")} data-y="0">' + "".join(f"<p>{say(3, 50)}</p>" for _ in range(r.randint(1, 4))) + "</div>",
                lambda: f'<section {named("comments", "replies")} data-y="0">' + "".join(f"<p>{say(1, 20)}</p>" for _ in range(r.randint(1, 3))) + "</section>",
                lambda: f'<ol {named("comments", "commentlist")} data-y="0">' + "".join(f"<li>{say(3, 50)}</li>" for _ in range(r.randint(1, 4))) + "</ol>",
            ]
        )()

    pages = []
    for _ in range(n):
        inner = [f"<h1>{say(2, 9)}</h1>" if r.random() < 0.7 else f"<header><h1>{say(2, 9)}</h1></header>" if r.random() < 0.5 else ""]
        for _ in range(r.randint(1, 12)):
            inner.append(r.choices([para, lambda: f"<h2>{say(1, 6)}</h2>", lambda: "<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{say(4, 30)}</p></blockquote>", lambda: f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>", lambda: f"<pre>{say(3, 20)}</pre>", lambda: f"<section><p>{say(4, 50)}</p></section>", lambda: f"<figure><figcaption>{say(2, 10)}</figcaption></figure>", lambda: f"<div>{para()}</div>"], [14, 2, 1, 1, 1, 1, 1, 1, 1])[0]())
            if r.random() < 0.15:
                inner.append(extra())
        if r.random() < 0.3:
            inner.append(extra())
        body = "".join(inner)
        body = r.choices([f'<article data-y="1">{body}</article>', f'<main data-y="1">{body}</main>', f'<main data-y="1"><article>{body}</article></main>', f'<div {named("content", "post", "entry-content", "story", "article-body", "main-content")} data-y="1">{body}</div>', f'<div class="x{r.randint(1, 9)}" data-y="1">{body}</div>'], [6, 2, 2, 4, 1])[0]
        if r.random() < 0.06:  # a fragment without a frame
            pages.append("".join(f'<p data-y="1">{say(8, 60)}</p>' for _ in range(r.randint(1, 6))))
            continue
        top = r.choice([f'<nav data-y="0"><ul>{links(r.randint(3, 8))}</ul></nav>', f'<header data-y="0"><p>{say(1, 8)}</p><nav><ul>{links(4)}</ul></nav></header>', f'<div {named("menu", "navbar", "topbar", "header")} data-y="0"><ul>{links(5)}</ul></div>', f'<header data-y="0"><h2>{say(1, 4)}</h2></header>', f'<header data-y="0"><h1>{say(1, 4)}</h1><p>{say(1, 8)}</p></header>', f'<header data-y="0"><h1>{say(1, 4)}</h1></header>', f'<ul {named("menu", "nav")} data-y="0">{links(5)}</ul>'])
        low = r.choice([f'<footer data-y="0">&copy; {say(4, 25)}</footer>', f'<footer data-y="0"><p>{say(4, 25)}</p><ul>{links(3)}</ul></footer>', f'<div {named("footer", "copyright", "bottom")} data-y="0"><p>{say(3, 20)}</p></div>'])
        around = [extra() if r.random() < 0.5 else "" for _ in range(3)]
        if r.random() < 0.15:  # paragraphs without a wrapper of their own
            body = "".join(x.replace("<p>", '<p data-y="1">', 1) for x in (para() for _ in range(r.randint(1, 9))))
            body = (f'<h1 data-y="1">{say(2, 9)}</h1>' if r.random() < 0.6 else "") + body
        pages.append(f"<!DOCTYPE html><html><head><title>t</title></head><body>{top}{around[0]}{around[1] if r.random() < 0.5 else ''}{body}{around[2]}{low}</body></html>")
    return pages


def gold(html: str) -> tuple[list[Node], list[int]]:
    """Nodes of a labelled page and their labels."""
    marks = [m[1] for m in re.finditer(r"<(?:[^>]*?)data-y=\"([01])\"", html)]
    nodes, _ = parse(re.sub(r'(?:(class|id)="([^"]*)" )?data-y="([01])"', lambda m: f'{m[1] or "class"}="{m[2] or ""} gold{"one" if m[3] == "1" else "zero"}"', html))
    assert marks
    y = [0] * len(nodes)
    for i, n in enumerate(nodes):
        y[i] = 1 if "goldone" in n.names else 0 if "goldzero" in n.names else (y[n.parent] if i else 0)
        n.names = [w for w in n.names if not w.startswith("gold")]
    return nodes, y


@lru_cache(maxsize=1)
def train(epochs: int = 12, rate: float = 0.5, decay: float = 1e-3) -> tuple[dict[str, float], Pairs]:
    """Node and pair weights from the labelled pages, by AdaGrad on the log likelihood."""
    weights: dict[str, float] = {}
    pair: Pairs = {"leaf": [[0.0, 0.0], [0.0, 0.0]], "section": [[0.0, 0.0], [0.0, 0.0]]}
    seen: dict = {}
    data = [(nodes, features(nodes), y) for nodes, y in map(gold, labelled_pages())]
    for _ in range(epochs):
        for nodes, feats, y in data:
            unary = [sum(weights.get(f, 0.0) for f in fs) for fs in feats]
            p, edge = marginals(nodes, unary, pair)
            for fs, pi, yi in zip(feats, p, y, strict=True):
                g = yi - pi
                if abs(g) > 1e-3:
                    for f in fs:
                        step = g - decay * weights.get(f, 0.0)
                        seen[f] = seen.get(f, 1e-6) + step * step
                        weights[f] = weights.get(f, 0.0) + rate * step / math.sqrt(seen[f])
            for i in range(1, len(nodes)):
                k = kind(nodes[i].tag)
                t = pair[k]
                for ab in range(4):
                    a, b = divmod(ab, 2)
                    g = float(y[nodes[i].parent] == a and y[i] == b) - edge[i][ab]
                    if abs(g) > 1e-3:
                        seen[k, ab] = seen.get((k, ab), 1e-6) + g * g
                        t[a][b] += 0.3 * rate * g / math.sqrt(seen[k, ab])
    return weights, pair


def extract(html: str | None) -> str:
    if not html:
        return ""
    nodes, blocks = parse(html)
    if not blocks:
        return ""
    if len(nodes) == 1:
        return "\n".join(t for _, t in blocks)
    weights, pair = train()
    get = weights.get
    p, _ = marginals(nodes, [sum(get(f, 0.0) for f in fs) for fs in features(nodes)], pair)
    return "\n".join(t for i, t in blocks if p[i] > 0.5)


def extract_pages(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    def make() -> Callable:
        train()

        def one(html):
            text = extract(html)
            return text, len(text)

        return one

    return map_text(pages, keys, column, make, "text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
