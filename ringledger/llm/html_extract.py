"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A page is parsed into a tree of block elements. Every node is described by its subtree (text, link and punctuation density, paragraph and item
counts), its attribute tokens and those of its ancestors, notes of rights, its depth and its siblings. Boosted trees give the probability
that it holds main text, and a bottom-up pass picks the most probable labelling in which nothing below a dropped node is
kept. The trees are trained in numpy on pages composed at random (``compose_page``), with the labels known by construction.

Scale: pages stream in small batches without a shuffle; the model (some kB) travels with the closure.
"""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names of the HTML standard, and words found in attributes of page furniture and of main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style textarea title noscript template iframe noembed noframes head svg annotation annotation-xml button select option datalist".split())
#: Elements that may stay in a head; any other ends it.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes head".split())
#: Content that is shown where the medium is not: nodes of their own, which do not end a paragraph.
FALLBACK = frozenset("object audio video canvas".split())
CONTROLS = frozenset("button input select textarea".split())
TABLE = frozenset("caption table tbody tfoot thead tr td th".split())
#: Elements whose content is HTML again inside svg.
INNER = frozenset("foreignobject desc".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
) | FALLBACK
CLOSES_P = BLOCK - FALLBACK - {"html", "body", "dd", "dt", "li", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
TAG_GROUPS = ["article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "blockquote", "pre", "table thead tbody tfoot tr td th caption", "nav", "header hgroup", "footer", "aside", "form fieldset legend search", "figure figcaption", "html body", "dialog details summary address"]
WORDS = {
    "main": "article articlebody content entry main post story text prose body copy read",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc tabs pagination pager sitemap topbar toolbar skip",
    "head": "header head masthead banner logo branding hero tagline",
    "foot": "footer foot colophon copyright legal bottom imprint",
    "side": "aside sidebar side rail widget related recommended recirc more popular trending tags sticky also",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast subscribe paywall announcement dialog warning",
    "advert": "ad ads adv advert advertisement adslot adbox sponsor sponsored promo promotion dfp commercial outbrain taboola partner",
    "form": "form search login signup signin register newsletter subscription contact captcha input",
    "talk": "comment comments commentlist discussion disqus reply replies respond responses reader reviews feedback",
    "share": "share sharing social follow facebook twitter byline meta author date timestamp print",
}
WORD_GROUP = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}
N_TAGS, N_WORDS = len(TAG_GROUPS), len(WORDS)
TAG_GROUP = {t: k for k, tags in enumerate(TAG_GROUPS) for t in tags.split()}

#: A quote counts only behind an equals sign. Where it is not closed, or only by the quote of a later attribute, the tag ends at the next ``>``.
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]+|=\s*"[^"]*(?<!=)"|=\s*""|=\s*'[^']*(?<!=)'|=\s*''|=(?!\s*["']))*)(?=>)|[^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop|style|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LONG_MARK = re.compile(r"[.!?;:,]")
#: An article's paragraph that is lost weighs as much as so many pieces of furniture that are kept.
MAIN_WEIGHT, SHORT_ARTICLE = 2.0, 12
_RIGHTS = re.compile("\u00a9|\\(c\\)|copyright|all rights reserved", re.I)


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    groups: frozenset = frozenset()
    hidden: bool = False
    children: list = field(default_factory=list)
    texts: list = field(default_factory=list)  # (order, text) blocks that belong to it directly
    link: int = 0
    controls: int = 0  # buttons, fields
    label: object = None


def attribute_groups(text: str) -> tuple[frozenset, bool]:
    groups, hidden = set(), False
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            groups.update(WORD_GROUP[w] for w in (p.lower() for p in _PART.findall(value)) if w in WORD_GROUP)
    return frozenset(groups), hidden


def parse(page: str, marker: str | None = None) -> list[Node]:
    """Block elements in document order, the root first; each with its own text blocks, white space collapsed."""
    root = Node("html", None, 0)
    nodes, stack, parts = [root], [root], []
    hidden: list[str] = []  # the outermost hidden element that is open, and what is open in it
    links, order = 0, 0
    linked = 0
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by element, so no tag looks through the stack

    def flush() -> None:
        nonlocal parts, order, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                stack[-1].texts.append((order, text))
                stack[-1].link += min(linked, len(text))
                order += 1
        parts, linked = [], 0

    def pop(to: int) -> None:
        flush()
        for node in stack[to:]:
            opened[node.tag].pop()
        del stack[to:]

    def add(chunk: str) -> None:
        nonlocal linked
        chunk = html.unescape(chunk) if "&" in chunk else chunk
        parts.append(chunk)
        if links:
            linked += len(chunk.strip())

    def ended(tag: str) -> bool:
        """Ends the hidden elements that a start tag ends; whether the tag does nothing else."""
        in_table = tag in TABLE and bool(opened["table"])
        if hidden == ["head"]:
            if tag not in HEAD:
                hidden.clear()
        elif tag in ("option", "optgroup"):
            while hidden and (hidden[-1] == "option" or hidden[-1] == tag):
                hidden.pop()
        elif "select" in hidden and (tag in ("input", "select", "textarea") or in_table):
            del hidden[hidden.index("select") :]
            return tag == "select"
        elif "svg" in hidden and tag in BLOCK and INNER.isdisjoint(hidden):
            del hidden[hidden.index("svg") :]
        elif tag == "button" and "button" in hidden:
            del hidden[hidden.index("button") :]
        return False

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            if not hidden:
                add(page[at:])
            break
        if hidden == ["head"] and page[at : m.start()].strip():
            hidden.clear()
        if m.start() > at and not hidden:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if not m[1]:
            if hidden and ended(tag):
                continue
            if tag in CONTROLS:
                stack[-1].controls += 1
            if tag in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = close.start() if close else end
                if close:
                    at = page.find(">", at) + 1 or end
                continue
            if tag == "body" or tag == "html":
                hidden.clear()
                continue
            if tag in VOID:
                if tag == "br" and not hidden:
                    parts.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in HIDDEN:
                if tag != "head" or len(nodes) == 1 and not root.texts and not "".join(parts).strip():
                    hidden.append(tag)
                continue
            if hidden:
                if tag in BLOCK or tag in INNER or tag == "optgroup":
                    hidden.append(tag)
                continue
            if tag == "a":
                links = 1
            if tag not in BLOCK:
                continue
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        pop(k)
                        break
                    if stack[k].tag not in ("p",):
                        break
            if tag in CLOSED_BY:
                scope = max((opened[t][-1] for t in SCOPE[tag] if opened[t]), default=0)
                ends = [opened[t][k] for t in CLOSED_BY[tag] if (k := bisect_right(opened[t], scope)) < len(opened[t])]
                if ends:
                    pop(min(ends))
            groups, gone = attribute_groups(m[3]) if m[3].strip() else (frozenset(), False)
            node = Node(tag, stack[-1], len(stack), groups, gone)
            if marker and marker in m[3]:
                node.label = True
            stack[-1].children.append(node)
            nodes.append(node)
            opened[tag].append(len(stack))
            stack.append(node)
        else:
            if tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
                continue
            if hidden and tag in BLOCK and ("select" not in hidden or tag in TABLE) and opened[tag]:
                hidden.clear()  # what was open around them ends
            if tag == "a":
                links = 0
            elif tag in BLOCK and not hidden and opened[tag]:
                pop(opened[tag][-1])
    flush()
    return nodes


def describe(nodes: list[Node]) -> np.ndarray:
    """One row of features a node."""
    n = len(nodes)
    place = {id(x): k for k, x in enumerate(nodes)}
    own = np.zeros((n, 9))  # characters, linked characters, marks, texts, paragraphs, items, nodes, notes of rights, controls
    parent = np.array([0] + [place[id(x.parent)] for x in nodes[1:]])
    for k, x in enumerate(nodes):
        chars = sum(len(t) for _, t in x.texts)
        own[k] = chars, x.link, sum(len(_LONG_MARK.findall(t)) for _, t in x.texts), len(x.texts), x.tag == "p", x.tag in ("li", "dt", "dd"), 1, sum(bool(_RIGHTS.search(t)) for _, t in x.texts), x.controls
    total = own.copy()
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
    siblings = np.array([len(x.parent.children) if x.parent else 1 for x in nodes])
    rank, alike = np.zeros(n), np.ones(n)
    for x in nodes:
        tags: dict[str, int] = {}
        for c in x.children:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        for i, c in enumerate(x.children):
            rank[place[id(c)]], alike[place[id(c)]] = i, tags[c.tag]
    tags, words, above = np.zeros((n, N_TAGS)), np.zeros((n, N_WORDS)), np.zeros((n, N_WORDS))
    furniture, prose, hidden = np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    chars_so_far = 0.0
    for k, x in enumerate(nodes):
        if x.tag in TAG_GROUP:
            tags[k, TAG_GROUP[x.tag]] = 1
        for g in x.groups:
            words[k, g] = 1
        if k:
            p = parent[k]
            above[k] = np.maximum(above[p], words[p])
            furniture[k] = furniture[p] or x.tag in ("nav", "header", "footer", "aside", "form", "dialog")
            prose[k] = prose[p] or nodes[p].tag in ("article", "main")
            hidden[k] = hidden[p]
        hidden[k] = hidden[k] or x.hidden
        before[k] = chars_so_far
        chars_so_far += own[k, 0]
    whole = max(total[0, 0], 1)
    chars, up = total[:, 0], total[parent]
    plain = chars - total[:, 1]  # without links
    bare = max(plain[0], 1)
    group, largest = plain.copy(), np.zeros(n)  # of all siblings of a node's kind; the largest of the page
    for x in nodes:
        sums: dict[str, float] = {}
        for c in x.children:
            k = place[id(c)]
            sums[c.tag] = sums.get(c.tag, 0.0) + plain[k]
        for c in x.children:
            group[place[id(c)]] = sums[c.tag]
    outside = np.where(furniture > 0, 0.0, group)
    largest[:] = max(outside[1:].max(initial=0.0), 1.0)
    columns = [
        np.log1p(chars), np.log1p(own[:, 0]), total[:, 1] / np.maximum(chars, 1), own[:, 1] / np.maximum(own[:, 0], 1), total[:, 2] / np.maximum(chars, 1),
        chars / np.maximum(total[:, 6], 1), chars / np.maximum(total[:, 3], 1), np.log1p(total[:, 3]), np.log1p(total[:, 4]), np.log1p(total[:, 5]), np.log1p(total[:, 6]),
        chars / whole, chars / np.maximum(up[:, 0], 1), np.array([x.depth for x in nodes]), siblings, rank / siblings, alike / siblings, before / whole,
        own[:, 8], total[:, 8], up[:, 8], np.log1p(group), group / bare, group / largest, np.full(n, np.log1p(bare)), np.full(n, n, float), np.full(n, float(len(nodes[0].children))),
        total[:, 7] / np.maximum(total[:, 3], 1), np.log1p(up[:, 0]), up[:, 1] / np.maximum(up[:, 0], 1), np.log1p(up[:, 4]), np.array([nodes[p].tag in ("article", "main", "section") for p in parent]),
    ]
    barred = np.maximum(np.maximum(furniture, hidden), np.maximum((words + above)[:, 1:].sum(1) > 0, own[:, 7] > 0))
    barred = np.maximum(barred, np.isin([x.tag for x in nodes], ("nav", "header", "footer", "aside", "form", "dialog")))
    return np.column_stack([*columns, tags, words, above, furniture, prose, hidden, (words + above)[:, 1:].sum(1), (words + above)[:, 0], total[:, 4] / np.maximum(total[:, 6], 1), barred]).astype(np.float32)


#: The last feature: what cannot be an article.
OPEN = -1


@dataclass
class Trees:
    """Boosted trees of one depth: feature and cut of each inner node, value of each leaf, level by level."""

    start: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(f))]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the weighted logistic loss, with histograms over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # x <= cut b  <=>  bin <= b
    share = np.average(y, weights=weight).clip(1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    f, inner = np.full(len(x), start), 2**depth - 1
    all_f, all_c, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        feature, cut_, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                key = local * bins + binned[:, j]
                gs = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(cuts[j])]
                b = gain.argmax(1)
                better = gain[np.arange(width), b] > best
                best[better] = gain[np.arange(width), b][better]
                feature[first : first + width][better] = j
                cut_[first : first + width][better] = cuts[j][b[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut_[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        f = f + value[leaf]
        all_f.append(feature)
        all_c.append(cut_)
        all_v.append(value)
    return Trees(start, np.array(all_f), np.array(all_c), np.array(all_v))


def decode(nodes: list[Node], log_odds: np.ndarray, most: float = 6.0) -> np.ndarray:
    """The most probable labels in which nothing below a dropped node is kept (nodes taken as independent otherwise)."""
    n = len(nodes)
    place = {id(x): k for k, x in enumerate(nodes)}
    z = np.clip(log_odds, -most, most)
    keep, drop = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
    for k in range(n - 1, 0, -1):
        p = place[id(nodes[k].parent)]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = np.zeros(n, bool)
    for k in range(n):
        kept[k] = keep[k] > drop[k] and (k == 0 or kept[place[id(nodes[k].parent)]])
    return kept


def chosen(nodes: list[Node], features: np.ndarray, log_odds: np.ndarray) -> np.ndarray:
    """``decode``; where no text would be kept, the odds of all that may be an article at all are raised until one is: what has words that are no links, and neither is hidden, nor stands in
    furniture, nor is named like it, nor tells of rights."""
    kept = decode(nodes, log_odds)
    if any(kept[k] and x.texts for k, x in enumerate(nodes)):
        return kept
    may = features[:, OPEN] < 0.5
    place = {id(x): k for k, x in enumerate(nodes)}
    for k, x in enumerate(nodes):
        if k:
            may[k] &= may[place[id(x.parent)]]
    odds = [log_odds[k] for k, x in enumerate(nodes) if may[k] and x.texts and 2 * x.link < sum(len(t) for _, t in x.texts)]
    if not odds:
        return kept
    raised = np.where(may, np.maximum(log_odds + 0.1 - max(odds), log_odds), -1e3)
    inside = raised.copy()
    for k in range(len(nodes) - 1, 0, -1):  # what holds it is kept with it
        if inside[k] > 0:
            inside[place[id(nodes[k].parent)]] = max(inside[place[id(nodes[k].parent)]], 0.1)
    return decode(nodes, inside)


def extract(page: str | None, model: Trees) -> str:
    if not page:
        return ""
    nodes = parse(page)
    features = describe(nodes)
    return _joined(nodes, chosen(nodes, features, model.log_odds(features)))


def _joined(nodes: list[Node], kept: np.ndarray) -> str:
    return "\n".join(t for _, t in sorted(b for k, x in enumerate(nodes) if kept[k] for b in x.texts))


# ---- pages to learn from ----


class Layout(random.Random):
    """Draws of one page. Names of elements say what they hold only where ``named``, elements of their own for furniture and articles are used only where ``semantic``."""

    named = semantic = True

    def made_up(self) -> str:
        return "".join(self.choice("bcdfgklmnprstvxz") + self.choice(["a", "e", "i", "o", "u", "", "1", "9"]) for _ in range(self.randint(1, 4)))


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiouy") for _ in range(r.randint(1, 4))) + r.choice(["", "", "n", "s", ","]) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?", " ***", ""])


def _attrs(r: Layout, kind: str, odds: float = 0.9) -> str:
    if r.random() > odds:
        return r.choice(["", ' class="box"', f' class="c{r.randint(1, 99)}"'])
    if not r.named:
        return f' {r.choice(["class", "class", "id"])}="{r.choice([r.made_up(), r.made_up() + "-" + r.made_up()])}"'
    word = r.choice(WORDS[kind].split())
    word = r.choice([word, f"{word}-{r.choice(['box', 'wrap', 'area', 'inner', 'list', '1'])}", f"site-{word}", f"{word} block", word.capitalize()])
    return f' {r.choice(["class", "class", "id"])}="{word}"'


def _links(r: Layout, low: int = 2, high: int = 9) -> str:
    items = [f'<a href="/{k}">{_sentence(r, 1, 4)}</a>' for k in range(r.randint(low, high))]
    return r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items), "".join(f"<p>{i}</p>" for i in items[:5])])


def _prose(r: Layout, mark: str, low: int = 1, high: int = 14) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        kind, text = r.random(), " ".join(_sentence(r, 1, 18) for _ in range(r.choice([1, 1, 2, 3, 6])))
        if r.random() < 0.04:  # articles may tell of rights too
            text = r.choice(["All rights reserved.", f"Copyright {r.randint(1990, 2030)}.", f"{text} All rights reserved."])
        if r.random() < 0.15:
            text = text.replace(" ", f' <a href="#">{_sentence(r, 1, 3)}</a> ', 1)
        if kind < 0.68:
            out.append(f"<p{mark}>{r.choice(['', '<b>'])}{text}{r.choice(['</p>', '</p>', '<br>'])}")
        elif kind < 0.76:
            out.append(f"<{(h := r.choice(['h2', 'h3']))}{mark}>{_sentence(r, 1, 6)}</{h}>")
        elif kind < 0.84:
            out.append(f"<{(u := r.choice(['ul', 'ol']))}{mark}>" + "".join(f"<li{mark}>{_sentence(r, 1, 12)}</li>" for _ in range(r.randint(1, 6))) + f"</{u}>")
        elif kind < 0.89:
            out.append(f"<blockquote{mark}><p{mark}>{text}</p></blockquote>")
        elif kind < 0.93:
            out.append(f"<table{mark}>" + "".join(f"<tr{mark}><td{mark}>{_sentence(r, 1, 3)}</td><td{mark}>{r.randint(0, 999)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
        elif kind < 0.96:
            out.append(f"<pre{mark}>{text}</pre>")
        else:
            out.append(f"<div{mark}>{text}</div>")
    return "".join(out)


def _furniture(r: Layout, kind: str) -> str:
    told = r.named or r.semantic  # else only what furniture is like can tell it from an article
    text = " ".join(_sentence(r, 2, 14 if told else 8) for _ in range(r.randint(1, 3 if told else 1)))
    wrap = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section", "advert": "div", "notice": "div", "share": "div"}[kind]
    named = r.random() < 0.55
    named = named and r.semantic
    tag, attrs = (wrap, _attrs(r, kind, 0.5 if wrap not in ("div", "section") else 1)) if named else (r.choice(["div", "div", "section"]), _attrs(r, kind, 1))
    body = {
        "menu": lambda: _links(r),
        "head": lambda: r.choice([f"<h1>{_sentence(r, 1, 3)}</h1>", f"<div>{_sentence(r, 1, 3)}</div>", f"<p>{text}</p>"]) + r.choice(["", _links(r)]),
        "foot": lambda: f"&copy; {r.randint(1990, 2030)} {text}" + r.choice(["", _links(r), f"<p>{text}</p>"]),
        "side": lambda: f"<h3>{_sentence(r, 1, 3)}</h3>" + r.choice([_links(r), f"<p>{text}</p>" * r.randint(1, 3 if told else 1), _links(r) + f"<p>{text}</p>"]),
        "form": lambda: f"<label>{_sentence(r, 1, 4)}</label><input name=q>" + r.choice(["", f"<p>{text}</p>"]) + "<button>Go</button>",
        "talk": lambda: r.choice(["", f"<h3>{_sentence(r, 1, 3)}</h3>"]) + "".join(f"<{t}{_attrs(r, 'talk')}><p>{' '.join(_sentence(r, 2, 18) for _ in range(r.randint(1, 4)))}</p></{t}>" for t in [r.choice(["div", "li", "article"] if r.named else ["div", "li"])] for _ in range(r.randint(1, 6))),
        "advert": lambda: r.choice([text, f"<p>{text}</p>", f'<a href="#">{text}</a>', f"<div>{text}</div>"]),
        "notice": lambda: r.choice([text, f"<p>{text}</p>"]) + r.choice(["", "<button>OK</button>", '<a href="#">More</a>']),
        "share": lambda: _links(r, 1, 4),
    }[kind]()
    return f"<{tag}{attrs}>{body}</{tag}>"


def _plain_page(r: Layout) -> str:
    """A page with little beside its article, which may be short, have no element of its own, or stand at the page's beginning or end."""
    mark = " data-main"
    short = lambda: " ".join(_sentence(r, 4, 18) for _ in range(r.choice([1, 1, 2, 3])))
    count = r.choice([1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12])
    tag = r.choice(["p", "p", "p", "p", "div", "li"])
    body = "".join(f"<{tag}{mark}>{short()}</{tag}>" for _ in range(count))
    if tag == "li":
        body = f"<ul{mark}>{body}</ul>"
    if r.random() < 0.3:
        body = f"<{(h := r.choice(['h1', 'h1', 'h2']))}{mark}>{_sentence(r, 2, 9)}</{h}>{body}"
    if r.random() < 0.15:
        body = short()
    for _ in range(r.choice([0, 0, 1, 1, 1, 2])):
        wrap = r.choice(["article", "main", "section", "div", "div"] if r.semantic else ["div", "div", "section"])
        name = r.choice(["", "", f' id="{r.choice("abcxyz")}"', _attrs(r, "main", 0.5)])
        body = f"<{wrap}{mark}{name}>{body}</{wrap}>"
    top = [_furniture(r, k) for k in ("menu", "notice", "head") if r.random() < 0.3]
    end = [_furniture(r, k) for k in ("foot", "menu") if r.random() < 0.3]
    if r.random() < 0.3:
        end.append(f"<{(t := r.choice(['div', 'p', 'div']))}>&copy; {r.randint(1990, 2030)} {_sentence(r, 1, 5)}</{t}>")
    if r.random() < 0.25:
        top.insert(0, f"<div>{_links(r)}</div>")
    return r.choice([f"<html><body>{''.join(top)}{body}{''.join(end)}</body></html>", f"<title>t</title>{''.join(top)}{body}{''.join(end)}"])


def compose_page(r: random.Random) -> str:
    """A page of random layout. Elements that hold main text carry the attribute ``data-main``. Half of the pages have names that say nothing, a third no elements
    that do."""
    r = Layout(r.random())
    r.named, r.semantic = r.random() < 0.5, r.random() < 0.67
    if r.random() < 0.4:
        return _plain_page(r)
    mark = " data-main"
    brief = r.random() < 0.2
    inside = [f"<h1{mark}>{_sentence(r, 2, 12)}</h1>"] if r.random() < 0.85 else []
    inside += [_furniture(r, "share")] if r.random() < 0.25 else []
    for _ in range(1 if brief else r.choice([1, 1, 2, 3])):
        inside += [_prose(r, mark, 1, 1 if brief else 14)]
        inside += [_furniture(r, r.choice(["advert", "side", "form", "notice", "menu"]))] if r.random() < 0.25 else []
    inside += [_furniture(r, r.choice(["talk", "side", "share"]))] if r.random() < 0.2 else []
    tag = r.choice(["article", "article", "main", "div", "section"] if r.semantic else ["div", "div", "section"])
    main = f"<{tag}{mark}{_attrs(r, 'main', 0.35 if tag in ('article', 'main') else 0.9)}>{''.join(inside)}</{tag}>"
    for _ in range(r.choice([0, 0, 1, 2])):
        main = f"<div{mark}{_attrs(r, 'main', 0.4)}>{main}{_furniture(r, 'side') if r.random() < 0.3 else ''}</div>"
    top = [_furniture(r, k) for k in ("head", "menu", "notice", "advert", "form", "share") if r.random() < 0.5]
    end = [_furniture(r, k) for k in ("side", "talk", "advert", "form", "notice", "menu", "foot") if r.random() < 0.5]
    r.shuffle(top)
    return f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 6)}</title><style>p{{}}</style></head><body>{''.join(top)}{main}{''.join(end)}<script>x()</script></body></html>"


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1600, seed: int = 7) -> Trees:
    """Trees fitted to ``pages`` composed pages; the same for every call and every input."""
    r = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        nodes = parse(compose_page(r), "data-main")
        xs.append(describe(nodes))
        ys.append(np.array([k == 0 or x.label is True for k, x in enumerate(nodes)], np.float64))
        ws.append(np.where(ys[-1] > 0, MAIN_WEIGHT * max(1.0, SHORT_ARTICLE / ys[-1].sum()), 1.0))  # short articles count as long ones do
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Trees | None = None) -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars`` (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line breaks in page order. Null and
    empty pages and pages without main text give an empty text. Whole pages are parsed, whatever their length. Unclosed and stray tags are
    repaired as browsers do for paragraphs, items and cells. Repeated rows are returned as often as they came; other columns are not read.
    """
    model = model or trained()
    picked = common.small_batches(pages.select(id_col, url_col, F.col(html_col).alias("html")))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            parsed = [parse(p) if isinstance(p, str) and p else None for p in batch["html"]]
            some = [n for n in parsed if n]
            features = [describe(n) for n in some]
            odds = np.split(model.log_odds(np.concatenate(features)), np.cumsum([len(n) for n in some])[:-1]) if some else []
            each = iter(zip(features, odds, strict=True))
            texts = [_joined(n, chosen(n, *next(each))) if n else "" for n in parsed]
            yield pd.DataFrame({id_col: batch[id_col], url_col: batch[url_col], "text": texts, "n_chars": [len(t) for t in texts]})

    return picked.mapInPandas(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLES: dict[str, str] = {}
