"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (text between block-level tags) with their ancestors. Features of a
block are the tags, class and id words of its ancestors and its text's shape; a two-label chain
(content, boilerplate) is trained on labelled pages by exact gradients (forward-backward) in numpy
and decoded by Viterbi. ``default_model`` trains on pages that ``labelled_pages`` writes by rule;
``train`` takes any others. Extraction is narrow: no shuffle, one page at a time.

Defined cases: null or empty html gives an empty text; cut pages and unclosed or stray tags are read
as far as they go, tags may be nested to any depth; the tags that HTML lets a page leave out (</head>, <body>,
</p>, </li>) are filled in; what the attributes hidden, aria-hidden or style hide is no text; pages
without text give an empty text; null ids and repeated rows pass through; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratiform.llm import common as C
from stratiform.llm.ogg import _arrow_type

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Their content is never text.
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
HIDDEN = frozenset("head noscript template svg math select option button canvas audio video object datalist input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = BLOCK - {"body", "html", "head"}
#: Start tags that may stand in a head (any other, and text, ends it), and those that end an open svg or math.
_IN_HEAD = frozenset("head html title meta link base basefont bgsound script style noscript noframes template".split())
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s section article small span strong strike sub sup table tt u ul var".split())
#: Inside these elements of svg and math stands ordinary html.
_ISLANDS = frozenset("foreignobject desc annotation-xml".split())
_SCOPE = frozenset("td th table caption article section div body main aside nav header footer form blockquote ul ol".split())
_REGION = frozenset("article main nav header footer aside form".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_PART = re.compile(r"[a-z]+|[0-9]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPACE = re.compile(r"\s+")
_EMPTY_COMMENT, _COMMENT_END = re.compile(r"<!---?>"), re.compile(r"--!?>")


@dataclass
class Block:
    """A leaf block: its text, and what is above it: distinct tags, outermost first and its own last, distinct
    names, its nearest named or region element, and the depth."""

    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int
    near: tuple[str, ...] = ()
    depth: int = 0


@dataclass
class _Open:
    """An open tag and what it adds up to with those above it; shared where it adds nothing."""

    tag: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    near: tuple[str, ...]
    hides: bool = False


_NONE = _Open("", (), (), ("",))


def _tag(page: str, at: int) -> tuple[str, str, bool, int]:
    """Name, class and id words, whether its attributes hide its content, and the end of the tag that begins at ``at`` (behind <)."""
    name = _NAME.match(page, at).group()
    at += len(name)
    names, hides = "", False
    n = len(page)
    while at < n and page[at] != ">":
        m = _ATTRIBUTE.match(page, at)
        if not m or m.end() == at:
            at += 1
            continue
        attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attribute in ("class", "id", "role"):
            names += " " + value
        elif attribute == "hidden":
            hides = value.lower() != "until-found" or hides
        elif attribute == "aria-hidden":
            hides = value.strip().lower() == "true" or hides
        elif attribute == "style":
            hides = bool(_NOT_SHOWN.search(_html.unescape(value))) or hides
        at = m.end()
    return name.lower(), names, hides, at + 1


def blocks(page: str | None, known: Callable[[str], bool] | None = None) -> list[Block]:
    """Leaf blocks in page order. White space inside a block becomes one space.

    ``known``: the only names to keep (others mean nothing to a model), so that what is kept of a page of
    ever new names, nested without end, is bounded.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    count: Counter[str] = Counter()
    pieces: list[str] = []
    linked, hidden, in_link = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                top = stack[-1] if stack else _NONE
                out.append(Block(text, (*(t for t in top.tags if t != top.tag), top.tag) if stack else (), top.names, linked, top.near, len(stack)))
            pieces.clear()
        linked = 0

    def push(tag: str, own: str, hides: bool) -> None:
        nonlocal hidden, in_link
        above = stack[-1] if stack else _NONE
        words = [w for w in _PART.findall(own.lower()) if known is None or known(w)] if own else []
        new = [w for w in dict.fromkeys(words) if w not in above.names]
        tags = above.tags if tag in above.tags else (*above.tags, tag)
        stack.append(_Open(tag, tags, (*above.names, *new) if new else above.names, (tag, *words) if own or tag in _REGION else above.near, hides or tag in HIDDEN))
        count[tag] += 1
        hidden += stack[-1].hides
        in_link += tag == "a"

    def pop_to(k: int) -> None:
        nonlocal hidden, in_link
        for x in stack[k:]:
            count[x.tag] -= 1
            hidden -= x.hides
            in_link -= x.tag == "a"
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal linked
        if stack and stack[-1].tag == "head" and raw.strip():
            pop_to(len(stack) - 1)
        if raw and not hidden:
            text = _html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            if empty := _EMPTY_COMMENT.match(page, lt):
                at = empty.end()
                continue
            end = _COMMENT_END.search(page, lt + 4)
            at = n if not end else end.end()
        elif nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif nxt.isascii() and nxt.isalpha():
            name, names, hides, at = _tag(page, lt + 1)
            if stack and stack[-1].tag == "head" and name not in _IN_HEAD:
                flush()
                pop_to(len(stack) - 1)
            if name in _BREAKS_OUT and (count["svg"] or count["math"]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in _ISLANDS:
                        break
                    if stack[k].tag in ("svg", "math"):
                        pop_to(k)
                        if not (count["svg"] or count["math"]):
                            break
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = n if not end else end.start()
                continue
            if name in BLOCK:
                flush()
                if name in _ENDS_P and count["p"]:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].tag == "p":
                            pop_to(k)
                            break
                        if stack[k].tag in _SCOPE:
                            break
                if own := _SAME.get(name):
                    for k in range(len(stack) - 1, -1, -1) if any(count[t] for t in own.split()) else ():
                        if stack[k].tag in own.split():
                            pop_to(k)
                            break
                        if stack[k].tag in ("ul", "ol", "dl", "table", "menu"):
                            break
                if name == "body" and count["head"]:  # a head's own hidden element was left open
                    pop_to(next(k for k, x in enumerate(stack) if x.tag == "head"))
            elif name == "br":
                add(" ")
            if name not in VOID and page[at - 2 : at - 1] != "/" or name in BLOCK and name != "hr":
                push(name, names, hides)
        elif nxt == "/" and (m := _NAME.match(page, lt + 2)):
            name = m.group().lower()
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if count[name] else ():
                if stack[k].tag == name:
                    pop_to(k)
                    break
                if name not in BLOCK and stack[k].tag in _SCOPE:
                    break
        else:
            add("<")
            at = lt + 1
    flush()
    return out


_CUES = re.compile(r"\b(cookies?|privacy|copyright|rights reserved|subscribe|newsletter|log ?in|sign (?:up|in)|comments?|replied|reply|share|related|read more|advert\w*|sponsored|terms|menu|search|contact|download app|posted by)\b|©|»|›", re.I)


def features(all_blocks: list[Block], k: int) -> list[str]:
    """Features of block k of a page."""
    b = all_blocks[k]
    words = b.text.count(" ") + 1
    density = b.linked / max(1, len(b.text))
    marks = sum(b.text.count(c) for c in ".,;:!?")
    out = ["1", f"tag={b.tags[-1] if b.tags else ''}", f"words={min(7, words.bit_length())}", f"link={min(3, int(density * 4))}", f"marks={min(3, marks)}", f"end={b.text[-1] in '.!?…»”'}", f"cues={min(2, len(_CUES.findall(b.text)))}", f"depth={min(6, b.depth)}"]
    out += [f"in={t}" for t in set(b.tags)] + [f"name={w}" for w in b.names]
    if "article" in b.tags or "main" in b.tags:
        out += [f"inside&name={w}" for w in b.names] + [f"inside&words={min(7, words.bit_length())}", f"inside&tag={b.tags[-1]}"]
    out += [f"near={x}" for x in b.near] + [f"near&link={b.near[0]}&{min(3, int(density * 4))}"]
    if k == 0 or k == len(all_blocks) - 1:
        out.append(f"edge={'first' if k == 0 else 'last'}")
    return out


class Crf:
    """Weights of a two-label chain; label 1 is content."""

    def __init__(self, at: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.at, self.emit, self.move = at, emit, move

    def knows(self, name: str) -> bool:
        """Whether a class or id word is in any feature."""
        return f"name={name}" in self.at or f"near={name}" in self.at or f"inside&name={name}" in self.at

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.at.get
        return np.array([self.emit[[i for f in row if (i := get(f)) is not None]].sum(axis=0) for row in rows]).reshape(-1, 2)

    def viterbi(self, page: list[Block]) -> list[int]:
        """The most probable labels of all blocks of a page; ties go to boilerplate."""
        if not page:
            return []
        s = self.scores([features(page, k) for k in range(len(page))]).tolist()
        m = self.move.tolist()
        best, back = s[0], []
        for e in s[1:]:
            frm = [int(best[1] + m[1][y] > best[0] + m[0][y]) for y in (0, 1)]
            back.append(frm)
            best = [best[frm[y]] + m[frm[y]][y] + e[y] for y in (0, 1)]
        y = int(best[1] > best[0])
        out = [y]
        for frm in reversed(back):
            y = frm[y]
            out.append(y)
        return out[::-1]


class Sample:
    """Labelled pages in arrays: all pages are padded to one length and go through forward and backward together."""

    def __init__(self, pages: Iterable[tuple[list[Block], list[int]]]) -> None:
        data = [(b, y) for b, y in pages if b]
        rows = [[features(b, k) for k in range(len(b))] for b, _ in data]
        self.at = {f: i for i, f in enumerate(sorted({f for page in rows for row in page for f in row}))}
        self.n, self.length, self.d = len(data), max(len(b) for b, _ in data), len(self.at)
        self.idx = np.array([self.at[f] for page in rows for row in page for f in row])
        self.cell = np.repeat([p * self.length + k for p, page in enumerate(rows) for k in range(len(page))], [len(row) for page in rows for row in page])
        self.mask, self.gold = np.zeros((self.n, self.length), bool), np.zeros((self.n, self.length), int)
        for p, (_, y) in enumerate(data):
            self.mask[p, : len(y)], self.gold[p, : len(y)] = True, y

    def loss(self, w: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """Negative log-likelihood a page, with the penalty, and its gradient."""
        d, n, length, mask, gold = self.d, self.n, self.length, self.mask, self.gold
        emit, move = w[: 2 * d].reshape(d, 2), w[2 * d :].reshape(2, 2)
        s = np.stack([np.bincount(self.cell, weights=emit[self.idx, y], minlength=n * length) for y in (0, 1)], axis=1).reshape(n, length, 2)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = s[:, 0]
        for t in range(1, length):
            step_on = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step_on, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            x = s[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(move[:, 0] + x[:, 0, None], move[:, 1] + x[:, 1, None]), 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        g_cell = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        np.put_along_axis(g_cell, gold[:, :, None], np.take_along_axis(g_cell, gold[:, :, None], 2) - mask[:, :, None], 2)
        g_emit = np.stack([np.bincount(self.idx, weights=g_cell.reshape(-1, 2)[self.cell, y], minlength=d) for y in (0, 1)], axis=1)
        pair = alpha[:, :-1, :, None] + move[None, None] + (s + beta)[:, 1:, None, :] - z[:, None, None, None]
        on = mask[:, 1:]
        g_move = (np.exp(np.where(on[:, :, None, None], pair, -1e9))).sum(axis=(0, 1))
        np.subtract.at(g_move, (gold[:, :-1][on], gold[:, 1:][on]), 1)
        right = (np.take_along_axis(s, gold[:, :, None], 2)[:, :, 0] * mask).sum() + move[gold[:, :-1][on], gold[:, 1:][on]].sum()
        return float((z.sum() - right) / n + l2 / 2 * (w @ w)), np.concatenate([g_emit.ravel(), g_move.ravel()]) / n + l2 * w


def train(pages: Iterable[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> Crf:
    """Maximum conditional likelihood over labelled pages, by Adam over exact gradients."""
    sample = Sample(pages)
    d = sample.d
    w, m, v = (np.zeros(d * 2 + 4) for _ in range(3))
    for step in range(1, steps + 1):
        _, g = sample.loss(w, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(sample.at, w[: 2 * d].reshape(d, 2), w[2 * d :].reshape(2, 2))


#: Names that pages give to the parts this operator tells apart.
CONTENT_NAMES = "content post entry story article-body post-content main-content entry-content text body-text story-body page-content".split()
BOILERPLATE_NAMES = {
    "nav": "nav menu navbar breadcrumb breadcrumbs topnav main-menu pagination".split(),
    "header": "header top masthead site-header banner branding".split(),
    "footer": "footer bottom site-footer copyright colophon legal".split(),
    "aside": "sidebar side widget related recommended aside related-posts most-read tags".split(),
    "ad": "ad ads advert advertisement promo sponsored sponsor ad-slot banner-ad".split(),
    "notice": "notice cookie cookie-notice cookie-banner alert consent gdpr newsletter popup modal subscribe".split(),
    "form": "form search login signup search-form comment-form contact".split(),
    "comments": "comments comment replies discussion responses disqus reader-comments comment-list".split(),
    "share": "share social sharing share-buttons follow".split(),
}


def labelled_pages(n: int = 500, seed: int = 7, plain: float = 0.0) -> Iterator[tuple[str, dict[str, int]]]:
    """Training pages written by rule: html, and the label of every block's text. ``plain``: share of pages whose article stands in elements without a telling tag or name."""
    rnd = random.Random(seed)
    syllables = "an be con de er fi ga ho in ja ke lo mi no or pa qui re sa te un ve wi za".split()
    count = 0

    def words(low: int, high: int) -> str:
        nonlocal count
        count += 1
        out = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(low, high))]
        return " ".join([out[0].title() + f"x{count}", *out[1:]])

    def prose(low: int, high: int) -> str:
        return " ".join(words(3, 14) + rnd.choice([".", ".", ".", ",", "!", "?"]) for _ in range(rnd.randint(low, high))) + "."

    for _ in range(n):
        labels: dict[str, int] = {}
        bare = plain > 0 and rnd.random() < plain

        def leaf(tag: str, text: str, y: int, inner: str = "", labels: dict[str, int] = labels) -> str:
            labels[text] = y
            close = "" if tag in ("p", "li") and rnd.random() < 0.15 else f"</{tag}>"
            body = f"<a href='/x'>{text}</a>" if inner == "a" else f"<{inner}>{text}</{inner}>" if inner else text
            return f"<{tag}>{body}{close}"

        def part(kind: str, leaf=leaf) -> str:
            name = rnd.choice(BOILERPLATE_NAMES[kind])
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
            tag = tag if rnd.random() < 0.6 else "div"
            mark = f' {rnd.choice(["class", "id"])}="{name}"' if tag == "div" or rnd.random() < 0.5 else ""
            inside = ""
            if bare and kind in ("nav", "footer", "share") and rnd.random() < 0.5:
                tag, mark = "div", ""
            if kind in ("nav", "share"):
                inside = "<ul>" + "".join(leaf("li", words(1, 3), 0, "a") for _ in range(rnd.randint(3, 8))) + "</ul>"
            elif kind == "header":
                inside = leaf(rnd.choice(["div", "h1", "p"]), words(1, 4), 0, rnd.choice(["", "a"])) + (leaf("p", words(3, 8), 0) if rnd.random() < 0.5 else "")
            elif kind == "footer":
                inside = leaf(rnd.choice(["p", "div"]), "© " + words(2, 12) + rnd.choice(["", "."]), 0) + "".join(leaf("p", words(1, 3), 0, "a") for _ in range(rnd.randint(0, 3)))
            elif kind == "aside":
                inside = leaf("h3", words(1, 4), 0) + "".join(leaf(rnd.choice(["li", "p"]), words(3, 10), 0, rnd.choice(["a", "a", ""])) for _ in range(rnd.randint(2, 6))) + (leaf("p", prose(1, 3), 0) if rnd.random() < 0.4 else "")
            elif kind == "form":
                inside = leaf("label", words(1, 2), 0) + leaf("p", words(2, 8), 0) + "<input type='text'><button>Go</button>"
            elif kind == "comments":
                inside = leaf("h3", words(1, 3), 0) + "".join(f'<div class="{rnd.choice(["comment", "comment-body", "reply"])}">' + leaf("p", words(1, 2), 0) + leaf("p", prose(1, 6), 0) + "</div>" for _ in range(rnd.randint(1, 5)))
            else:
                inside = leaf(rnd.choice(["p", "div", "span"]) if kind == "notice" else rnd.choice(["p", "div"]), prose(1, 3) if rnd.random() < 0.6 else words(2, 8), 0)
                if rnd.random() < 0.3:
                    inside = next(iter(re.findall(r"^<\w+>(.*?)(?:</\w+>)?$", inside)), inside)
            return f"<{tag}{mark}>{inside}</{tag}>"

        def article(leaf=leaf, part=part) -> str:
            out = []
            if rnd.random() < 0.85:
                title = leaf(rnd.choice(["h1", "h1", "h2"]), words(3, 12), 1)
                out.append(f"<header>{title}</header>" if rnd.random() < 0.15 else title)
            for _ in range(rnd.randint(1, 9)):
                r = rnd.random()
                if r < 0.7:
                    r = rnd.random()
                    text = prose(1, 8) if r < 0.6 else words(1, 6) + "." if r < 0.7 else words(2, 8) if r < 0.75 else words(8, 90)
                    text = text.replace(" ", " | ") if rnd.random() < 0.08 else text
                    out.append(leaf("p", text, 1, rnd.choice(["", "", "", "b"])))
                elif r < 0.78:
                    out.append(leaf(rnd.choice(["h2", "h3"]), words(2, 7), 1))
                elif r < 0.86:
                    out.append("<ul>" + "".join(leaf("li", words(3, 12) + ".", 1) for _ in range(rnd.randint(2, 5))) + "</ul>")
                elif r < 0.9:
                    out.append(leaf("blockquote", prose(1, 3), 1))
                elif r < 0.93:
                    out.append("<table>" + "".join("<tr>" + "".join(leaf("td", words(1, 4), 1) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
                elif r < 0.95:
                    out.append(leaf("pre", words(4, 12), 1))
                else:
                    out.append(part(rnd.choice(["ad", "aside", "share", "notice"])))
            if rnd.random() < 0.15:
                out.append(part(rnd.choice(["comments", "share", "aside"])))
            if bare:
                body = "".join(out)
                how = rnd.choice(["none", "none", "div", "named", "nested", "cell", "blocks"])
                made = "".join(rnd.choice(syllables) for _ in range(3))
                if how == "blocks":
                    return re.sub(r"</?p\b", lambda m: m[0][:-1] + "div", body)
                wrap = {"none": ("", ""), "div": ("<div>", "</div>"), "named": (f'<div class="{made}" id="{made[::-1]}">', "</div>"), "nested": ("<div><div>", "</div></div>"), "cell": ("<table><tr><td>", "</td></tr></table>")}
                return wrap[how][0] + body + wrap[how][1]
            tag = rnd.choice(["article", "article", "article", "main", "section", "div", "div"])
            mark = f' {rnd.choice(["class", "id"])}="{rnd.choice(CONTENT_NAMES)}"' if tag in ("div", "section") or rnd.random() < 0.3 else ""
            return f"<{tag}{mark}>{''.join(out)}</{tag}>"

        before = [part(k) for k in ("header", "nav", "notice", "form", "ad", "aside") if rnd.random() < 0.5]
        after = [part(k) for k in ("comments", "share", "aside", "ad", "notice", "form") if rnd.random() < 0.4] + [part("footer")] * (rnd.random() < 0.85)
        rnd.shuffle(before)
        yield f"<html><head><title>T</title></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>", labels


def labelled_blocks(pages: Iterable[tuple[str, dict[str, int]]]) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages with labels by text, as blocks with labels; blocks of unknown text are boilerplate."""
    listed = {w for name in (*CONTENT_NAMES, *(x for own in BOILERPLATE_NAMES.values() for x in own), "comment body reply") for w in _PART.findall(name)}
    for page, labels in pages:
        b = blocks(page, listed.__contains__)
        yield b, [labels.get(x.text, 0) for x in b]


@lru_cache(1)
def default_model() -> Crf:
    return train(labelled_blocks(chain(labelled_pages(), labelled_pages(300, 11, 1.0))))


def extract(page: str | None, model: Crf) -> str:
    """The content blocks' texts in page order, one a line."""
    b = blocks(page, model.knows)
    return "\n".join(x.text for x, y in zip(b, model.viterbi(b), strict=True) if y)


def main_text(df: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    src = C.pick(df, id_col, url_col, html_col)
    kind = _arrow_type(src, id_col)
    sent = src.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), sent.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return C.map_arrow(src, run, [C.id_field(src, id_col), C.field(url_col, "string"), C.field("text", "string"), C.field("n_chars", "long")])
