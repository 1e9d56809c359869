"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A leaf block is a run of text between block-level tags. Its features are the ancestor tags, the words
of their class and id attributes, and facts about its text and links; the chain's two labels are kept and
dropped. Weights come from labelled pages built here (layouts of articles, blogs, shops and
forums whose parts are known); Viterbi decodes a page.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import map_texts

# Fixed values of HTML: inline elements (formulas included) don't end a block; raw and void elements have no text of the
# page; embedded ones among the raw stand inside a line and don't end a block either.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split())
RAW = frozenset("script style noscript template iframe svg textarea title head select button canvas audio video noembed noframes annotation annotation-xml".split())
EMBEDDED = frozenset("script style noscript template iframe svg canvas audio video annotation annotation-xml".split())
OPAQUE = frozenset("script style textarea title noembed noframes iframe".split())
#: The head's own elements: any other, or text, ends an open head.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Features look at so many of the nearest ancestors, so that deep nesting costs linear time.
NEAR = 32

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|!\[CDATA\[(.*?)\]\]>|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
#: A tag up to the first ``>``, whatever its quotes; and a quoted value that runs on from a tag without end quote into others.
_PLAIN_TAG = re.compile(r"<((?!))?((?!))?(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RUNAWAY = re.compile(r"=\s*(?:\"[^\"<>]*>[^\"<]*<[/a-zA-Z]|'[^'<>]*>[^'<]*<[/a-zA-Z])")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    __slots__ = ("text", "tags", "names", "linked", "inline")

    def __init__(self, text: str, tags: tuple, names: tuple, linked: int, inline: frozenset):
        self.text, self.tags, self.names, self.linked, self.inline = text, tags, names, linked, inline


class _Open:
    """The open elements, with the places of each tag and of those that are not inline: no step walks the whole stack."""

    def __init__(self):
        self.stack: list[tuple[str, tuple]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.raw = self.links = 0

    def push(self, tag: str, names: tuple) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append((tag, names))
        self.raw += tag in RAW
        self.links += tag == "a"

    def cut(self, depth: int) -> None:
        """Closes everything from that place on."""
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.solid.pop()
            self.raw -= tag in RAW
            self.links -= tag == "a"

    def last(self, tag: str) -> int | None:
        return self.places[tag][-1] if self.places.get(tag) else None

    def leave_head(self) -> None:
        self.cut(self.places["head"][0])

    def end(self, enders: set) -> None:
        """Closes an element that the new one ends, if only inline elements and paragraphs are open inside it."""
        for place in reversed(self.solid):
            tag = self.stack[place][0]
            if tag in enders:
                self.cut(place)
            if tag in enders or tag != "p":
                return


def _next_tag(html: str, at: int, quoted: bool) -> re.Match | None:
    """The tag at this place; an attribute without its end quote doesn't swallow what follows the tag."""
    m = _TAG.match(html, at) if quoted or html[at + 1 : at + 2] in ("!", "?") else None
    if m is None or m[4] and m[5] and _RUNAWAY.search(m[5]):
        return _PLAIN_TAG.match(html, at) or m
    return m


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order: decoded, white space folded, blank ones left out."""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked = 0
    inline: set = set()

    def close_block() -> None:
        nonlocal parts, linked, inline
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                near = open_.stack[-NEAR:]
                tags = tuple(t for t, _ in near if t not in INLINE)
                names = tuple(n for _, ns in near for n in ns)
                out.append(Block(text, tags, names, linked, frozenset(inline)))
        parts, linked, inline = [], 0, set()

    at, lower, n, last = 0, None, len(html), html.rfind(">")
    quoted = True  # until a tag whose quotes never close: from there on a tag ends at the first >
    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            open_at = n
        if open_.raw and open_.stack[-1][0] == "head" and html[at:open_at].strip():
            open_.leave_head()
        if open_at > at and not open_.raw:
            text = unescape(html[at:open_at])
            parts.append(text)
            if open_.links:
                linked += len(text.strip())
        if open_at == n:
            break
        m = _next_tag(html, open_at, quoted) if open_at < last or html.startswith("<!--", open_at) else None
        if m and m.re is _PLAIN_TAG and quoted:
            quoted = _TAG.match(html, open_at) is not None
        if not m:
            if not open_.raw:
                parts.append("<")
            at = open_at + 1
            continue
        at = m.end()
        if m[2] and not open_.raw:
            parts.append(m[2])
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:  # closing
            if tag == "br" or tag == "p" and open_.last("p") is None:
                continue
            depth = open_.last(tag)
            if depth is None:
                continue
            if tag not in INLINE:
                if tag not in EMBEDDED and (not open_.raw or tag in RAW):
                    close_block()
            elif open_.solid and open_.solid[-1] >= depth:
                continue  # a stray inline end does not close blocks
            open_.cut(depth)
            continue
        if open_.raw and (open_.stack[-1][0] == "head" and tag not in HEAD or tag == "body" and open_.last("head") is not None):
            open_.leave_head()
        if tag in VOID:
            if tag not in INLINE and not open_.raw:
                if tag == "br":
                    parts.append(" ")
                else:
                    close_block()
            continue
        if tag not in INLINE and tag not in EMBEDDED and not open_.raw:
            close_block()
            open_.end(ENDS.get(tag, set()) | ({"p"} if tag in P_ENDERS else set()))
        elif tag in INLINE and not open_.raw:
            inline.add(tag)
        if m[5] and m[5].rstrip().endswith("/"):
            continue
        names: tuple = ()
        if m[5]:
            found = [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[5])]
            names = tuple(w for k, v in found if k in ("class", "id", "role") for w in _TOKEN.findall(v.lower()))
            if any(k == "hidden" or k == "style" and _HIDDEN.search(v) or k == "aria-hidden" and v == "true" for k, v in found):
                names += ("hidden",)
        open_.push(tag, names)
        if tag in OPAQUE:  # text up to the end tag, whatever it looks like
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else html
            end = lower.find("</" + tag, at)
            at = end if end >= 0 else n
    close_block()
    return out


# ---------------------------------------------------------------- features

BITS = 14
_KNOWN_SIGNS = re.compile("[©®|»›·]")


def _slot(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) & ((1 << BITS) - 1)


slot = lru_cache(maxsize=1 << 16)(_slot)


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def features(page: list[Block]) -> list[list[int]]:
    """Active feature slots of each block."""
    out = []
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        dense = int(4 * min(1.0, b.linked / max(1, len(b.text))))
        ends = b.text[-1] in ".!?…\"”»:;"
        f = ["bias", f"len{_bucket(words)}", f"link{dense}", f"link{dense}len{_bucket(words)}", f"ends{ends}len{_bucket(words)}", f"last:{b.tags[-1] if b.tags else ''}"]
        f += [f"tag:{t}" for t in set(b.tags)]
        f += [f"name:{w}" for w in set(b.names)]
        f += [f"inline:{t}" for t in b.inline]
        f += [f"sign:{c}" for c in set(_KNOWN_SIGNS.findall(b.text))]
        f += [f"pair:{a}>{c}" for a, c in zip(b.tags[-3:], b.tags[-2:], strict=False)]
        if k == 0:
            f.append("first")
        if k == len(page) - 1:
            f.append("final")
        out.append([slot(x) for x in f])
    return out


# ---------------------------------------------------------------- the chain


class Crf:
    """Two labels; ``emit`` has a weight for each slot and label, ``move`` one for each pair of labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(0) for f in page])

    def decode(self, page: list[list[int]]) -> list[int]:
        """Viterbi."""
        s = self.scores(page).tolist()
        move = self.move.tolist()
        best, back = s[0], []
        for now in s[1:]:
            step, row = [], []
            for y in (0, 1):
                a, b = best[0] + move[0][y], best[1] + move[1][y]
                row.append(int(b > a))
                step.append(max(a, b) + now[y])
            back.append(row)
            best = step
        y = int(best[1] > best[0])
        path = [y]
        for row in reversed(back):
            y = row[y]
            path.append(y)
        return path[::-1]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4) -> Crf:
    """Stochastic gradient (AdaGrad) on the conditional log-likelihood; expectations by forward-backward."""
    emit, move = np.zeros((1 << BITS, 2)), np.zeros((2, 2))
    g_emit, g_move = np.full(emit.shape, 1e-8), np.full(move.shape, 1e-8)
    model = Crf(emit, move)
    for _ in range(epochs):
        for page, truth in pages:
            s = model.scores(page)
            n = len(s)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for k in range(1, n):
                fwd[k] = s[k] + _lse(fwd[k - 1][:, None] + move, 0)
            for k in range(n - 2, -1, -1):
                bwd[k] = _lse(move + (s[k + 1] + bwd[k + 1])[None, :], 1)
            z = _lse(fwd[-1], 0)
            p = np.exp(fwd + bwd - z)
            dm = np.zeros((2, 2))
            for k in range(n - 1):
                dm -= np.exp(fwd[k][:, None] + move + (s[k + 1] + bwd[k + 1])[None, :] - z)
                dm[truth[k], truth[k + 1]] += 1
            g_move += dm * dm
            move += rate * dm / np.sqrt(g_move)
            for k, f in enumerate(page):
                d = -p[k]
                d[truth[k]] += 1
                d = d[None, :] - l2 * emit[f]
                g_emit[f] += d * d
                emit[f] += rate * d / np.sqrt(g_emit[f])
    return model


# ---------------------------------------------------------------- labelled pages

# Class and id words in the wild for each part of a page, as far as layouts here use them.
_DROPPED_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs pagination pager toc links topbar",
    "header": "header masthead banner top logo site branding",
    "footer": "footer bottom copyright colophon legal",
    "aside": "sidebar aside related widget recommended popular trending more",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion",
    "notice": "notice cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe signup",
    "comments": "comments comment respond replies discussion disqus reply",
    "share": "share social sharing follow toolbar buttons",
    "form": "search form login contact",
}
_KEPT_NAMES = "content article post entry main body story text page blog single hentry"


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, list[str]]]:
    """(html, kept texts) of ``n`` made pages; kept texts are distinct from the others'."""
    rng = np.random.Generator(np.random.PCG64(seed))
    syllables = "ba de ki lo mu ra se ti von zu an er qu el in os ther".split()

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b + 1)))

    def sentences(a: int, b: int) -> str:
        return " ".join(phrase(4, 18).capitalize() + str(rng.choice([".", ".", ".", "!", "?"])) for _ in range(rng.integers(a, b + 1)))

    def pick(text: str, p: float = 0.85) -> str:
        if rng.random() > p:
            return ""
        k = "class" if rng.random() < 0.75 else "id"
        return f' {k}="{rng.choice(text.split())}"'

    def links(a: int, b: int, sep: str = "") -> str:
        return sep.join(f'<a href="/{word()}">{phrase(1, 3)}</a>' for _ in range(rng.integers(a, b + 1)))

    def listed(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 4)}</a></li>' for _ in range(rng.integers(a, b + 1))) + "</ul>"

    stray = "b i em strong span small u".split()  # left open now and then

    def head() -> str:
        """A head with some of its usual elements, in any order, and scripts that may hold tags in strings."""
        code = lambda: f"{rng.choice(['var', 'let', 'const'])} {word()}={rng.choice([str(rng.integers(99)), repr(phrase(1, 3)), repr('<' + str(rng.choice(stray)) + '>' + word()), repr('</' + str(rng.choice(['div', 'li', 'span', 'p'])) + '>')])};"
        made = [f"<title>{phrase(2, 8)}</title>"]
        made += [f'<meta name="{word()}" content="{phrase(1, 5)}">' for _ in range(rng.integers(0, 4))]
        made += [f'<link rel="stylesheet" href="/{word()}.css">'] * int(rng.integers(0, 2))
        made += [f"<style>.{word()}{{{rng.choice(['color', 'width', 'padding'])}:{rng.integers(9)}}}</style>" for _ in range(rng.integers(0, 2))]
        made += [f"<script>{code()}</script>" for _ in range(rng.integers(0, 3))]
        rng.shuffle(made)
        return f"<head>{''.join(made)}" + ("</head>" if rng.random() < 0.9 else "")

    def dropped(kind: str) -> str:
        names = _DROPPED_NAMES[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag, attr = (tag, pick(names, 0.3)) if tag != "div" and rng.random() < 0.65 else ("div" if rng.random() < 0.8 else "section", pick(names, 1))
        if kind == "nav":
            inner = listed(2, 9) if rng.random() < 0.7 else links(2, 8, " | ")
        elif kind == "header":
            inner = f"<div>{phrase(1, 3)}</div>" + (f"<p>{phrase(2, 7)}</p>" if rng.random() < 0.5 else "") + (links(0, 4, " "))
        elif kind == "footer":
            inner = str(rng.choice(["&copy; ", "© 2021 ", "Copyright "])) + phrase(1, 3) + str(rng.choice([" &middot; ", " | ", ". "])) + (sentences(1, 3) if rng.random() < 0.6 else links(1, 5, " | "))
            inner = inner if rng.random() < 0.5 else f"<p>{inner}</p>" + (listed(2, 5) if rng.random() < 0.5 else "")
        elif kind == "aside":
            inner = f"<h3>{phrase(1, 3)}</h3>" + (listed(2, 6) if rng.random() < 0.6 else f"<p>{sentences(1, 3)}</p>")
        elif kind == "comments":
            inner = f"<h3>{phrase(1, 2)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "author", "item"])}"><b>{word()}</b><p>{sentences(1, 4)}</p></div>' for _ in range(rng.integers(1, 5)))
        elif kind == "form":
            inner = f"<label>{phrase(1, 2)}</label><input><button>{word()}</button>" + (f"<p>{phrase(3, 9)}</p>" if rng.random() < 0.5 else "")
        elif kind == "share":
            inner = links(2, 5, " ")
        else:
            inner = sentences(1, 3) if rng.random() < 0.6 else f"<p>{sentences(1, 2)}</p>" + links(0, 2, " ")
        return f"<{tag}{attr}>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        kept: list[str] = []

        def keep(text: str, kept: list[str] = kept) -> str:
            kept.append(_SPACE.sub(" ", unescape(re.sub(r"<[^>]*>", "", text))).strip())
            return text

        body = []
        if rng.random() < 0.85:
            body.append(f"<h1>{keep(phrase(2, 10))}</h1>")
        for _ in range(rng.integers(1, 9)):
            kind = rng.random()
            if kind < 0.66:
                t = sentences(1, 7)
                if rng.random() < 0.3:
                    w = t.split(" ")
                    j = int(rng.integers(0, len(w)))
                    w[j] = f"<{(g := str(rng.choice(['b', 'i', 'em', 'strong', 'span'])))}>{w[j]}</{g}>" if rng.random() < 0.6 else f'<a href="/{word()}">{w[j]}</a>'
                    t = " ".join(w)
                opened = f"<p>{f'<{rng.choice(stray)}>' if rng.random() < 0.15 else ''}" if rng.random() < 0.93 else f"<div{pick('para block text lead', 0.3)}>"
                body.append(opened + keep(t) + ("</div>" if opened[1] == "d" else str(rng.choice(["</p>", "</p>", "</p>", "<br>", "<br/>", ""]))))
            elif kind < 0.78:
                body.append(f"<h{rng.integers(2, 4)}>{keep(phrase(1, 6))}</h2>".replace("</h2>", "") if rng.random() < 0.05 else f"<h2>{keep(phrase(1, 6))}</h2>")
            elif kind < 0.9:
                tag = str(rng.choice(["ul", "ol"]))
                body.append(f"<{tag}>" + "".join(f"<li>{keep(phrase(2, 14))}</li>" for _ in range(rng.integers(2, 5))) + f"</{tag}>")
            elif kind < 0.95:
                body.append(f"<blockquote>{keep(sentences(1, 2))}</blockquote>")
            else:
                body.append("<table><tr>" + "".join(f"<td>{keep(phrase(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
            if rng.random() < 0.06:
                body.append(dropped(str(rng.choice(["ad", "aside", "share"]))))
        tag = str(rng.choice(["article", "article", "main", "div", "section"]))
        article = f"<{tag}{pick(_KEPT_NAMES, 1 if tag in ('div', 'section') else 0.3)}>{''.join(body)}</{tag}>"
        if rng.random() < 0.4:
            article = f"<div{pick(_KEPT_NAMES + ' wrapper container row', 0.8)}>{article}</div>"
        before = [dropped(k) for k in ("header", "nav", "notice", "ad", "form", "share") if rng.random() < (0.35 if k in ("notice", "form", "share") else 0.6)]
        after = [dropped(k) for k in ("share", "comments", "aside", "ad", "notice", "form", "footer") if rng.random() < (0.75 if k == "footer" else 0.35)]
        html = f"<!DOCTYPE html><html{pick('no js page home', 0.2)}>{head()}<body{pick('page home single post', 0.2)}>" + "".join(before) + article + "".join(after)
        pages.append((html + ("</body></html>" if rng.random() < 0.9 else ""), kept))
    return pages


@lru_cache(maxsize=1)
def trained(n: int = 240) -> Crf:
    """The model of this module's labelled pages (the same on every machine)."""
    data = []
    for html, kept in labelled_pages(n):
        page, left = blocks(html), list(kept)
        truth = []
        for b in page:
            truth.append(int(b.text in left))
            if truth[-1]:
                left.remove(b.text)
        if page:
            data.append((features(page), truth))
    return fit(data)


def extract(html: str | None, model: Crf) -> str:
    page = blocks(html or "")
    if not page:
        return ""
    return "\n\n".join(b.text for b, y in zip(page, model.decode(features(page)), strict=True) if y)


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` plus text (kept blocks in page order, two line feeds between) and n_chars (its code points).

    One row for each input row, repeated rows and ids included. A null, empty or textless page gives the empty text;
    long and deeply nested pages are read whole, in linear time. Of equal paths the one that drops wins. Kept columns
    named like an output (in any case) give way to it.
    """
    model = trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.emit, model.move))  # 2**BITS rows: a fixed size

    def make():
        crf = Crf(*shared.value)

        def fn(texts: pa.Array) -> list:
            found = [extract(t, crf) for t in texts.to_pylist()]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return fn

    return map_texts(pages, make, [("text", "string"), ("n_chars", "bigint")], keep, html_col)
