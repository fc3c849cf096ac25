"""Main-text extraction: a recurrent labeller over the leaf blocks of a page.

A tolerant parser cuts a page into leaf blocks: runs of text between block-level tags, each with its tag path (tags,
class, id and role words). Every block becomes a vector of hashed path words, hashed text words and a few measures;
a bidirectional LSTM in numpy reads all blocks of a page and classifies each with the whole page as context. Blocks
called content are joined by blank lines.

The labeller is trained here, on the driver, from pages that a seeded generator writes in many layouts (with what must
go: menus, headers, footers, sidebars, notices, adverts, forms, comments, link lists); the same text styles stand in
content and around it, so that the labeller learns structure. Its size is fixed; it is broadcast.

Defined cases: null html is the empty page and gives the empty text; text outside of any tag is a block; unclosed tags
end where HTML ends them, comments, scripts, styles, templates, drawings and what stands for scripts are never text; a
quote in a tag that nothing closes ends with the tag; white space is collapsed inside a block,
character references are decoded; repeated rows stay repeated; an empty table gives an empty result; other columns are
not looked at. Pages are read whole, whatever their length.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORDS, MEASURES, HIDDEN = 512, 48, 9, 20
PAGES, EPOCHS, RATE, SEED, KEPT, AT_ONCE = 1200, 9, 0.01, 5, 200_000, 16_000

#: Fixed values of the HTML standard: tags without content, tags inside text, tags whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style textarea iframe noembed noframes noscript template svg".split())
#: An opening tag closes these open ones, up to the nearest of the second group.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Comments and their like, or a tag. An attribute's value is quoted, or goes on to white space or the tag's end and may
#: hold quotes; a quote that nothing closes ends with the tag.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?>"[^"]*"|'[^']*'|["'][^>]*|[^\s>"'][^\s>]*|(?=>)|\Z))?+|=)*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    path: np.ndarray
    tag: str
    depth: int
    linked: float


def _slot(word: str, size: int) -> int:
    return crc32(word.encode()) % size


@lru_cache(maxsize=50_000)
def _slots(word: str) -> list[int]:
    """Three places for each path word, so that a strange word seldom looks like a known one."""
    return [_slot(f"{i} {word}", PATH) for i in range(3)]


def _words_of(attributes: str) -> list[str]:
    out = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        for part in _PARTS.findall(max(values, key=len)):
            out.append(part.lower())
        if kind.lower() == "role":
            out.append("role " + max(values, key=len).lower())
    return out


def _element_end(page: str, tag: str, at: int) -> tuple[int, int]:
    """Start and end of the closing tag of an element whose content is no text; elements of one name may be nested."""
    depth, nested = 1, tag not in RAW
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1 if nested and not m[0].endswith("/>") else 0
        if not depth:
            return m.start(), m.end()
    return len(page), len(page)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    page, found = page or "", []
    empty = np.zeros(PATH, np.float32)
    stack: list[tuple[str, np.ndarray]] = []
    text: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                joined = " ".join(words)
                path, tag = (stack[-1][1], stack[-1][0]) if stack else (empty, "")
                found.append(Block(joined, path, tag, len(stack), min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece)

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            add(" ")
        elif tag in INLINE:
            in_link = in_link if tag != "a" else int(not m[1])
        elif m[1]:
            flush()
            in_link = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            flush()
            in_link = 0
            closes, up_to = IMPLIED.get(tag, ((), ()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in up_to or (tag not in IMPLIED and stack[i][0] != "p"):
                    break
                if stack[i][0] in closes or stack[i][0] == "p":
                    del stack[i:]
            if tag in VOID:
                continue
            path = (stack[-1][1] if stack else empty).copy()
            path[_slots(tag)] = 1
            for word in _words_of(m[3]) if m[3] else ():
                path[_slots("name " + word)] = 1
            stack.append((tag, path))
            if tag in DROPPED or tag in RAW:
                if tag == "svg" and m[3].rstrip().endswith("/"):
                    stack.pop()
                    continue
                start, stop = _element_end(page, tag, at)
                if tag not in DROPPED:
                    add(page[at:start])
                    flush()
                at = stop
                stack.pop()
    tail = page[at:]
    cut = re.search(r"<[a-zA-Z/!?]", tail)
    add(tail[: cut.start()] if cut else tail)
    flush()
    return found


class Vectors:
    """Blocks to rows of the network's input; hashed words are kept in a bounded table."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}

    def __call__(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), PATH + WORDS + MEASURES), np.float32)
        n = max(1, len(page))
        if len(self.slots) > KEPT:
            self.slots.clear()
        slots = self.slots
        for i, b in enumerate(page):
            words = b.text.split(" ")
            for w in set(words).difference(slots):
                slots[w] = _slot(w.lower(), WORDS)
            out[i, :PATH] = b.path
            own = np.fromiter((slots[w] for w in words), np.int64, len(words))
            out[i, PATH : PATH + WORDS] = np.bincount(own, minlength=WORDS) * (0.5 / len(words))
            size = len(b.text)
            out[i, PATH + WORDS :] = (
                np.log1p(size) / 6, np.log1p(len(words)) / 5, b.linked, b.text[-1] in ".!?:;\"'", b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(),
                b.depth / 8 if b.depth < 32 else 4, i / n, 1 - (i + 1) / n,
            )
        return out


class BiLSTM:
    """A bidirectional LSTM with a logistic output for each step. Sequences are padded at their ends."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, size**-0.5, (size, 4 * hidden)).astype(np.float32)
            self.p["h" + side] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p["c" + side] = bias
        self.p["o"] = rng.normal(0, (2 * hidden) ** -0.5, 2 * hidden).astype(np.float32)
        self.p["e"] = np.zeros(1, np.float32)

    @staticmethod
    def _flip(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Row of time indices for each sequence that turns it round and leaves its padding."""
        t = np.arange(steps)[None, :]
        return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        h = self.h
        given = x @ self.p["x" + side] + self.p["c" + side]
        out = np.zeros((n, steps, h), np.float32)
        state = cell = np.zeros((n, h), np.float32)
        for t in range(steps):
            z = given[:, t] + state @ self.p["h" + side]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, cell = (state, cell), f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, t] = state
            if keep is not None:
                keep.append((i, f, o, g, before, squashed))
        return out

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits (sequences, steps)."""
        flip = self._flip(lengths, x.shape[1])
        rows = np.arange(len(x))[:, None]
        steps: dict[str, list | None] = {"f": None if keep is None else [], "b": None if keep is None else []}
        turned = x[rows, flip]
        hf = self._run(x, "f", steps["f"])
        hb = self._run(turned, "b", steps["b"])[rows, flip]
        both = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep.update(steps=steps, both=both, flip=flip, rows=rows, turned=turned)
        return both @ self.p["o"] + self.p["e"][0]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        logits = self.forward(x, lengths, keep)
        real = np.arange(x.shape[1])[None, :] < lengths[:, None]
        d = np.where(real, 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y, 0).astype(np.float32) / real.sum()
        g = {"o": np.einsum("nt,nth->h", d, keep["both"]), "e": np.array([d.sum()], np.float32)}
        dboth = d[:, :, None] * self.p["o"]
        h, rows, flip = self.h, keep["rows"], keep["flip"]
        for side, given, dh in (("f", x, dboth[:, :, :h]), ("b", keep["turned"], dboth[:, :, h:][rows, flip])):
            w = self.p["h" + side]
            dz_all = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
            dw = np.zeros_like(w)
            dstate = np.zeros((len(x), h), np.float32)
            dcell = np.zeros_like(dstate)
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, gg, (state, cell), squashed = keep["steps"][side][t]
                ds = dh[:, t] + dstate
                dcell = dcell + ds * o * (1 - squashed**2)
                dz = np.concatenate(
                    [dcell * gg * i * (1 - i), dcell * cell * f * (1 - f), ds * squashed * o * (1 - o), dcell * i * (1 - gg**2)], axis=1
                )
                dz_all[:, t] = dz
                dw += state.T @ dz
                dstate, dcell = dz @ w.T, dcell * f
            g["h" + side] = dw
            g["x" + side] = np.tensordot(given, dz_all, ([0, 1], [0, 1]))
            g["c" + side] = dz_all.sum(axis=(0, 1))
        return g

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Content probability of every block; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group, cells = [], 0
            while at < len(order) and (not group or (len(group) < 128 and cells + len(pages[order[at]]) < 20_000)):
                group.append(order[at])
                cells += len(pages[order[at]])
                at += 1
            x, lengths = padded([pages[i] for i in group])
            p = 1 / (1 + np.exp(-np.clip(self.forward(x, lengths), -30, 30)))
            for row, i in enumerate(group):
                out[i] = p[row, : lengths[row]]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x, lengths


# -- training pages --------------------------------------------------------------------------------------------------


class PageWriter:
    """Writes pages in random layouts and knows which of their blocks are content."""

    #: Names that sites give to what isn't the article.
    NOISE = {
        "nav": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager toc",
        "header": "header masthead banner topbar branding site-header logo toolbar",
        "footer": "footer site-footer copyright legal colophon bottom imprint",
        "aside": "sidebar side widget related recommended popular trending rail secondary tags archive author-box",
        "notice": "cookie cookie-notice notice consent alert popup modal gdpr message disclaimer paywall",
        "ad": "ad ads advert advertisement sponsored promo banner-ad adbox commercial teaser-ad",
        "form": "form newsletter subscribe search searchbox login signup contact-form poll survey",
        "comments": "comments comment-list responses discussion replies comment reader-comments disqus reviews",
        "share": "share social sharing buttons follow share-bar print-tools",
    }
    MAIN = "content main article post entry story text body article-body post-content entry-content page-content".split()
    #: What stands in such places; half of their text is of the same kind as the article's.
    SAY = (
        "Home|About|Contact|Privacy|Terms of use|Log in|Sign up|Subscribe|Search|Read more|Next|Previous|Share|Tweet|Reply|"
        "We use cookies to improve your experience.|Accept|All rights reserved.|© 2023|Advertisement|Sponsored|Related articles|"
        "Leave a comment|Your email|Send|Menu|Datenschutz|Impressum|Kontakt|Mentions légales|Accueil|Inicio|Aviso legal|Buscar"
    ).split("|")

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.sounds = [c + v for c in "b c d f g h j l m n p r s t v z th sh ch qu st".split() for v in "a e i o u ou ie é ü ñ".split()]

    def word(self) -> str:
        return "".join(self.r.choices(self.sounds, k=self.r.randrange(1, 4)))

    def prose(self, low: int, high: int) -> str:
        r = self.r
        words = [self.word() for _ in range(r.randrange(low, high))]
        style = r.random()
        if style < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.2:
            words = [w + r.choice(["***", "%%%", "###", "$$$", "&&&"]) for w in words]
        elif style < 0.28:
            words = [x for w in words for x in (w, "|")]
        elif style < 0.34:
            words = words[:3] * (len(words) // 3 + 1)
        else:
            words = [w.capitalize() if r.random() < 0.15 else w + r.choice(["", "", "", "", ",", "."]) for w in words]
        if r.random() < 0.12:  # what boilerplate says can stand in an article too
            words.insert(r.randrange(len(words) + 1), r.choice([*self.SAY, "©", "©"]))
        words[0] = words[0].capitalize()
        return " ".join(words) + r.choice(["", ".", "."])

    def text(self, content: bool, s: str) -> str:
        s = " ".join(s.split())
        self.kept.append(s) if content else self.gone.add(s)
        return html.escape(s)

    def attribute(self, names: str | list[str], p: float = 0.8) -> str:
        r, names = self.r, names.split() if isinstance(names, str) else names
        if r.random() > p:
            return ""
        name = r.choice(names)
        name = r.choice([name, name, name + "-" + r.choice(["box", "wrap", "1", "top", "inner", "list"]), r.choice(["site-", "page-", "js-", "c-"]) + name])
        return r.choice([f' class="{name}"', f' class="{name}"', f' id="{name}"', f" class='{name} {self.word()}'", f" class={name}"])

    def around(self, kind: str, inside: bool = False) -> str:
        """A part that isn't content."""
        r = self.r
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = plain if plain and r.random() < 0.65 else r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        named = 1.0 if tag != plain or inside else 0.4
        say = lambda low=1, high=12: self.text(False, r.choice(self.SAY) if r.random() < 0.5 else self.prose(low, high))
        link = lambda: f'<a href="/{self.word()}">{say(1, 4)}</a>'
        parts = []
        for _ in range(r.randrange(1, 3)):
            kinds = {
                "nav": ["list", "links"], "header": ["title", "links", "line"], "footer": ["line", "links", "line"], "aside": ["list", "para", "head", "links"],
                "notice": ["line", "para", "button"], "ad": ["line", "para", "links"], "form": ["input", "button", "line"], "comments": ["comment", "comment", "head"],
                "share": ["list", "links"],
            }[kind]
            what = r.choice(kinds)
            if what == "list":
                items = "".join(f"<li>{link() if r.random() < 0.85 else say(1, 4)}" + ("</li>" if r.random() < 0.9 else "") for _ in range(r.randrange(2, 9)))
                parts.append(items if tag == "ul" else f"<ul>{items}</ul>")
            elif what == "links":
                parts.append(" ".join(link() for _ in range(r.randrange(1, 7))))
            elif what == "title":
                parts.append(f"<h1>{say(1, 5)}</h1>")
            elif what == "head":
                parts.append(f"<h{(k := r.randrange(2, 5))}>{say(1, 5)}</h{k}>")
            elif what == "line":
                parts.append(say(1, 14) if r.random() < 0.6 else f"<p>{say(1, 14)}</p>")
            elif what == "para":
                parts.append(f"<p>{say(5, 60)}</p>")
            elif what == "button":
                parts.append(f"{say(4, 20)} <button>{say(1, 3)}</button>")
            elif what == "input":
                parts.append(f"<label>{say(1, 5)}</label><input type=text><button>{say(1, 3)}</button>")
            else:
                for _ in range(r.randrange(1, 5)):
                    parts.append(f'<div{self.attribute("comment reply")}><p>{say(3, 50)}</p></div>')
        return f"<{tag}{self.attribute(self.NOISE[kind], named)}>{''.join(parts)}</{tag}>"

    def article(self) -> str:
        r, out = self.r, []
        style = r.random()
        if r.random() < 0.85:
            h = r.choice(["h1", "h1", "h2"])
            out.append(f"<{h}>{self.text(True, self.prose(2, 14))}</{h}>")
        n = r.choice([1, 1, 2, 3, 4, 6, 9, 14])
        for i in range(n):
            low, high = r.choice([(1, 8), (6, 40), (30, 140)])
            s = self.text(True, self.prose(low, high))
            kind = r.random()
            if kind < 0.08:
                out.append(f"<h{(k := r.randrange(2, 5))}>{s}</h{k}>")
            elif kind < 0.14:
                out.append(f"<ul>{''.join(f'<li>{self.text(True, self.prose(1, 15))}</li>' for _ in range(r.randrange(1, 5)))}<li>{s}</li></ul>".replace(f"<li>{s}</li>", "", 1) + f"<p>{s}</p>")
            elif kind < 0.18:
                out.append(f"<blockquote>{s}</blockquote>")
            elif kind < 0.22:
                out.append(f"<div>{s}</div>")
            elif kind < 0.25:
                cells = [self.text(True, self.prose(1, 6)) for _ in range(2 * r.randrange(1, 4))]
                tags = [r.choice(["td", "td", "th"]) for _ in cells]
                body = "".join(("<tr>" if i % 2 == 0 else "") + f"<{t}>{c}" + r.choice(["", f"</{t}>"]) for i, (t, c) in enumerate(zip(tags, cells, strict=True)))
                out.append(f"<p>{s}</p><table>{r.choice(['', '<tbody>'])}{body}</table>")
            elif kind < 0.28:
                out.append(f"<p>{s}</p><figure><img src=x><figcaption>{self.text(True, self.prose(2, 15))}</figcaption></figure>")
            elif kind < 0.3:
                out.append(r.choice(["<pre>{}</pre>", "<pre><code>{}</code></pre>"]).format(s))
            elif kind < 0.32:
                items = "".join(f"<dt>{self.text(True, self.prose(1, 4))}<dd>{self.text(True, self.prose(2, 15))}" for _ in range(r.randrange(1, 4)))
                out.append(f"<p>{s}</p><dl>{items}</dl>")
            elif style < 0.3 and i == 0:
                out.append(f"<p><b>{s}<br>")
            elif style < 0.3:
                out.append(f"<p>{s}" + r.choice(["", "</p>"]))
            else:
                out.append(f"<p{self.attribute([self.word(), r.choice("abcdefghijklmnopqrstuvwxyz")], 0.3)}>{s}</p>")
            if r.random() < 0.06:
                out.append(self.around(r.choice(["ad", "aside", "notice", "form", "share"]), True))
        if r.random() < 0.12:
            out.append(self.around(r.choice(["comments", "share", "footer"]), True))
        return "".join(out)

    def page(self) -> tuple[str, list[int]]:
        """A page and the label of each of its leaf blocks."""
        r = self.r
        self.kept: list[str] = []
        self.gone: set[str] = set()
        title = self.text(False, self.prose(1, 10))
        before = [self.around(k) for k in ("nav", "header", "notice", "ad", "aside", "form") if r.random() < 0.4]
        after = [self.around(k) for k in ("comments", "share", "aside", "ad", "form", "nav", "notice") if r.random() < 0.25]
        after += [self.around("footer")] if r.random() < 0.75 else []
        if r.random() < 0.4:
            before = [self.around("nav"), "<!-- x -->" + self.around("ad")]
        r.shuffle(before)
        body = self.article() if r.random() < 0.97 else ""
        holder = r.random()
        if holder < 0.5:
            body = f"<article{self.attribute(self.MAIN, 0.3)}>{body}</article>"
        elif holder < 0.7:
            body = f"<main{self.attribute(self.MAIN, 0.3)}>{body}</main>"
        elif holder < 0.95:
            body = f"<div{self.attribute(self.MAIN, 1.0)}>{body}</div>"
        if r.random() < 0.3:
            body = f"<div{self.attribute('wrapper container page row col layout', 0.8)}>{body}</div>"
        head = f'<head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        whole = f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(before)}{body}{"".join(after)}' + r.choice(["</body></html>", "</body></html>", ""])
        kept = set(self.kept) - self.gone
        return whole, [int(b.text in kept) for b in blocks(whole)]


@cache
def trained(seed: int = SEED) -> BiLSTM:
    """The labeller, trained once in a process."""
    writer, vectors = PageWriter(seed), Vectors()
    pages = []
    while len(pages) < PAGES:
        page, labels = writer.page()
        if 0 < len(labels) <= 60:
            pages.append((vectors(blocks(page)), np.array(labels, np.float32)))
    net, rng = BiLSTM(PATH + WORDS + MEASURES), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][1]) + rng.random() * 8)
        groups = [order[i : i + 24] for i in range(0, len(order), 24)]
        rng.shuffle(groups)
        for group in groups:
            x, lengths = padded([pages[i][0] for i in group])
            # unseen names: at times a path word is dropped
            x[:, :, :PATH] *= rng.random((len(x), 1, PATH)) > 0.05
            # and structure must do without words: they are dropped for half of the pages
            x[:, :, PATH : PATH + WORDS] *= rng.random((len(x), 1, 1)) > 0.5
            y = np.zeros(x.shape[:2], np.float32)
            for row, i in enumerate(group):
                y[row, : lengths[row]] = pages[i][1]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
            for k, g in net.gradients(x, lengths, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def main_texts(pages: Iterable, net: BiLSTM, vectors: Vectors) -> list[str]:
    """Main text of each page (strings or Arrow strings); blocks of about ``AT_ONCE`` are labelled together."""
    out: list[str] = []
    held: list[list[Block]] = []

    def label() -> None:
        shares = net.probabilities([vectors(b) for b in held])
        out.extend("\n\n".join(b.text for b, s in zip(bs, ss, strict=True) if s >= 0.5) for bs, ss in zip(held, shares, strict=True))
        held.clear()

    for page in pages:
        held.append(blocks(page.as_py() if isinstance(page, pa.Scalar) else page))
        if sum(map(len, held)) >= AT_ONCE:
            label()
    label()
    return out


def extract(pages: DataFrame, net: BiLSTM | None = None) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(net or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(2), shared.value, vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
