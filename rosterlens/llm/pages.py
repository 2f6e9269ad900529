"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

Each block is article or not.  Its potentials come from the tags and names above it and from its text, those
of neighbours from their labels; Viterbi finds the best labelling of a page, and the article blocks make up
its text.

The field is trained on labelled pages.  Nobody has labelled the given ones, so pages are composed from a
library of layouts in which the label of every block is known (articles in different containers; menus,
headers, footers, sidebars, notices, adverts, forms and comments in different places under different names),
with texts from a sample of the given pages, of a fixed size.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns
from .dom import Leaf, leaves

#: Pages that give texts for training: those of the lowest hash of page_id.
TRAIN_PAGES, LAYOUTS = 150, 600

#: Parts of class, id and role names, by what they tell.
GROUPS = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp commercial",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs sitemap skip toolbar",
    "head": "header masthead head topbar top logo brand branding hero",
    "foot": "footer foot copyright bottom colophon legal imprint",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending teaser teasers rail more links complementary",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay dialog message warning announcement disclaimer privacy toast",
    "comments": "comment comments reply replies discussion disqus respond thread reader feedback reviews",
    "form": "form subscribe subscription newsletter signup login search register contact input field",
    "share": "share sharing social follow twitter facebook print tags tag meta byline author date",
    "content": "content article post entry story text prose body main page copy blog news primary",
}
PART_OF = {f".{w}": g for g, words in GROUPS.items() for w in words.split()}
ABOVE = "article main section nav header footer aside form ul ol table figure blockquote address dl div menu details fieldset dialog".split()
OWN = "p div h1 h2 h3 h4 h5 h6 li td th pre blockquote figcaption dd dt section article body footer header aside nav legend summary".split()
SIZES = (2, 4, 8, 15, 30, 60)
LINKED = (0.01, 0.3, 0.7, 0.95)
CHECKS = (
    ("sentence", re.compile(r"[.!?…][\"'”»)]*$")),
    ("several sentences", re.compile(r"[.!?] +[^\W\d_]")),
    ("comma", re.compile(",")),
    ("copyright", re.compile(r"©|\(c\)|copyright|rights reserved", re.I)),
    ("cookies", re.compile(r"cookie|consent|privacy", re.I)),
    ("offer", re.compile(r"subscribe|newsletter|sign ?up|log ?in|register|advert|sponsored|buy now|click here", re.I)),
    ("reply", re.compile(r"\breply\b|\bcomments?\b|\bago\b|\bposted by\b", re.I)),
    ("bar", re.compile(r" [|»›·] ")),
)
NAMES = (
    ["always", "first", "last"]
    + [f"in {t}" for t in ABOVE]
    + [f"is {t}" for t in OWN]
    + [f"named {g}" for g in GROUPS]
    + [f"words {i}" for i in range(len(SIZES) + 1)]
    + [f"linked {i}" for i in range(len(LINKED) + 1)]
    + [n for n, _ in CHECKS]
    + ["heading before text", "list in content", "unnamed"]
)
INDEX = {n: i for i, n in enumerate(NAMES)}


def facts(page: list[Leaf]) -> list[list[int]]:
    """Numbers of the features that hold, for each block."""
    out = []
    for i, leaf in enumerate(page):
        found = {0}
        if i == 0:
            found.add(1)
        if i == len(page) - 1:
            found.add(2)
        groups = set()
        for a in leaf.around:
            k = INDEX.get("in " + a[1:]) if a[0] == "^" else None
            if k is not None:
                found.add(k)
            g = PART_OF.get(a)
            if g:
                groups.add(g)
                found.add(INDEX["named " + g])
        k = INDEX.get("is " + leaf.tag)
        if k is not None:
            found.add(k)
        n = leaf.text.count(" ") + 1
        found.add(INDEX[f"words {sum(n > s for s in SIZES)}"])
        found.add(INDEX[f"linked {sum(leaf.linked > s for s in LINKED)}"])
        found.update(INDEX[name] for name, test in CHECKS if test.search(leaf.text))
        if leaf.tag[:1] == "h" and i + 1 < len(page) and page[i + 1].tag == "p":
            found.add(INDEX["heading before text"])
        if leaf.tag == "li" and leaf.linked < 0.5 and not groups - {"content"}:
            found.add(INDEX["list in content"])
        if not groups:
            found.add(INDEX["unnamed"])
        out.append(sorted(found))
    return out


@dataclass(frozen=True)
class Chain:
    """Weights of features by label, of labels side by side, and of the first label.  Label 1 is article."""

    node: np.ndarray
    pair: np.ndarray
    start: np.ndarray

    def decode(self, found: list[list[int]]) -> list[int]:
        """The best labelling of a page's blocks."""
        if not found:
            return []
        scores = np.array([self.node[f].sum(axis=0) for f in found]).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = (s + t for s, t in zip(scores[0], self.start.tolist()))
        back = []
        for x, y in scores[1:]:
            back.append((int(b + p10 > a + p00), int(b + p11 > a + p01)))
            a, b = x + max(a + p00, b + p10), y + max(a + p01, b + p11)
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], steps: int = 300, penalty: float = 0.3) -> Chain:
    """Maximise the likelihood of the labels, by forward-backward over all pages side by side."""
    pages = [(f, y) for f, y in pages if f]
    n, most = len(pages), max((len(f) for f, _ in pages), default=0)
    node, pair, start = np.zeros((len(NAMES), 2)), np.zeros((2, 2)), np.zeros(2)
    if not n:
        return Chain(node, pair, start)
    x = np.zeros((n, most, len(NAMES)), dtype=np.float32)
    y = np.zeros((n, most), dtype=np.int64)
    size = np.array([len(f) for f, _ in pages])
    for i, (f, labels) in enumerate(pages):
        for k, on in enumerate(f):
            x[i, k, on] = 1
        y[i, : len(labels)] = labels
    real = np.arange(most) < size[:, None]
    gold = np.eye(2)[y] * real[:, :, None]
    gold_pair = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    speed = [np.full_like(v, 1e-6) for v in (node, pair, start)]
    for _ in range(steps):
        own = (x @ node) * real[:, :, None]
        ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        ahead[:, 0] = own[:, 0] + start
        for t in range(1, most):
            come = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pair, axis=1) + own[:, t]
            ahead[:, t] = np.where(real[:, t, None], come, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            go = np.logaddexp.reduce(pair + (own[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], go, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        both = ahead[:, :-1, :, None] + pair + (own[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        p_pair = (np.exp(np.minimum(both, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
        gap = gold - p
        steep = [np.einsum("ntf,nti->fi", x, gap) - penalty * node, gold_pair - p_pair - penalty * pair, gap[:, 0].sum(axis=0) - penalty * start]
        for v, s, g in zip((node, pair, start), speed, steep):
            g = g / n
            s += g * g
            v += 0.5 * g / np.sqrt(s)
    return Chain(node, pair, start)


class Layouts:
    """Pages with known labels.  Article texts carry a mark at their end, which is taken off after parsing."""

    MARK = "\ue000"  # a private character

    def __init__(self, texts: list[str], short: list[str], seed: int = 11):
        self.r = random.Random(seed)
        self.texts = texts or ["A text of some words, as pages have it. And one more sentence follows."]
        self.short = short or ["some words"]

    def words(self, low: int, high: int) -> str:
        """A text of about so many words; sentences may be cut short."""
        want, got = self.r.randint(low, high), []
        while len(got) < want:
            got += self.r.choice(self.texts).split()
        text = " ".join(got[:want])
        return html.escape(text if self.r.random() < 0.3 else text.rstrip(".,;:") + ".", quote=False)

    def link(self, words: int = 3) -> str:
        text = self.r.choice(self.short) if self.r.random() < 0.5 else self.words(1, words)
        return f'<a href="/{self.r.randint(1, 999)}">{html.escape(text, quote=False)}</a>'

    def named(self, tag: str, *names: str, chance: float = 0.85) -> tuple[str, str]:
        """Start and end of an element, mostly with one of the names."""
        if self.r.random() > chance:
            return f"<{tag}>", f"</{tag}>"
        kind = self.r.choice(("class", "class", "id"))
        more = self.r.choice(("", "", " box", " wide", " row-2"))
        return f'<{tag} {kind}="{self.r.choice(names)}{more if kind == "class" else ""}">', f"</{tag}>"

    def pick(self, *options):
        return self.r.choice(options)()

    def wrap(self, inner: str, tag: str, *names: str, chance: float = 0.9) -> str:
        a, b = self.named(tag, *names, chance=chance)
        return a + inner + b

    def menu(self) -> str:
        items = [self.link() for _ in range(self.r.randint(3, 9))]
        listed = self.pick(
            lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>",
            lambda: " | ".join(items),
            lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>",
        )
        if self.r.random() < 0.5:
            return self.wrap(listed, "nav", "nav", "main-menu", "breadcrumb", chance=0.4)
        return self.wrap(listed, self.r.choice(("div", "div", "section")), "menu", "navigation", "navbar", "breadcrumbs", "nav-top", chance=1)

    def header(self) -> str:
        inner = self.pick(lambda: self.link(2), lambda: f"<h1>{self.words(1, 4)}</h1>", lambda: f"<div>{self.words(1, 4)}</div><p>{self.words(3, 9)}</p>", lambda: self.words(2, 8))
        inner += self.menu() if self.r.random() < 0.4 else ""
        return self.wrap(inner, "header", "site-header", "top", chance=0.5) if self.r.random() < 0.6 else self.wrap(inner, "div", "header", "masthead", "topbar", "site-header", chance=1)

    def footer(self) -> str:
        inner = self.pick(
            lambda: f"&copy; {self.r.randint(1999, 2030)} {self.words(1, 12)}",
            lambda: f"&copy; {self.link(2)} &middot; {self.words(4, 20)}",
            lambda: f"<p>{self.words(4, 25)}</p><p>Copyright {self.words(1, 4)} All rights reserved.</p>",
            lambda: self.menu() + f"<p>{self.words(3, 12)}</p>",
            lambda: self.words(2, 14),
        )
        return self.wrap(inner, "footer", "footer", "site-footer", chance=0.4) if self.r.random() < 0.6 else self.wrap(inner, "div", "footer", "copyright", "page-footer", "bottom", chance=1)

    def advert(self) -> str:
        inner = self.pick(lambda: self.words(3, 40), lambda: self.link(8), lambda: f"<p>{self.words(3, 30)}</p>", lambda: f"<h3>{self.words(1, 5)}</h3><p>{self.words(4, 25)}</p>{self.link(2)}")
        return self.wrap(inner, self.r.choice(("div", "div", "aside", "section")), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "banner", chance=1)

    def notice(self) -> str:
        inner = self.pick(lambda: self.words(4, 35), lambda: f"<p>{self.words(4, 35)}</p><button>OK</button>", lambda: f"We use cookies. {self.words(2, 20)} {self.link(2)}")
        return self.wrap(inner, self.r.choice(("div", "div", "section", "aside", "dialog")), "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "popup", "cookie-bar", "modal", chance=1)

    def sidebar(self) -> str:
        inner = self.pick(
            lambda: f"<h3>{self.words(1, 3)}</h3><ul>" + "".join(f"<li>{self.link(8)}</li>" for _ in range(self.r.randint(2, 7))) + "</ul>",
            lambda: f"<h4>{self.words(1, 3)}</h4><p>{self.words(4, 45)}</p>",
            lambda: f"<p>{self.words(4, 45)}</p>",
            lambda: self.words(4, 30),
        )
        return self.wrap(inner, "aside", "sidebar", "related", "widget", chance=0.5) if self.r.random() < 0.55 else self.wrap(inner, "div", "sidebar", "related", "widget", "side-column", "recommended", "popular", chance=1)

    def form(self) -> str:
        inner = self.pick(
            lambda: f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>",
            lambda: f"<p>{self.words(3, 25)}</p><input type=email><button>Go</button>",
            lambda: f"<h3>{self.words(1, 4)}</h3><p>{self.words(3, 20)}</p><label>{self.words(1, 2)}<input></label>",
        )
        form = f"<form action=/x>{inner}</form>"
        return self.wrap(form, "div", "newsletter", "subscribe", "login", "search", "signup-form", chance=1) if self.r.random() < 0.5 else form

    def share(self) -> str:
        return self.wrap(" ".join(self.link(1) for _ in range(self.r.randint(2, 5))), "div", "share", "social", "sharing-links", chance=1)

    def comments(self) -> str:
        one = lambda: self.pick(
            lambda: self.wrap(f"<b>{self.words(1, 2)}</b> <p>{self.words(2, 45)}</p>", "div", "comment", "reply", chance=0.8),
            lambda: f"<li>{self.words(2, 40)}</li>",
            lambda: f"<article><p>{self.words(2, 45)}</p></article>",
            lambda: f"<p>{self.words(2, 45)}</p>",
        )
        inner = f"<h2>{self.words(1, 2)}</h2>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.wrap(inner, self.r.choice(("div", "section", "ol", "aside")), "comments", "comment-list", "discussion", "reader-comments", "disqus", "replies", chance=1)

    def said(self, low: int, high: int) -> str:
        return self.words(low, high) + self.MARK

    def article(self) -> str:
        r = self.r
        paragraph = lambda: self.pick(
            *[lambda: f"<p>{self.said(15, 130)}</p>"] * 5,
            *[lambda: f"<p>{self.said(1, 12)}</p>"] * 3,
            lambda: f"<p>{self.said(15, 80)}",
            lambda: f"<p>{self.words(5, 20)} {self.link(3)} {self.said(5, 40)}</p>",
            lambda: f"<p><b>{self.said(1, 20)}<br>",
            lambda: f"<h2>{self.said(1, 8)}</h2><p>{self.said(10, 80)}</p>",
            lambda: f"<h3>{self.said(1, 8)}</h3><p>{self.said(10, 80)}</p>",
            lambda: "<ul>" + "".join(f"<li>{self.said(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{self.said(2, 20)}" for _ in range(r.randint(2, 5))) + "</ol>",
            lambda: f"<blockquote><p>{self.said(5, 50)}</p></blockquote>",
            lambda: f"<blockquote>{self.said(5, 50)}</blockquote>",
            lambda: "<table>" + "".join(f"<tr><td>{self.said(1, 4)}</td><td>{self.said(1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
            lambda: f"<figure><img src=x.png><figcaption>{self.said(2, 15)}</figcaption></figure>",
            lambda: f"<pre>{self.said(3, 20)}</pre>",
            lambda: f"<div>{self.said(8, 90)}</div>",
            lambda: f"<section><h2>{self.said(1, 6)}</h2><p>{self.said(10, 60)}</p></section>",
        )
        parts = [paragraph() for _ in range(r.choice((1, 2, 3, 5, 8, 13)))]
        if r.random() < 0.25:
            parts = [f"<p>{self.said(1, 6)}</p>" for _ in range(r.randint(1, 3))]  # short articles
        for _ in range(r.choice((0, 0, 1, 2))):
            parts.insert(r.randint(0, len(parts)), self.pick(self.advert, self.advert, self.form, self.share, self.sidebar, self.notice))
        title = f"<h1>{self.said(1, 14)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = title + "".join(parts)
        if r.random() < 0.2:
            inner += self.comments()
        tag, names = r.choice((("article", ("post", "entry")), ("article", ("story", "article")), ("main", ("content", "main")), ("div", ("content", "post-body", "entry-content", "article-text", "story", "main-content"))))
        inner = self.wrap(inner, tag, *names, chance=1 if tag == "div" else 0.3)
        return f"<main>{inner}</main>" if tag == "article" and r.random() < 0.3 else inner

    def page(self) -> tuple[list[list[int]], list[int]]:
        r = self.r
        some = lambda f, p: [f()] if r.random() < p else []
        before = some(self.header, 0.6) + some(self.menu, 0.7) + some(self.advert, 0.5) + some(self.notice, 0.3) + some(self.sidebar, 0.25) + some(self.form, 0.2)
        after = some(self.share, 0.2) + some(self.comments, 0.35) + some(self.sidebar, 0.4) + some(self.advert, 0.3) + some(self.form, 0.25) + some(self.notice, 0.2)
        r.shuffle(before)
        r.shuffle(after)
        body = "".join(before) + self.article() + "".join(after) + "".join(some(self.footer, 0.8)) + "".join(some(self.notice, 0.1))
        if r.random() < 0.25:
            body = self.wrap(body, "div", "page", "wrapper", "container", chance=1)
        found = leaves(f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>")
        labels = [int(self.MARK in leaf.text) for leaf in found]
        clean = [Leaf(leaf.text.replace(self.MARK, ""), leaf.tag, leaf.around, leaf.linked) for leaf in found]
        return facts(clean), labels


def train(pages: DataFrame, sample: int = TRAIN_PAGES, layouts: int = LAYOUTS) -> Chain:
    """Fit the field on layouts filled with texts of at most ``sample`` of the pages."""

    def run(htmls):
        out = []
        for h in htmls:
            found = sorted({leaf.text[:400] for leaf in leaves(h)})
            out.append(([t for t in found if t.count(" ") >= 4][:40], [t for t in found if t.count(" ") < 3][:40]))
        return list(zip(*out))

    texts = T.ArrayType(T.StringType())
    chosen = pages.select("page_id", F.col("html").cast("string").alias("html")).where("html <> ''").orderBy(F.xxhash64("page_id"), "html").limit(sample)
    rows = add_columns(chosen, ["html"], [T.StructField("texts", texts), T.StructField("short", texts)], run, drop=("html",)).collect()
    rows.sort(key=lambda r: (r.page_id is None, r.page_id, r.texts))
    made = Layouts([t for r in rows for t in r.texts], [t for r in rows for t in r.short])
    return fit([made.page() for _ in range(layouts)])


def main_text(page: str | None, chain: Chain) -> str:
    found = leaves(page)
    return "\n".join(leaf.text for leaf, on in zip(found, chain.decode(facts(found))) if on)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """page_id, url, text and n_chars of every page row.  A null or empty page has an empty text."""

    def run(htmls):
        made = [main_text(h, chain) for h in htmls]
        return made, [len(t) for t in made]

    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return add_columns(pages, ["html"], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], run, drop=("html",))


def texts(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages))
