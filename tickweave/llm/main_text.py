"""Main text of web pages by a conditional random field over leaf blocks.

A linear chain over the leaf blocks of a page labels each as main text or not, from the
tags and names above it, its own text, and the blocks beside it; Viterbi decodes. It is
trained on labelled pages: layouts whose parts are known (articles with menus, headers,
footers, sidebars, notices, adverts, forms, comments around and inside them), filled with
text of a bounded sample of the pages at hand, ``max_pages`` chosen by a hash of the id.

Defined results: a null or empty page, and one without main text, gives an empty text.
Character references are decoded, ``br`` is white space, every other element boundary of
block kind parts blocks. Pages cut off are read to their end. Repeated rows get equal
texts; further columns are kept.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import col, hash_sample
from .crf import Chain, fit, viterbi, with_neighbours
from .dom_blocks import Block, leaf_blocks

TAGS = (
    "article main section nav header footer aside form ul ol li table figure figcaption dialog blockquote pre address "
    "button label select details h1 h2 h3 h4 p div dd a menu fieldset legend caption"
).split()
#: Families of words in class names, ids and roles, by what they tell about a part.
NAMES = {
    "advert": r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|commercial|outbrain|taboola|dfp|banner",
    "menu": r"nav\w*|menu\w*|breadcrumb\w*|crumbs?|pag(?:er|ination)|toolbar|tabs?|toc|skip\w*|links",
    "comment": r"comment\w*|repl(?:y|ies)|discuss\w*|disqus|respon[ds]\w*|feedback|guestbook|review\w*",
    "notice": r"cookies?|consent|gdpr|privacy|notice\w*|alert\w*|message|modal|popup|overlay|toast|disclaimer|warning|paywall|announce\w*",
    "side": r"side\w*|widget\w*|related|recommend\w*|more|popular|trending|latest|teaser\w*|rail|complementary|aside|most\w*",
    "share": r"shar(?:e|ing)\w*|social\w*|follow|like\w*|tags?|tweet|facebook|rating",
    "head": r"head|header|masthead|top\w*|logo|brand\w*|site-?title|hero",
    "foot": r"foot\w*|bottom|copyright|legal|contentinfo|imprint|colophon|credits?",
    "form": r"form\w*|login\w*|signin|signup|register|search\w*|newsletter\w*|subscri\w*|contact|cta",
    "content": r"article\w*|content\w*|post\w*|entry\w*|story\w*|main\w*|body|text|prose|blog\w*|page|single|document",
}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_FAMILIES = [re.compile(rf"(?:{p})\Z", re.I) for p in NAMES.values()]
_PHRASES = [
    re.compile(p, re.I)
    for p in (
        r"©|\(c\)|copyright|all rights|tous droits|rechte vorbehalten|derechos reservados",
        r"cookie|privacy|datenschutz|subscribe|newsletter|sign (?:in|up)|log ?in|terms",
        r"advert|sponsored|anzeige|publicit|anuncio|promo",
        r"comment|reply|share|tweet|read more|related|also like|posted by",
        r"home|about|contact|menu|next|previous|search",
    )
]


def _families(names: str, known: dict[str, np.ndarray]) -> np.ndarray:
    if names not in known:
        words = _WORDS.findall(names)
        hits = [any(p.match(w) for w in words) for p in _FAMILIES]
        if len(known) > 20_000:
            known.clear()
        known[names] = np.array(hits, dtype=np.float64)
    return known[names]


_AT = {t: k for k, t in enumerate(TAGS)}


def page_features(blocks: list[Block], known: dict[str, np.ndarray]) -> np.ndarray:
    """A feature row per block."""
    n = len(blocks)
    x = np.zeros((n, 1 + 2 * len(TAGS) + 3 * len(NAMES) + 24))
    for k, block in enumerate(blocks):
        row, at = x[k], 1
        row[0] = 1
        for e in block.path:
            if e.tag in _AT:
                row[at + _AT[e.tag]] = 1
        at += len(TAGS)
        own = next((e for e in reversed(block.path) if e.tag in _AT and e.tag != "a"), None)
        if own:
            row[at + _AT[own.tag]] = 1
        at += len(TAGS)
        inside = False
        for e in block.path:
            hits = _families(e.names, known) if e.names else None
            if hits is not None:
                row[at : at + len(NAMES)] = np.maximum(row[at : at + len(NAMES)], hits)
                if inside:
                    inner = slice(at + len(NAMES), at + 2 * len(NAMES))
                    row[inner] = np.maximum(row[inner], hits)
                row[at + 2 * len(NAMES) : at + 3 * len(NAMES)] = hits
            inside = inside or e.tag in ("article", "main") or bool(hits is not None and hits[-1])
        at += 3 * len(NAMES)
        text, words = block.text, block.text.count(" ") + 1
        share = block.linked / max(1, len(text))
        parts = (
            inside, words < 4, words < 10, words > 24, words > 60, np.log1p(len(text)) / 8, share > 0.2, share > 0.6,
            text[-1] in ".!?:;\"»”", text.isupper(), text[:1].islower(), text.count(",") > 1,
            sum(map(text.count, "0123456789")) > len(text) / 5, k == 0, k == n - 1, k < n / 5, k > 0.8 * n,
            any(e.tag in ("article", "main") for e in block.path) and any(e.tag == "header" for e in block.path),
            n < 5,
        )
        row[at : at + len(parts)] = parts
        at += len(parts)
        if words < 40:
            row[at : at + len(_PHRASES)] = [bool(p.search(text)) for p in _PHRASES]
    return x


class Layouts:
    """Labelled pages: layouts with marks (data-y 1: main text), filled with given texts."""

    def __init__(self, texts: list[str], seed: int = 1) -> None:
        self.rng = random.Random(seed)
        words = [w for t in texts for w in t.split()][:200_000]
        self.words = words or "some words to fill a page with when no page has any".split()
        self.paragraphs = [t for t in texts if len(t) > 40] or [" ".join(self.words)]

    def some(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        start = self.rng.randrange(max(1, len(self.words) - n))
        return escape(" ".join(self.words[start : start + n]))

    def pick(self, options: str) -> str:
        return self.rng.choice(options.split())

    def box(self, names: str, inner: str, tags: str = "div", y: int = 0) -> str:
        tag, attribute = self.pick(tags), self.rng.choice(("class", "class", "id"))
        name = f' {attribute}="{self.pick(names)}"' if self.rng.random() < 0.9 else ""
        return f'<{tag}{name} data-y="{y}">{inner}</{tag}>'

    def links(self) -> str:
        items = "".join(f"<li><a href='/x'>{self.some(1, 4)}</a></li>" for _ in range(self.rng.randint(2, 7)))
        return self.rng.choice((f"<ul>{items}</ul>", items.replace("li>", "span>"), f"<ol>{items}</ol>"))

    def prose(self, low: int = 1, high: int = 3) -> str:
        return "".join(f"<p>{self.some(4, 40)}.</p>" for _ in range(self.rng.randint(low, high)))

    def menu(self) -> str:
        tag = self.rng.choice(("nav data-y=0", "div class='menu' data-y=0", "div id=navbar data-y=0", "ul class=nav-links data-y=0"))
        return f"<{tag}>{self.links()}</{tag.split()[0]}>"

    def header(self) -> str:
        inner = self.rng.choice((f"<a href='/'>{self.some(1, 3)}</a>", f"<h1>{self.some(1, 4)}</h1>", f"<p>{self.some(2, 9)}</p>"))
        inner += self.menu() if self.rng.random() < 0.4 else ""
        return self.rng.choice(
            (f"<header data-y=0>{inner}</header>", self.box("header masthead site-header topbar page-head", inner))
        )

    def footer(self) -> str:
        inner = f"&copy; {self.some(1, 3)} &middot; {self.some(2, 14)}." if self.rng.random() < 0.6 else self.links()
        inner += self.prose(0, 1)
        return self.rng.choice((f"<footer data-y=0>{inner}</footer>", self.box("footer site-footer bottom copyright", inner)))

    def advert(self) -> str:
        inner = self.rng.choice((self.some(3, 25), self.prose(1, 1), f"<a href=x>{self.some(2, 10)}</a>"))
        return self.box("ad ads advert advertisement ad-slot sponsored promo promo-box banner", inner, "div div aside section p")

    def notice(self) -> str:
        inner = self.prose(1, 2) + (f"<button>{self.some(1, 2)}</button>" if self.rng.random() < 0.5 else "")
        return self.box("cookie-notice cookie-banner consent gdpr notice alert modal popup announcement disclaimer", inner, "div div section dialog aside")

    def side(self) -> str:
        inner = f"<h3>{self.some(1, 4)}</h3>" + self.rng.choice((self.links(), self.prose(1, 2), self.prose(2, 3)))
        return self.rng.choice(
            (f"<aside data-y=0>{inner}</aside>", self.box("sidebar side-bar widget related related-posts recommended more-stories popular", inner, "div section aside"))
        )

    def form(self) -> str:
        inner = f"<label>{self.some(1, 4)}</label><input name=q><p>{self.some(3, 15)}</p><button>{self.some(1, 2)}</button>"
        return self.rng.choice(
            (f"<form data-y=0>{inner}</form>", self.box("newsletter subscribe signup login search-form contact-form", f"<form>{inner}</form>"))
        )

    def comments(self) -> str:
        one = lambda: self.box("comment comment-body reply comment-item", self.prose(1, 2), "div li article p")
        inner = f"<h3>{self.some(1, 3)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 5)))
        return self.box("comments comment-list discussion responses comments-area reader-comments", inner, "section div ol")

    def share(self) -> str:
        return self.box("share social share-buttons social-links tags", self.links())

    def article(self) -> str:
        rng, parts = self.rng, []
        if rng.random() < 0.8:
            title = f"<h1>{self.some(2, 12)}</h1>"
            parts.append(f"<header>{title}</header>" if rng.random() < 0.2 else title)
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9))):
            text = escape(rng.choice(self.paragraphs)[:3000]) if rng.random() < 0.5 else self.some(1, 90) + "."
            parts.append(
                rng.choices(
                    (
                        f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br></p>", f"<div>{text}</div>",
                        f"<p>{self.some(1, 9)} <a href=x>{self.some(1, 4)}</a> {text}</p>",
                        f"<h2>{self.some(1, 8)}</h2>", f"<blockquote>{text}</blockquote>",
                        "<ul>" + "".join(f"<li>{self.some(2, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>",
                        f"<table><tr><td>{self.some(1, 4)}</td><td>{self.some(1, 4)}</td></tr></table>",
                        f"<figure><figcaption>{self.some(2, 12)}</figcaption></figure>", f"<pre>{text}</pre>",
                        f"<p>{self.some(1, 2)}.</p>", f"<section><h3>{self.some(1, 5)}</h3><p>{text}</p></section>",
                    ),
                    (30, 8, 8, 8, 6, 6, 3, 4, 2, 2, 2, 6, 4),
                )[0]
            )
        for part in (self.advert, self.share, self.side, self.notice, self.form, self.comments, self.menu):
            if rng.random() < 0.15:
                parts.insert(rng.randint(0, len(parts)), part())
        inner = "".join(parts)
        wrapped = rng.choices(
            (
                f'<article data-y="1">{inner}</article>', f'<main data-y="1">{inner}</main>',
                f'<main data-y="1"><article>{inner}</article></main>',
                self.box("content article post post-content entry-content story-body main-content article-body page-content", inner, "div div section", 1),
                f'<div id="content" data-y="1"><article class="post">{inner}</article></div>', f'<div data-y="1">{inner}</div>',
            ),
            (8, 3, 3, 5, 3, 1),
        )[0]
        return wrapped

    def page(self) -> str:
        rng = self.rng
        above = [p() for p in (self.notice, self.header, self.menu, self.advert, self.form, self.side) if rng.random() < 0.45]
        below = [p() for p in (self.share, self.comments, self.side, self.advert, self.form, self.notice, self.footer) if rng.random() < 0.4]
        if rng.random() < 0.2:  # nothing but the article
            above, below = [], []
            if rng.random() < 0.3:
                return f'<body data-y="1">{self.prose(1, 3)}'
        rng.shuffle(above)
        article = self.article() if rng.random() < 0.97 else ""
        body = "".join(above) + article + "".join(below)
        if rng.random() < 0.3:
            body = f"<div class='{self.pick('wrapper container page site layout')}'>{body}</div>"
        return f"<html><body>{body}" + ("</body></html>" if rng.random() < 0.9 else "")


def fit_blocks(texts: list[str], n_pages: int = 1000, seed: int = 1) -> Chain:
    layouts, known = Layouts(texts, seed), {}
    xs, ys, lengths = [], [], []
    for _ in range(n_pages):
        if blocks := leaf_blocks(layouts.page()):
            xs.append(page_features(blocks, known))
            ys += [int(b.mark == "1") for b in blocks]
            lengths.append(len(blocks))
    sizes = np.array(lengths)
    return fit(with_neighbours(np.vstack(xs), sizes), np.array(ys), sizes, rounds=120, ridge=3e-4)


def train_blocks(pages: DataFrame, html: str = "html", key: str = "page_id", max_pages: int = 300) -> Chain:
    """Fit on labelled layouts filled with the text of at most ``max_pages`` pages."""

    @F.pandas_udf("array<string>")
    def texts_of(parts: pd.Series) -> pd.Series:
        return parts.map(lambda h: [b.text for b in leaf_blocks(h if isinstance(h, str) else None)], na_action=None)

    sample = hash_sample(pages.where(col(html).isNotNull()), col(key), max_pages, col(html))
    rows = sample.select(texts_of(col(html)).alias("t"), col(key).cast("string").alias("k")).collect()
    return fit_blocks([t for r in sorted(rows, key=lambda r: (r.k or "", r.t)) for t in r.t])


def main_texts(chain: Chain, pages: list[str | None], known: dict[str, np.ndarray]) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    lengths = np.array([len(b) for b in blocks])
    if not lengths.sum():
        return [""] * len(pages)
    x = np.vstack([page_features(b, known) for b in blocks if b])
    sizes = lengths[lengths > 0]
    labels = iter(viterbi(chain, chain.scores(with_neighbours(x, sizes)), sizes))
    return ["\n".join([b.text for b in page if next(labels) == 1]) for page in blocks]


def with_main_text(pages: DataFrame, chain: Chain, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with their main text in the column ``out``."""
    sent = pages.sparkSession.sparkContext.broadcast(chain)  # a small matrix

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        for part in parts:
            htmls = [h if isinstance(h, str) else None for h in part]
            texts: list[str] = []
            for k in range(0, len(htmls), 200):
                texts += main_texts(sent.value, htmls[k : k + 200], known)
            yield pd.Series(texts, dtype=object)

    return pages.withColumn(out, extract(col(html)))

