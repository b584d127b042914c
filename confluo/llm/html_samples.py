"""Random labelled web pages to train the extraction on.

``data-y`` marks blocks as article text (1) or not (0); the parser reads it for
training only, it is no feature.
"""

from __future__ import annotations

import re

import numpy as np

#: Syllables that made-up words are joined from.
_SYLLABLES = "the and tion er in on at en is es re ou le de an la que ment ch sch ung ci ado os bo ver ta mi or st be".split()
_GOOD = ["content", "main-content", "article-body", "post", "entry-content", "story", "post-content", "page-text", "articleBody", "main", "text", "body"]
_BAD = {
    "nav": ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "navigation", "toolbar", "pagination"],
    "header": ["header", "site-header", "masthead", "topbar", "page-header", "banner"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom"],
    "aside": ["sidebar", "side", "widget", "related-posts", "rail", "recommended", "aside"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"],
    "notice": ["cookie-notice", "cookie", "notice", "alert", "consent-banner", "popup", "modal", "subscribe", "newsletter-signup", "warning"],
    "comments": ["comments", "comment-list", "replies", "disqus_thread", "discussion", "comment"],
    "form": ["form", "login-form", "search-form", "subscribe-form", "contact"],
    "share": ["share", "social-links", "share-bar", "tags", "meta", "byline", "author"],
}


class _Page:
    def __init__(self, rng: np.random.Generator):
        self.r = rng
        self.good = self._some(_GOOD) if rng.random() < 0.7 else ""
        self.sloppy = rng.random() < 0.25

    def _some(self, xs: list[str]) -> str:
        return xs[int(self.r.integers(len(xs)))]

    def word(self) -> str:
        return "".join(self._some(_SYLLABLES) for _ in range(int(self.r.integers(1, 4))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(int(self.r.integers(lo, hi))))

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + "." for _ in range(int(self.r.integers(lo, hi))))

    def named(self, names: list[str], chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return ""
        return f' {"class" if self.r.random() < 0.7 else "id"}="{self._some(names)}"'

    def links(self, n: int) -> str:
        items = [f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>' for _ in range(n)]
        if self.r.random() < 0.2:
            return " | ".join(x[4:-5] for x in items)
        return f"<ul>{''.join(items)}</ul>"

    def block(self, kind: str) -> str:
        r, n = self.r, int(self.r.integers(2, 9))
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if r.random() < 0.4 and kind != "form":
            tag = "div"
        name = self.named(_BAD[kind], 0.6 if tag != "div" else 1.0)
        if kind == "nav":
            inner = self.links(n)
        elif kind == "header":
            inner = f"<h1>{self.words(1, 5)}</h1>" * (r.random() < 0.4) + f"<p>{self.words(2, 9)}</p>" * (r.random() < 0.4) + self.links(n) * (r.random() < 0.5) or f"<a href='/'>{self.words(1, 3)}</a>"
        elif kind == "footer":
            inner = self._some([f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 3)}", f"<p>&copy; 2024 {self.words(1, 4)}. {self.prose(1, 2)}</p>", f"<p>{self.prose(1, 3)}</p>" + self.links(n), self.links(n)])
        elif kind == "aside":
            inner = f"<h3>{self.words(1, 4)}</h3>" * (r.random() < 0.7) + self._some([self.links(n), f"<p>{self.prose(1, 4)}</p>", "".join(f"<div><a href='#'>{self.words(2, 8)}</a><p>{self.prose(1, 2)}</p></div>" for _ in range(n))])
        elif kind == "ad":
            inner = self._some([self.prose(1, 4), f"<p>{self.prose(1, 3)}</p>", f"<a href='#'>{self.words(2, 8)}</a>", f"<h4>{self.words(1, 4)}</h4><p>{self.prose(1, 3)}</p>"])
        elif kind == "notice":
            inner = f"<p>{self.prose(1, 4)}</p>" * (r.random() < 0.7) + f"<button>{self.word()}</button><a href='#'>{self.words(1, 3)}</a>" if r.random() < 0.6 else self.prose(1, 4)
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.6) + "".join(f"<{t}{self.named(['comment', 'reply', 'comment-body'], 0.6)}><b>{self.word()}</b> <p>{self.prose(1, 7)}</p></{t}>" for t in [self._some(["div", "li", "article", "section"])] for _ in range(n))
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name='q'><p>{self.words(2, 8)}</p><button>{self.word()}</button>"
        else:
            inner = self._some([self.links(n), f"<span>{self.words(1, 4)}</span> <a href='#'>{self.word()}</a>", f"<p>{self.words(1, 6)}</p>"])
        return f'<{tag}{name} data-y="0">{inner}</{tag}>'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(2, 10)}</h1>")
        for k in range(int(r.choice([1, 2, 4, 7, 14, 25]))):
            x = r.random()
            if x < 0.08:
                out.append(f"<h2>{self.words(1, 8)}</h2>")
            elif x < 0.14:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 14)}{'.' * (r.random() < 0.5)}</li>" for _ in range(int(r.integers(2, 7)))) + "</ul>")
            elif x < 0.17:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.19:
                out.append("<table><tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.21:
                out.append(f"<pre><code>{self.words(3, 20)}</code></pre>")
            elif x < 0.26 and k:
                out.append(self.block(self._some(["ad", "share", "aside", "notice"])))
            else:
                text = self.prose(1, int(r.choice([2, 2, 4, 9]))) if r.random() < 0.9 else self.words(1, 12)
                if r.random() < 0.15:
                    text = f"{text} <a href='/{self.word()}'>{self.words(1, 4)}</a> {self.words(1, 9)}."
                if r.random() < 0.08:
                    text = " ".join(w + "$%&#*"[int(r.integers(5))] * 3 for w in text.replace(".", "").split()).replace("&", "&amp;")
                if r.random() < 0.06:
                    text = f"<a href='#'>{text}</a>"
                if self.sloppy and r.random() < 0.4:
                    out.append(f"<p><b>{text}<br>")
                else:
                    out.append(f"<div>{text}</div>" if r.random() < 0.06 else f"<p>{text}</p>")
        if r.random() < 0.12:  # no element of its own
            return "".join(x if "data-y" in x[:80] else re.sub(r"^<(\w+)", r'<\1 data-y="1"', x) for x in out)
        inner = "".join(out)
        tag = self._some(["article", "article", "main", "div", "section"])
        name = f' class="{self.good}"' if self.good and (tag in ("div", "section") or r.random() < 0.4) else ""
        if r.random() < 0.15:
            inner = f"<div{self.named(_GOOD, 0.5)}>{inner}</div>"
        return f'<{tag}{name} data-y="1">{inner}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [self.block(k) for k, c in (("header", 0.5), ("nav", 0.8), ("notice", 0.3), ("ad", 0.5), ("form", 0.2)) if r.random() < c]
        after = [self.block(k) for k, c in (("share", 0.3), ("comments", 0.4), ("aside", 0.4), ("ad", 0.3), ("nav", 0.15), ("form", 0.2), ("notice", 0.15), ("footer", 0.9)) if r.random() < c]
        if r.random() < 0.2:
            r.shuffle(before)
        body = "".join(before) + (self.article() if r.random() < 0.97 else "") + "".join(after)
        if r.random() < 0.4:
            body = f'<div{self.named(["wrapper", "container", "page", "layout"], 0.7)}>{body}</div>'
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body data-y="0">{body}' + "</body></html>" * (r.random() < 0.9)


def sample_page(rng: np.random.Generator) -> str:
    """A page of a random layout, its blocks marked by ``data-y``."""
    return _Page(rng).page()
