"""Labelled pages for training the extraction field.

Each page is put together from parts whose label is known: parts of the article carry the mark
``K`` at the start of their words, all others carry ``J``, so a block's label can be read off its
text. Layouts, element names, class names, lengths and the closing of tags vary by a seeded
generator, and cover pages with and without semantic elements, with class names that say nothing
(invented ones stand for those of other languages), with text in plain ``div`` elements or between
line breaks, and with menus and footers that are no lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

PAGES = 240
SEED = 11


class Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        #: Of the page being written: its text's elements, whether its class names say nothing, and whether its menus are lists.
        self.block, self.opaque, self.listed = "p", False, True

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def some(self, chance: float) -> bool:
        return bool(self.rng.random() < chance)

    def words(self, mark: str, least: int, most: int, end: str = ".") -> str:
        n = int(self.rng.integers(least, most + 1))
        return " ".join(mark + "abcdefghij"[int(k)] * int(m) for k, m in zip(self.rng.integers(0, 10, n), self.rng.integers(1, 7, n), strict=True)) + end

    def wrap(self, name: str, inner: str, hint: str = "") -> str:
        if hint and self.opaque:
            hint = "".join(self.pick("bdfgklmnprstvzäöñ海") + self.pick("aeiouüé本") for _ in range(int(self.rng.integers(1, 4)))) + self.pick("", "-1", "_x")
        attribute = f' {self.pick("class", "id")}="{hint}"' if hint else ""
        return f"<{name}{attribute}>{inner}</{name}>"

    def other(self, least: int, most: int) -> str:
        """Text that is not the article's, with the ends that the article's has."""
        return self.words("J", least, most, self.pick(".", ".", "!", "?", ""))

    def links(self, least: int, most: int) -> str:
        if not self.listed:
            return self.pick(" ", " | ", "<br>", "").join(f'<a href="/x">{self.words("J", 1, 3, "")}</a>' for _ in range(int(self.rng.integers(least, most + 1))))
        items = "".join(f'<li><a href="/x">{self.words("J", 1, 3, "")}</a></li>' for _ in range(int(self.rng.integers(least, most + 1))))
        return f"<ul>{items}</ul>"

    def menu(self, semantic: bool) -> str:
        return self.wrap("nav", self.links(3, 9)) if semantic else self.wrap("div", self.links(3, 9), self.pick("menu", "navbar", "main-navigation", "topbar"))

    def header(self, semantic: bool) -> str:
        inner = self.wrap(self.pick("h1", "p", "div"), self.words("J", 1, 5, "")) + (self.wrap("p", self.words("J", 2, 8, "")) if self.some(0.5) else "")
        return self.wrap("header", inner) if semantic else self.wrap("div", inner, self.pick("header", "masthead", "site-header banner"))

    def footer(self, semantic: bool) -> str:
        inner = self.pick("&copy; ", "", "&copy; 2020 ") + self.words("J", 3, 14) + (f"<p>{self.words('J', 3, 25)}</p>" if self.some(0.4) else "") + (self.links(2, 5) if self.some(0.4) else "")
        return self.wrap("footer", inner) if semantic else self.wrap("div", inner, self.pick("footer", "page-footer", "site-footer"))

    def advert(self) -> str:
        return self.wrap(self.pick("div", "div", "aside", "section", "p"), self.pick("", "<p>") + self.other(3, 45), self.pick("ad", "ads", "advert", "sponsored", "promo-box", "ad-banner"))

    def notice(self) -> str:
        return self.wrap(self.pick("div", "div", "section", "p"), self.other(6, 40), self.pick("cookie-notice", "consent", "notice", "gdpr-banner", "newsletter signup"))

    def sidebar(self, semantic: bool) -> str:
        inner = self.wrap(self.pick("h3", "h4"), self.words("J", 1, 3, "")) + self.pick(self.links(2, 6), f"<p>{self.other(5, 40)}</p>")
        return self.wrap("aside", inner) if semantic else self.wrap("div", inner, self.pick("sidebar", "related", "widget", "recommended", "trending"))

    def form(self) -> str:
        return f'<form action="/s">{self.pick("", "<p>")}<label>{self.words("J", 1, 6, "")}</label><input type="text"><p>{self.words("J", 2, 20)}</p><button>{self.words("J", 1, 2, "")}</button></form>'

    def comments(self) -> str:
        return self.wrap(self.pick("div", "section", "ol"), "".join(self.wrap(self.pick("p", "div", "li"), self.other(4, 45)) for _ in range(int(self.rng.integers(1, 6)))), self.pick("comments", "comment-list", "disqus", "replies"))

    def paragraph(self) -> str:
        text = self.words("K", 1 if self.some(0.2) else 6, 90, self.pick(".", ".", "!", "?", "", " K###", " K$$$"))
        if self.some(0.15):
            text += f' <a href="/y">{self.words("K", 1, 3, "")}</a> ' + self.words("K", 2, 12)
        if self.some(0.15):
            text = f"<b>{text}<br>" if self.some(0.5) else f"<em>{text}</em>"
        if self.block == "div":
            return self.wrap("div", text.replace("<br>", " "), self.pick("", "x", "row"))
        if self.block == "br":
            return f"{text}<br><br>" if text.count("<b>") == text.count("</b>") else f"{text}</b><br><br>"
        return f"<p>{text}" + ("</p>" if self.some(0.8) else "")

    def body(self, inside: bool) -> str:
        parts = [self.wrap(self.pick("h1", "h2"), self.words("K", 1, 14, self.pick("", ".")))] if self.some(0.9) else []
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.78:
                parts.append(self.paragraph())
            elif kind < 0.84:
                parts.append(self.wrap(self.pick("h2", "h3", "h4"), self.words("K", 1, 7, "")))
            elif kind < 0.9:
                name = self.pick("ul", "ol")
                parts.append(f"<{name}>" + "".join(self.wrap("li", self.words("K", 2, 22, self.pick("", "."))) for _ in range(int(self.rng.integers(2, 6)))) + f"</{name}>")
            elif kind < 0.93:
                parts.append(self.wrap("blockquote", self.paragraph()))
            elif kind < 0.95:
                parts.append("<table>" + "".join("<tr>" + "".join(self.wrap("td", self.words("K", 1, 4, "")) for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                parts.append(self.wrap("pre", self.words("K", 3, 20, "")))
            elif inside and not self.opaque:
                parts.append(self.pick(self.advert, self.form, lambda: self.sidebar(True), self.notice)())
        return "".join(parts)

    def page(self) -> str:
        self.block, self.opaque, self.listed = self.pick(*["p"] * 8, "div", "br"), self.some(0.25), self.some(0.75)
        semantic = self.some(0.6)
        inner = self.body(True)
        if semantic:
            article = self.wrap(self.pick("article", "article", "main"), inner)
            article = self.wrap("main", article) if article.startswith("<article") and self.some(0.3) else article
        else:
            article = self.wrap("div", inner, self.pick("content", "post", "article-body", "entry-content", "story", "", "main text"))
        # Where names say nothing, only what its place and links give away is not the article's.
        above = [f for f in (lambda: self.header(semantic), lambda: self.menu(semantic), *([] if self.opaque else [self.notice, self.advert])) if self.some(0.55)]
        below = [f for f in (*([] if self.opaque else [lambda: self.sidebar(semantic)]), self.form, *([] if self.opaque else [self.comments, self.advert]), lambda: self.footer(semantic), *([] if self.opaque else [self.notice])) if self.some(0.45)]
        head = f'<!DOCTYPE html><html lang="en"><head><title>{self.words("J", 2, 8, "")}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        return head + "".join(f() for f in above) + article + "".join(f() for f in below) + ("</body></html>" if self.some(0.9) else "")


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """Pages and, for each, the function from a block's text to its label."""
    writer = Writer(np.random.default_rng(seed))
    for _ in range(pages):
        yield writer.page(), lambda text: sum(w.startswith("K") for w in text.split()) > sum(w.startswith("J") for w in text.split())
