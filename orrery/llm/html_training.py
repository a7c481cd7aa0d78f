"""Generated pages for the HTML model: every main text run carries the sign U+2402, which the trainer removes."""

from __future__ import annotations

import random
from collections.abc import Iterator

SIGN = "␂"
_PARTS = "an be co de el fo ga hi in ju ka lo ma ne or pa qui re so ta un ve wi ya zo sch tion ment ung ado".split()


def training_pages(n: int, seed: int) -> Iterator[str]:
    for i in range(n):
        yield _Page(random.Random(seed * 1_000_003 + i)).html()


class _Page:
    """One page: a site frame with boilerplate around, and at times inside, an article."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def odds(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, a: int, b: int) -> str:
        w = ["".join(self.r.choices(_PARTS, k=self.r.randint(1, 4))) for _ in range(self.r.randint(a, b))]
        for i in range(len(w)):
            if self.r.random() < 0.12:
                w[i] += self.r.choice(",.;")
        return " ".join(w).capitalize() + ("." if self.odds(0.7) else "")

    def attr(self, *names: str, p: float = 0.8) -> str:
        if not self.odds(p):
            return ""
        name = self.r.choice(names)
        if self.odds(0.3):
            name = self.r.choice(["site-", "js-", "page_", "c-"]) + name
        return f' {self.r.choice(["class", "class", "id"])}="{name}{self.r.choice(["", " wide", " clear", "-box"])}"'

    def tag(self, name: str, inside: str, attr: str = "", closed: float = 1.0) -> str:
        return f"<{name}{attr}>{inside}" + (f"</{name}>" if self.odds(closed) else "")

    def links(self, n: int) -> str:
        item = [f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 4)}</a>' for _ in range(n)]
        style = self.r.randint(0, 2)
        if style == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>"
        return (" | " if style == 1 else " ").join(item)

    def menu(self) -> str:
        return self.tag(*self.r.choice([("nav",), ("div",)]), self.links(self.r.randint(2, 9)), self.attr("nav", "menu", "navbar", "breadcrumbs", p=0.9))

    def header(self) -> str:
        inner = self.tag(self.r.choice(["h1", "p", "div"]), self.words(1, 5), self.attr("logo", "brand", "title")) + (self.menu() if self.odds(0.6) else "")
        return self.tag(*self.r.choice([("header", inner, ""), ("div", inner, self.attr("header", "masthead", "top", p=1))]))

    def footer(self) -> str:
        inner = "&copy; " + self.words(2, 25) if self.odds(0.6) else self.tag("p", self.words(4, 30)) + self.links(self.r.randint(0, 6))
        return self.tag(*self.r.choice([("footer", inner, ""), ("div", inner, self.attr("footer", "copyright", "legal", p=1))]))

    def side(self) -> str:
        inner = self.tag(self.r.choice(["h2", "h3"]), self.words(1, 3)) + self.r.choice([self.links(self.r.randint(2, 8)), self.tag("p", self.words(5, 60)) + self.links(2)])
        return self.tag(*self.r.choice([("aside", inner, ""), ("div", inner, self.attr("sidebar", "widget", "related", "popular", p=1))]))

    def advert(self) -> str:
        inner = self.words(3, 30) if self.odds(0.5) else self.tag("p", self.words(3, 40)) + (self.links(1) if self.odds(0.4) else "")
        return self.tag(self.r.choice(["div", "section", "aside", "p"]), inner, self.attr("ad", "ads", "advert", "banner", "promo", "sponsored", p=1))

    def notice(self) -> str:
        inner = self.tag("p", self.words(5, 50)) + ("<button>" + self.words(1, 2) + "</button>" if self.odds(0.6) else "")
        return self.tag(self.r.choice(["div", "section"]), inner, self.attr("cookie", "consent", "notice", "popup", "alert", p=1))

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3)}<input name=a></label>" for _ in range(self.r.randint(1, 3))) + self.tag("p", self.words(2, 20)) + "<button>Go</button>"
        inner = self.tag("form", inner)
        return self.tag("div", inner, self.attr("newsletter", "search", "subscribe", "login")) if self.odds(0.5) else inner

    def share(self) -> str:
        return self.tag(self.r.choice(["div", "ul", "p"]), self.links(self.r.randint(2, 4)), self.attr("share", "social", "tags", p=1))

    def comments(self) -> str:
        one = lambda: self.tag(self.r.choice(["div", "li", "article", "p"]), (self.tag("b", self.words(1, 2)) if self.odds(0.5) else "") + self.tag("p", self.words(3, 90)), self.attr("comment", "reply", p=0.7))
        inner = self.tag("h3", self.words(1, 3)) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.tag(self.r.choice(["div", "section", "ol"]), inner, self.attr("comments", "discussion", "responses", "comment-list", p=1))

    def boiler(self) -> str:
        return self.r.choice([self.menu, self.side, self.advert, self.notice, self.form, self.share, self.comments])()

    # main text

    def main(self, a: int, b: int) -> str:
        text = self.words(a, b)
        if self.odds(0.2):
            w = text.split(" ")
            k = self.r.randrange(len(w))
            w[k] = self.r.choice([f"<b>{w[k]}</b>", f'<a href="/x">{w[k]}</a>', f"<em>{w[k]}</em>", "&amp;", "&quot;" + w[k]])
            text = " ".join(w)
        return SIGN + text

    def paragraph(self) -> str:
        n = self.r.choice([(1, 3), (2, 12), (10, 60), (30, 120)])
        if self.odds(0.1):
            return "<p><b>" + self.main(*n) + "<br>"
        return self.tag("p", self.main(*n), self.attr("text", "intro", p=0.1), closed=0.85)

    def piece(self) -> str:
        k = self.r.random()
        if k < 0.72:
            return self.paragraph()
        if k < 0.8:
            return self.tag(self.r.choice(["h2", "h3"]), self.main(1, 8))
        if k < 0.86:
            return self.tag(self.r.choice(["ul", "ol"]), "".join(self.tag("li", self.main(1, 20), closed=0.8) for _ in range(self.r.randint(2, 6))))
        if k < 0.9:
            return self.tag("blockquote", self.paragraph() if self.odds(0.5) else self.main(5, 40))
        if k < 0.93:
            return self.tag("pre", self.main(3, 30))
        if k < 0.96:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.main(1, 4)) for _ in range(3))) for _ in range(self.r.randint(1, 4))))
        return self.tag("div", self.main(5, 60))

    def article(self) -> str:
        out = [self.tag("h1", self.main(1, 12))] if self.odds(0.8) else []
        for _ in range(self.r.choice([0, 1, 3, 8, 20]) or 1):
            out.append(self.piece())
            if self.odds(0.05):
                out.append(self.r.choice([self.advert, self.share, self.form, self.notice])())
        if self.odds(0.2):
            out.append(self.r.choice([self.comments, self.share, self.side])())
        inner = "".join(out)
        shell = self.r.choice(["article", "article", "main", "div", "section"])
        inner = self.tag(shell, inner, self.attr("content", "post", "article", "entry", "story", p=0.9 if shell == "div" else 0.3))
        if self.odds(0.3):
            inner = self.tag(self.r.choice(["div", "main", "section"]), inner, self.attr("main", "page", "wrap", "container", "content"))
        return inner

    def html(self) -> str:
        body = [self.article()]
        for make, p in ((self.menu, 0.6), (self.header, 0.4), (self.notice, 0.25), (self.advert, 0.5)):
            if self.odds(p):
                body.insert(self.r.randint(0, body.index(body[-1])), make())
        for make, p in ((self.side, 0.35), (self.comments, 0.35), (self.form, 0.2), (self.advert, 0.25), (self.boiler, 0.3)):
            if self.odds(p):
                body.append(make())
        if self.odds(0.85):
            body.append(self.footer())
        if self.odds(0.25):
            body = [self.tag("div", "".join(body), self.attr("page", "wrapper", "site"))]
        text = f'<!DOCTYPE html><html lang="xx"><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style></head><body>' + "".join(body)
        return text + ("</body></html>" if self.odds(0.9) else "")
