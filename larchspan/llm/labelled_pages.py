"""Labelled pages for the extraction model: page layouts written out here, filled with made-up words from a seed.

Each page comes with the ranges of its html that hold main text.  The layouts are of common kinds of sites (weblog,
newspaper, manual, old table layout, wiki, generated class names, a bare article); inside a layout the elements, class
names and optional parts vary, and optional end tags are left out now and then.
"""

from __future__ import annotations

import random

#: Syllables of the made-up words.
SYLLABLES = "ka lo mi ren tas ul bre no vi der sta pom li qua ze fro el gan dit or pes ha mun ti rel so wen cho".split()


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.html = ""
        self.main: list[tuple[int, int]] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        s = [self.word() for _ in range(self.r.randint(low, high))]
        if len(s) > 6 and self.r.random() < 0.5:
            s[3] += ","
        if self.r.random() < 0.1:
            s = [w + self.r.choice(["###", "***", "%%%", " |"]) for w in s]
        return " ".join(s).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def put(self, s: str, main: bool = False) -> None:
        if main:
            self.main.append((len(self.html), len(self.html) + len(s)))
        self.html += s

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def links(self, low: int = 2, high: int = 8) -> None:
        self.put("<ul>" if self.r.random() < 0.7 else "<div>")
        for _ in range(self.r.randint(low, high)):
            self.put(f'<li><a href="{self.pick("#", "/" + self.word() + "/", "https://example.net/" + self.word() + ".html")}">{self.phrase(1, 3).capitalize()}</a>' + self.pick("</li>", "</li>", ""))
        self.put("</ul>")

    def boxed(self, element: str, names: tuple[str, ...], fill) -> None:  # noqa: ANN001
        name = self.pick(*names)
        self.put(f'<{element} {self.pick("class", "class", "id")}="{name}">' if name else f"<{element}>")
        fill()
        self.put(f"</{element}>")

    def texts(self, low: int = 1, high: int = 3) -> None:
        for _ in range(self.r.randint(low, high)):
            s = " ".join(self.sentence(2, 14) for _ in range(self.r.randint(1, 3)))
            self.put(self.pick(f"<p>{s}</p>", f"<div>{s}</div>", s, f"<span>{s}</span>"))

    def chrome(self, p: float) -> None:
        """Adverts, notices, side columns and forms, each with chance p."""
        r = self.r
        if r.random() < p:
            self.boxed("div", ("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner-ad"), self.texts)
        if r.random() < p / 2:
            self.boxed("div", ("cookie-notice", "consent", "alert", "notice", "popup", "gdpr-banner"), self.texts)
        if r.random() < p / 2:
            self.boxed("aside", ("", "sidebar", "related", "widget"), lambda: (self.put(f"<h3>{self.phrase(1, 3)}</h3>"), self.links(), self.texts(0, 1)))
        if r.random() < p / 3:
            self.boxed("div", ("sidebar", "related-posts", "share", "newsletter", "social"), lambda: (self.texts(0, 1), self.links()))
        if r.random() < p / 2:
            self.boxed("form", ("", "search", "newsletter", "login-form"), lambda: self.put(f"<label>{self.phrase(1, 3)}</label><input><button>{self.phrase(1, 2)}</button><p>{self.sentence()}</p>"))

    def paragraph(self) -> str:
        r = self.r
        s = " ".join(self.sentence(1, 18) for _ in range(r.choice([1, 1, 1, 2, 3, 6])))
        mark = r.random()
        if mark < 0.1:
            return f"<strong>{s}</strong>"
        if mark < 0.25:
            return f'{s} <a href="{self.pick("#", "/x", "https://example.net/")}">{self.phrase(1, 3)}</a>{self.pick(".", ". " + self.sentence())}'
        return s if mark < 0.9 else f"<em>{self.phrase(1, 4)}</em> {s}"

    def body(self, level: int = 2, adverts: bool = True) -> None:
        """The running text under a heading."""
        r = self.r
        for i in range(r.randint(1, 14)):
            kind, s = r.random(), self.paragraph()
            if kind < 0.72:
                self.put(self.pick(f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}", f'<p class="{self.pick("lead", "intro", "text")}">{s}</p>'), True)
            elif kind < 0.8:
                self.put(f"<h{level}>{self.phrase(1, 6).capitalize()}</h{level}>", True)
            elif kind < 0.86:
                e = self.pick("ul", "ol")
                self.put(f"<{e}>" + "".join(f"<li>{self.sentence(2, 9)}{self.pick('</li>', '')}" for _ in range(r.randint(1, 4))) + f"</{e}>", True)
            elif kind < 0.9:
                self.put(f"<blockquote>{self.pick(s, '<p>' + s + '</p>')}</blockquote>", True)
            elif kind < 0.92:
                self.put(f"<pre>{self.phrase(2, 9)}\n  {self.phrase(1, 5)}</pre>", True)
            elif kind < 0.93:
                self.put(f"<table><tr><th>{self.phrase(1, 2)}</th><td>{self.phrase(1, 4)}</td></tr></table>", True)
            elif kind < 0.94:
                self.put(f"<div>{s}</div>", True)
            elif i and adverts:
                names = r.choice([("ad", "advert", "sponsored", "inline-promo"), ("advertisement", "ad-unit"), ("notice", "alert"), ("newsletter", "share-bar"), ("related", "widget")])
                self.boxed(self.pick("div", "div", "aside"), names, self.texts)

    def heading(self, level: int = 1) -> str:
        return f"<h{level}>{self.pick(self.sentence(3, 9), self.phrase(2, 9).capitalize())}</h{level}>"

    def comments(self) -> None:
        r = self.r
        one = self.pick('<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<li class="comment"><b>{w}</b> {}</li>', "<article><footer>{w}</footer><p>{}</p></article>")
        self.boxed(self.pick("section", "div", "ol"), ("comments", "comment-list", "disqus_thread", "reader-comments", "discussion", "replies"), lambda: [self.put(one.format(f"{self.sentence()} {self.sentence()}", w=self.word())) for _ in range(r.randint(1, 6))])

    def foot(self) -> None:
        own = self.pick("&copy; ", "Copyright ", "(c) ", "") + self.pick(str(self.r.randint(1999, 2030)), self.word().capitalize()) + self.pick(" - ", " | ", ". ", " &bull; ", " ") + self.sentence(2, 8)
        fill = lambda: (self.put(self.pick(own, f"<p>{own}</p>", f"<small>{own}</small>")), self.links(1, 5) if self.r.random() < 0.3 else None)
        self.boxed(self.pick("footer", "footer", "div"), ("footer", "site-footer", "copyright", "colophon", "page-bottom"), fill) if self.r.random() < 0.7 else (self.put("<footer>"), fill(), self.put("</footer>"))

    def menu(self) -> None:
        r = self.r
        if r.random() < 0.5:
            self.boxed(self.pick("nav", "nav", "div"), ("menu", "navbar", "main-nav", "breadcrumbs", "top-menu"), self.links)
        else:
            self.put("<nav>")
            self.links()
            self.put("</nav>")

    def top(self) -> None:
        self.boxed("header", ("", "masthead", "site-header", "branding"), lambda: (self.put(self.pick(f"<h2>{self.phrase(1, 4)}</h2>", f"<p>{self.phrase(1, 4)}</p>", f'<a href="/">{self.phrase(1, 3)}</a>')), self.texts(0, 1)))


def _weblog(p: _Page) -> None:
    p.top() if p.r.random() < 0.7 else None
    p.menu() if p.r.random() < 0.8 else None
    p.put(p.pick("<main>", '<div class="content">', '<div id="main">', ""))
    p.put(f'<article class="{p.pick("post", "hentry", "entry", "blog-post")}">')
    p.put(f'{p.pick("<header>", "<header class=entry-header>")}', False)
    p.put(p.heading(), True)
    p.put("</header>")
    p.boxed("div", ("entry-content", "post-body", "content", "post-content"), p.body)
    p.put("</article>")
    p.comments() if p.r.random() < 0.5 else None
    p.chrome(0.4)
    p.foot()


def _newspaper(p: _Page) -> None:
    p.chrome(0.4)
    p.top()
    p.menu()
    p.put(p.pick("<main>", "<div>"))
    opening = p.pick("<article>", '<div class="article-body">', '<div class="story">', '<section class="article">')
    p.put(opening)
    p.put(p.heading(), True)
    p.body()
    if p.r.random() < 0.4:
        p.boxed("aside", ("", "related", "more-stories", "inline-related"), p.links)
        p.put(f"<p>{p.paragraph()}</p>", True)
    p.comments() if p.r.random() < 0.2 else None
    p.put(f"</{opening[1:].split()[0].strip('>')}>")
    p.chrome(0.5)
    p.comments() if p.r.random() < 0.25 else None
    p.foot()


def _manual(p: _Page) -> None:
    p.menu()
    p.boxed(p.pick("aside", "div", "nav"), ("sidebar", "toc", "side-nav"), p.links)
    p.boxed(p.pick("main", "section", "div"), ("body", "article-content", "main-content", "content"), lambda: (p.put(p.heading(), True), p.body(p.r.choice([2, 3]), False)))
    p.boxed("div", ("pager", "pagination", "page-nav"), lambda: p.links(1, 2)) if p.r.random() < 0.5 else None
    p.foot()


def _tables(p: _Page) -> None:
    p.put('<table width="100%"><tr><td colspan=2 class="header">' + p.phrase(1, 4) + "</td></tr><tr><td>")
    p.links()
    p.put("</td><td>")
    p.put(p.heading(p.r.choice([1, 2])), True)
    for _ in range(p.r.randint(2, 8)):
        p.put(f"<p>{p.paragraph()}{p.pick('</p>', '')}", True)
    p.put('</td></tr><tr><td colspan=2 class="footer">' + p.pick("&copy; ", "Copyright ") + p.phrase(2, 6) + "</td></tr></table>")


def _wiki(p: _Page) -> None:
    p.boxed("div", ("content", "bodyContent", "mw-body"), lambda: (p.put(p.heading(), True), p.body(2, False)))
    p.boxed("div", ("mw-navigation", "navigation", "nav-panel"), p.links)
    p.boxed("div", ("cookie-banner", "notice", "site-notice"), p.texts) if p.r.random() < 0.5 else None
    p.foot()


def _generated(p: _Page) -> None:
    """Class names that say nothing, as style tools make them."""
    name = lambda: "css-" + "".join(p.r.choice("bcdfghjk0123456789") for _ in range(6))
    p.put(f'<div class="{name()}">')
    p.menu()
    p.put(f'<div class="{name()}">')
    p.put(p.heading(), True)
    p.body(2, False)
    p.put("</div>")
    p.chrome(0.3)
    p.put("</div>")
    p.foot()


def _bare(p: _Page) -> None:
    p.menu() if p.r.random() < 0.6 else None
    p.chrome(0.4)
    opening = p.pick("<article>", "<article>", "<main>", "")
    p.put(opening)
    p.put(p.heading(), True)
    p.body()
    p.comments() if p.r.random() < 0.25 else None
    p.put(opening.replace("<", "</"))
    p.chrome(0.3)
    p.foot() if p.r.random() < 0.85 else None


LAYOUTS = (_weblog, _newspaper, _manual, _tables, _wiki, _generated, _bare, _newspaper, _bare)


def page(seed: int) -> tuple[str, list[tuple[int, int]]]:
    """One page and the ranges of its main text."""
    p = _Page(seed)
    p.put(f'<!DOCTYPE html><html{p.pick("", " lang=en")}><head><title>{p.phrase(2, 8)}</title>{p.pick("", "<style>body{color:#222}</style>", "<script>window.q = 1 < 2;</script>")}</head><body>')
    p.r.choice(LAYOUTS)(p)
    p.put(p.pick("</body></html>", "</body></html>", ""))
    return p.html, p.main
