"""Labelled pages to fit the page model on: layouts of common sites, composed by rule.

``data-main="1"`` marks an element whose text is main text, ``"0"`` one inside
it that is not. A page is made of parts that are drawn with a seed of their
own, so the same number of pages is the same pages. The ``pages`` table carries
no labels; pages labelled by hand can be given to the model in place of these
or beside them.
"""

from __future__ import annotations

import random

SYLLABLES = ("ka", "lo", "mi", "ren", "tas", "ul", "bo", "ne", "shi", "or", "da", "pel", "qu", "en", "ti", "ga")
# Parts of a page that are no main text: tags, and words that their classes and ids are made of.
OTHER_PARTS = {
    "nav": (("nav", "nav", "div", "ul", "aside", "menu"), ("nav", "navbar", "navigation", "menu", "mainmenu", "topnav", "links", "breadcrumb", "breadcrumbs", "tabs", "toc", "categories")),
    "header": (("header", "header", "div", "table"), ("header", "masthead", "site", "top", "topbar", "branding", "logo", "banner", "hero", "tagline", "head", "skip")),
    "footer": (("footer", "footer", "div", "section", "table"), ("footer", "foot", "bottom", "copyright", "legal", "colophon", "imprint", "credits", "disclaimer")),
    "sidebar": (("aside", "aside", "div", "section", "td"), ("sidebar", "side", "aside", "rail", "widget", "widgets", "related", "recommended", "popular", "trending", "latest", "teaser", "archive", "tagcloud", "tags", "more", "profile", "bio")),
    "advert": (("div", "div", "aside", "section", "ins", "p"), ("ad", "ads", "advert", "advertisement", "adsbox", "sponsor", "sponsored", "promo", "promotion", "banner", "dfp", "commercial", "affiliate", "outbrain", "taboola", "offer")),
    "notice": (("div", "div", "section", "dialog", "aside"), ("cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "privacy", "paywall", "announcement", "warning", "message", "toast")),
    "form": (("form", "form", "div", "section", "fieldset"), ("form", "search", "login", "signin", "signup", "newsletter", "subscribe", "subscription", "register", "contact", "mailing", "poll")),
    "share": (("div", "ul", "div", "section"), ("share", "sharing", "social", "follow", "toolbar", "tools", "actions", "buttons", "like", "meta", "print")),
    "comments": (("section", "div", "div", "ol", "aside", "article"), ("comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "responses", "reader", "readers", "feedback", "thread", "reviews")),
    "pager": (("div", "nav", "ul", "p"), ("pagination", "pager", "paging", "prev", "next", "previous", "page-numbers")),
}
# Words of classes and ids of main text, of what stands in it, and of what wraps all.
MAIN_WORDS = ("article", "content", "main", "post", "entry", "story", "text", "body", "prose", "markdown", "news", "blog", "maincontent", "articlebody", "document", "page")
INNER_WORDS = ("title", "headline", "lead", "intro", "summary", "paragraph", "section", "caption", "quote", "chapter", "subtitle", "byline", "date", "author", "p", "text")
OUTER_WORDS = ("wrapper", "wrap", "container", "site", "layout", "row", "col", "column", "inner", "outer", "grid", "app", "root", "flex", "center")


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.known = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(60)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.known, k=self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.r.choice("....!?") for _ in range(self.r.randint(low, high)))

    def named(self, words: tuple[str, ...], often: float = 0.85) -> str:
        """Attributes whose class or id is made of one or two of the words, at times with a word that says nothing."""
        if self.r.random() > often:
            return self.r.choice(("", f' class="x{self.r.randint(0, 999)}"'))
        name = self.r.choice(("-", "_", " ")).join(self.r.sample(words, self.r.choice((1, 1, 2))))
        if self.r.random() < 0.3:
            name += f" x{self.r.randint(0, 999)}"
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(0, 99)}">{self.words(low, high)}</a>'

    def links(self) -> str:
        n = self.r.randint(2, 9)
        return self.r.choice(
            (
                "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>",
                "".join(f"<li>{self.link()}" for _ in range(n)),
                " | ".join(self.link() for _ in range(n)),
                "".join(f"<div>{self.link()}</div>" for _ in range(n)),
                "".join(f"<p>{self.link(2, 9)}</p>" for _ in range(n)),
            )
        )

    def stuff(self, kind: str) -> str:
        """What stands in a part that is no main text: links, a few words, at times whole sentences."""
        if kind in ("nav", "pager", "share"):
            return self.links()
        if kind == "comments":
            one = lambda: f"<{(t := self.r.choice(('div', 'li', 'p', 'article')))}{self.named(('comment', 'reply', 'author', 'body', 'text'), 0.6)}><b>{self.words(1, 2)}</b> <p>{self.sentences(1, 5)}</p></{t}>"
            return f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 6)))
        if kind == "form":
            return f"<label>{self.words(1, 4)}</label><input name=q>{self.words(0, 8)}<button>{self.words(1, 2)}</button>" + self.r.choice(("", f"<p>{self.sentences(1, 2)}</p>"))
        if kind == "footer":
            return f"{self.r.choice(('&copy; ', '', ''))}{self.sentences(1, 3)}" + self.r.choice(("", self.links()))
        return self.r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.words(2, 12)} {self.link()}</p>", self.links(), self.sentences(2, 9)))

    def other(self, kind: str, mark: bool = False) -> str:
        tags, words = OTHER_PARTS[kind]
        tag = self.r.choice(tags)
        # a plain division says by its name what it is
        plain = tag in ("div", "section", "p", "td", "table", "ul", "ol", "article")
        body = self.stuff(kind)
        body = f"<tr><td>{body}</td></tr>" if tag == "table" else body
        if self.r.random() < 0.25 and tag != "p":
            body = f"<div{self.named(words, 0.5)}>{body}</div>"
        tag = "div" if tag == "td" else tag
        return f"<{tag}{' data-main=0' if mark else ''}{self.named(words, 1.0 if plain else 0.5)}>{body}</{tag}>"

    def block(self) -> str:
        p = self.r.random()
        name = self.named(INNER_WORDS, 0.25)
        if p < 0.66:
            text = self.r.choice((self.sentences(1, 1), self.sentences(1, 6), self.sentences(3, 12), self.words(1, 3).capitalize() + ".", self.words(1, 12)))
            if self.r.random() < 0.25:
                text += f" {self.link()} {self.sentences(1, 2)}"
            return self.r.choice((f"<p{name}>{text}</p>", f"<p{name}>{text}", f"<p><b>{text}<br>", f"<p{name}>{text}</p>", f"<div{name}>{text}</div>"))
        if p < 0.78:
            return f"<h{(n := self.r.randint(1, 4))}{name}>{self.words(1, 9)}</h{n}>"
        if p < 0.86:
            items = "".join(f"<li>{self.r.choice((self.sentences(1, 2), self.words(1, 6), self.link(1, 6)))}</li>" for _ in range(self.r.randint(1, 6)))
            return f"<{(t := self.r.choice(('ul', 'ol')))}{name}>{items}</{t}>"
        if p < 0.9:
            return f"<blockquote{name}>{self.r.choice((self.sentences(1, 3), f'<p>{self.sentences(1, 3)}</p>'))}</blockquote>"
        if p < 0.93:
            return f"<pre>{self.words(3, 30)}</pre>"
        if p < 0.96:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4)))
            return f"<table{name}>{rows}</table>"
        return f"<figure><img src=x.png><figcaption>{self.words(2, 12)}</figcaption></figure>"

    def inside(self) -> str:
        """The blocks of the main text, with what interrupts it."""
        parts = [self.block() for _ in range(self.r.choice((1, 2, 4, 8, 16)))]
        title = f"<h1{self.named(('title', 'headline', 'entry'), 0.3)}>{self.words(2, 10)}</h1>"
        if self.r.random() < 0.6:
            parts.insert(0, self.r.choice((title, f"<header{self.named(('entry', 'article', 'post'), 0.4)}>{title}<p>{self.words(2, 6)}</p></header>")))
        if self.r.random() < 0.3:
            parts = [f"<section{self.named(INNER_WORDS, 0.4)}>{''.join(parts[:3])}</section>", *parts[3:]]
        for kind in ("advert", "share", "sidebar", "form", "notice", "nav"):
            if self.r.random() < 0.15:
                parts.insert(self.r.randint(1, len(parts)), self.other(kind, mark=True))
        if self.r.random() < 0.15:
            parts.append(self.other("comments", mark=True))
        if self.r.random() < 0.1:
            parts.append(self.other("footer", mark=True))
        return "".join(parts)

    def main(self) -> str:
        tag = self.r.choice(("article", "article", "main", "div", "div", "section", "td"))
        name = self.named(MAIN_WORDS, {"article": 0.4, "main": 0.4}.get(tag, 1.0))
        if tag == "td":
            return f"<table><tr><td data-main=1{name}>{self.inside()}</td></tr></table>"
        if tag in ("article", "main") and self.r.random() < 0.3:
            return f"<{tag} data-main=1{name}><div{self.named(MAIN_WORDS)}>{self.inside()}</div></{tag}>"
        return f"<{tag} data-main=1{name}>{self.inside()}</{tag}>"

    def page(self) -> str:
        bare = self.r.random() < 0.25
        some = lambda kinds, share: [self.other(k) for k in kinds if not bare and self.r.random() < share]
        before, after = some(("notice", "header", "nav", "advert", "form"), 0.4), some(("share", "pager", "comments", "sidebar", "advert", "form", "footer"), 0.4)
        middle = self.main()
        if self.r.random() < 0.06:
            # paragraphs straight in the body
            middle = "".join(f"<p data-main=1>{self.sentences(1, 8)}</p>" for _ in range(self.r.randint(1, 8)))
        if self.r.random() < 0.3:
            middle = f"<div{self.named(OUTER_WORDS)}>{middle}{''.join(some(('sidebar', 'share', 'comments'), 0.4))}</div>"
        if self.r.random() < 0.2:
            middle = f"<main>{middle}{''.join(some(('sidebar', 'comments', 'advert'), 0.3))}</main>"
        body = "".join([*before, middle, *after])
        if self.r.random() < 0.4:
            body = f"<div{self.named(OUTER_WORDS)}>{body}</div>"
        if self.r.random() < 0.03:
            body = f"<form>{body}</form>"
        if self.r.random() < 0.04:
            body = f"<p data-main=1>{self.sentences(1, 5)}</p>" * self.r.randint(1, 4)
        if self.r.random() < 0.12:
            # what is kept of a page is at times its body's inside alone
            return body
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int = 900, seed: int = 5) -> list[str]:
    return [_Maker(1_000_003 * seed + i).page() for i in range(n)]
