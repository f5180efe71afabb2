"""Labelled pages made from a rule and a seed: what the block labeller learns from.

A page is a random order of regions, each of a kind: the article, or one of the regions
around it. Words are made of random syllables, so that the labeller learns tag paths, names,
shapes and the usual words of menus and notices, not a topic.
"""

from __future__ import annotations

import random

#: Names that web pages give to regions, stated plainly.
AROUND = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav sitenav pagination pager tabs toc",
    "header": "header masthead topbar branding logo banner site-header tagline",
    "footer": "footer site-footer bottom copyright colophon legal foot credits",
    "aside": "sidebar side widget related recommended popular trending rail more-stories tags archive author-bio",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall privacy message",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox commercial partner",
    "form": "form search login signin register contact feedback poll searchbox",
    "comments": "comments comment commentlist replies reply responses discussion disqus thread user-comments",
    "share": "share social sharing follow buttons toolbar tools print",
}
WORDS = {
    "nav": "Home About Contact News Products Services Blog Archive Next Previous Menu Help FAQ",
    "header": "Welcome Menu Home Your daily source Search Login Toggle navigation",
    "footer": "© Copyright 2024 All rights reserved Privacy Policy Terms Imprint Powered by Contact",
    "aside": "Related articles Popular posts Recent Tags Read more See also Most viewed",
    "notice": "We use cookies to improve your experience Accept Decline Subscribe to our newsletter This site privacy settings",
    "ad": "Advertisement Sponsored Buy now Sale discount offer Click here Shop today limited",
    "form": "Name Email Password Search Submit Send Your message Remember me Sign in Register",
    "comments": "Comments Reply says posted by ago Report Like Leave a comment Anonymous user great thanks I agree",
    "share": "Share Tweet Facebook Email Print Follow us Like",
}
MAIN = "content article post entry story body main text page post-content entry-content article-body story-body maincontent"
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouäéñ") + self.r.choice(["", "n", "r", "s", "th"])) for _ in range(60)]
        self.out: list[str] = []
        self.marks: list[tuple[int, bool]] = []

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, kind: str | None = None) -> str:
        usual = WORDS[kind].split() if kind else []
        share = self.r.choice([0.0, 0.5, 0.9]) if usual else 0.0
        return " ".join(self.r.choice(usual) if self.r.random() < share else self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 60, kind: str | None = None) -> str:
        return self.words(low, high, kind).capitalize() + "."

    def odd(self) -> str:
        """Prose that does not look like prose: capitals, marks, cells, codes, licence lines, one word."""
        r = self.r
        text = self.words(1, 60)
        return r.choice([
            lambda: text.upper().replace(" ", "!! "), lambda: text.replace(" ", " | "), lambda: text.replace(" ", r.choice([", ", "%%% ", "*** ", " - "])), lambda: text.split()[0].capitalize() + ".",
            lambda: f"{self.word()} = {r.getrandbits(120):x}", lambda: f"{self.sentence(2, 9)} " + r.choice(["All rights reserved.", "This work is licensed under a free licence.", "Copyright 2024.", "Contact us.", "Read more."]),
            lambda: " ".join([text.split()[0].capitalize()] * r.randint(3, 60)), lambda: " ".join([self.sentence(1, 3)] * r.randint(3, 200)), lambda: " ".join(self.sentence(1, 3) for _ in range(r.randint(2, 30))), lambda: f"{self.word()}@{self.word()}.com {r.randint(100, 99999)}-{r.randint(100, 99999)}",
        ])()

    def name(self, names: str, chance: float = 0.9) -> str:
        if self.r.random() > chance:
            return f' class="{self.word()}"' if self.r.random() < 0.3 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names.split())}"'

    def block(self, tag: str, text: str, main: bool, attributes: str = "") -> str:
        return f"<{tag}{attributes}>\x00{int(main)}{text}</{tag}>"

    def article(self) -> str:
        r = self.r
        out = [self.block("h1", self.odd()[:60].strip() if r.random() < 0.2 else self.words(1, 12), True)] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.78:
                text = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 6])))
                if r.random() < 0.2:
                    text = self.odd()
                if r.random() < 0.15:
                    text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
                if r.random() < 0.15:
                    text += f' <a href="/x">{self.words(1, 3)}</a> {self.sentence(2, 9)}'
                out.append(self.block("p", text, True) if r.random() < 0.85 else f"<p>\x001{text}")
            elif x < 0.85:
                out.append(self.block(r.choice(["h2", "h3"]), self.words(2, 8), True))
            elif x < 0.9:
                out.append("<ul>" + "".join(self.block("li", self.sentence(2, 15), True) for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.94:
                out.append("<blockquote>" + self.block("p", self.sentence(5, 40), True) + "</blockquote>")
            elif x < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.words(1, 4), True) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                out.append(self.around(r.choice(["ad", "share", "notice"])))
        tag = r.choice(["article", "article", "main", "div", "section"])
        body = f"<{tag}{self.name(MAIN, 0.95 if tag in ('div', 'section') else 0.4)}>" + "".join(out) + f"</{tag}>"
        return f"<main>{body}</main>" if r.random() < 0.2 else body

    def around(self, kind: str) -> str:
        r = self.r
        tag = r.choice(TAGS[kind])
        certain = tag in ("nav", "header", "footer", "aside", "form")
        out = []
        for _ in range(r.randint(1, 3)):
            x = r.random()
            if kind == "nav" or x < 0.25:
                out.append("<ul>" + "".join(f'<li><a href="/x">\x000{self.words(1, 3, kind)}</a></li>' for _ in range(r.randint(3, 9))) + "</ul>")
            elif x < 0.5:
                out.append(f"<{(t := r.choice(['p', 'div', 'span']))}>\x000{self.sentence(2, 30, kind)}</{t}>")
            elif x < 0.8:
                out.append(f"\x000{self.words(2, 20, kind)}.")
            elif x < 0.9:
                out.append(self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 5, kind), False))
            else:
                out.append(f'<a href="/y">\x000{self.words(1, 6, kind)}</a>')
        if kind == "form":
            out.append(f'<label>\x000{self.words(1, 2, kind)}</label><input name="q"><button>Go</button>')
        if kind == "comments":
            inner = "".join(f'<{(t := r.choice(["li", "div", "article"]))}{self.name("comment reply user-comment", 0.8)}>' + self.block("p", " ".join(self.sentence(2, 25, kind) for _ in range(r.randint(1, 3))), False) + f"</{t}>" for _ in range(r.randint(1, 6)))
            out.append(inner)
        return f"<{tag}{self.name(AROUND[kind], 0.4 if certain else 1.0)}>" + "".join(out) + f"</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [self.around(k) for k in ("header", "nav", "notice", "ad", "form", "share") if r.random() < 0.45]
        after = [self.around(k) for k in ("aside", "comments", "share", "ad", "nav", "notice", "form", "footer") if r.random() < (0.8 if k == "footer" else 0.4)]
        r.shuffle(before)
        if r.random() < 0.2:
            before.append(self.around("aside"))
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.4:
            body = f'<div{self.name("wrapper container page site row layout", 0.8)}>{body}</div>'
        return f"<html><head><title>\x000{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labelled(n: int, seed: int = 5) -> list[list[tuple]]:
    """n pages as lists of (block, whether it is of the article)."""
    from .html import blocks

    out = []
    for k in range(n):
        page, last = [], False
        for b in blocks(_Maker(seed * 100_003 + k).page()):
            if "\x00" in b.text:
                last = b.text[b.text.index("\x00") + 1] == "1"
                b.text = b.text.replace("\x000", "").replace("\x001", "")
            if b.text.strip():
                page.append((b, last))
        out.append(page)
    return out
