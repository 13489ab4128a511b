"""Labelled training pages: layouts written out with a label for every block.

The pages combine an article in one of several containers with the usual
furniture around and inside it, in invented words, so that the field learns from
tags, names and text alike.
"""

from __future__ import annotations

import random

# Names that page authors give to containers.
MAIN_NAMES = ("content", "post", "entry", "story", "article-body", "main-content", "post-content", "body-text", "page")
FURNITURE = (
    ("nav", ("menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "navigation", "pagination", "pager", "skip-links", "toc"), "links"),
    ("header", ("header", "masthead", "site-header", "topbar", "branding", "logo", "tagline"), "short"),
    ("footer", ("footer", "site-footer", "copyright", "legal", "bottom", "colophon"), "legal"),
    ("aside", ("sidebar", "related", "recommended", "popular", "trending", "widget", "tags", "more-stories", "aside"), "mixed"),
    ("div", ("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "sponsor", "adsense"), "prose"),
    ("div", ("cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "popup", "modal", "overlay", "disclaimer", "warning"), "prose"),
    ("form", ("newsletter", "subscribe", "login", "search", "signup", "contact-form", "form"), "form"),
    ("section", ("comments", "comment-list", "commentlist", "discussion", "responses", "replies", "disqus", "reviews"), "comments"),
    ("div", ("share", "social", "share-buttons", "follow", "author-bio", "byline", "meta"), "short"),
)


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.syllables = ["".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiouéü") for _ in range(1)) + rng.choice(["", "n", "r", "s", "t"]) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        words = [self.word() + ("," if self.rng.random() < 0.08 else "") for _ in range(self.rng.randint(least, most))]
        return " ".join(words).rstrip(",").capitalize() + self.rng.choice(["."] * 8 + ["?", "!"])

    def prose(self, least: int = 1, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> None:
        self.out.append(f"<{tag}{attrs}>{text}</{tag}>" if tag else text)
        self.labels.append(label)

    def named(self, name: str) -> str:
        kind = self.rng.choice(["class", "class", "id", ""])
        return f' {kind}="{name}"' if kind else ""

    def furniture(self, kind: tuple | None = None) -> None:
        rng = self.rng
        tag, names, style = kind or rng.choice(FURNITURE)
        plain = rng.random() < 0.35
        name = rng.choice(names)
        attrs = self.named(name) if not plain else f' class="{name}"'
        if plain:
            tag = "div"
        elif tag in ("div", "section") and not attrs:
            attrs = f' class="{name}"'
        self.out.append(f"<{tag}{attrs}>")
        if style == "links":
            self.out.append("<ul>")
            for _ in range(rng.randint(2, 8)):
                self.block("li", f'<a href="/{self.word()}">{self.word()}</a>', 0)
            self.out.append("</ul>")
        elif style == "short":
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(["div", "p", "h1", "h2", "a"]) if tag == "header" else "p", " ".join(self.word() for _ in range(rng.randint(1, 6))), 0)
                if self.out[-1].startswith("<a"):
                    self.out[-1] = "<div>" + self.out[-1] + "</div>"
        elif style == "legal":
            self.block(rng.choice(["", "p", "div"]), f"&copy; {self.word()} &middot; {self.prose(1, 3)}", 0)
        elif style == "form":
            self.block(rng.choice(["p", "label", "div", "h3"]), self.sentence(1, 8), 0)
            if self.out[-1].startswith("<label"):
                self.out[-1] = "<div>" + self.out[-1] + "</div>"
            self.out.append('<input type="text" name="q">')
            self.block("button", self.word(), 0)
        elif style == "comments":
            self.block("h3", self.sentence(1, 4), 0)
            for _ in range(rng.randint(1, 5)):
                self.block(rng.choice(["p", "div", "li"]), self.prose(1, 4), 0, self.rng.choice(["", ' class="comment"', ' class="reply"']))
        elif style == "mixed":
            self.block(rng.choice(["h2", "h3", "h4"]), self.sentence(1, 4), 0)
            for _ in range(rng.randint(1, 5)):
                self.block("li" if rng.random() < 0.6 else "p", f'<a href="#">{self.sentence(2, 9)}</a>' if rng.random() < 0.7 else self.prose(1, 2), 0)
        else:
            for _ in range(rng.randint(1, 2)):
                bare = self.out[-1].startswith("<") and not self.out[-1].startswith("</")  # two bare texts would be one block
                self.block(rng.choice(["", "p", "p"]) if bare else "p", self.prose(1, 4), 0)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        tag = rng.choice(["article"] * 4 + ["main", "div", "div", "section"])
        name = rng.choice(MAIN_NAMES)
        attrs = f' class="{name}"' if tag in ("div", "section") else self.named(name) if rng.random() < 0.4 else ""
        wrap = rng.choice(["", "", "", "main", "div"])
        self.out.append(f"<{wrap}>" * bool(wrap) + f"<{tag}{attrs}>")
        if rng.random() < 0.85:
            self.block(rng.choice(["h1", "h1", "h2"]), self.sentence(2, 10), 1)
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.66:
                self.block("p", self.prose(), 1)
            elif kind < 0.72:
                self.block("p", f"<b>{self.sentence()}", 1)
                self.out[-1] = self.out[-1].replace("</p>", "<br>")
            elif kind < 0.78:
                self.block(rng.choice(["h2", "h3", "h4"]), self.sentence(1, 6), 1)
            elif kind < 0.83:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.block("li", self.sentence(1, 14), 1)
                self.out.append("</ul>")
            elif kind < 0.87:
                self.block("blockquote", self.prose(1, 3), 1)
            elif kind < 0.9:
                self.out.append("<table><tr>")
                for _ in range(rng.randint(1, 4)):
                    self.block("td", self.word(), 1)
                self.out.append("</tr></table>")
            elif kind < 0.93:
                self.block("pre", self.sentence(1, 8), 1)
            elif kind < 0.95:
                self.out.append("<figure><img src='x'>")
                self.block("figcaption", self.sentence(2, 8), 1)
                self.out.append("</figure>")
            else:
                self.furniture(rng.choice(FURNITURE[3:]))
        self.out.append(f"</{tag}>" + f"</{wrap}>" * bool(wrap))


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """(html, label of every block in page order)."""
    rng = random.Random(seed)
    w = _Writer(rng)
    w.out.append(f"<!DOCTYPE html><html><head><title>{w.sentence()}</title><style>p{{}}</style></head><body>")
    for _ in range(rng.randint(0, 3)):
        w.furniture(rng.choice(FURNITURE[:7]))
    w.article()
    for _ in range(rng.randint(0, 3)):
        w.furniture()
    w.out.append("</body></html>")
    return "".join(w.out), w.labels
