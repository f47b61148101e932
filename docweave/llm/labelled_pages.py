"""Labelled pages to train extraction on: varied layouts of invented text, the main part marked."""

from __future__ import annotations

import random

from .pages import LABEL

TRAIN_PAGES = 600

_PARTS = "an be con der el fi ga ho in ja ker lo men ne or pa qui re sta the un ver wa ze".split()
MAIN_BOXES = (
    "<article {m}>|</article>", "<main {m}>|</main>", '<div class="content" {m}>|</div>',
    '<div id="main-content" {m}>|</div>', '<div class="post entry" {m}>|</div>',
    '<section class="article-body" {m}>|</section>', '<div class="story text" {m}>|</div>',
    "<main><article {m}>|</article></main>", '<div class="page"><article class="post" {m}>|</article></div>',
    '<div class="wrapper"><div role="main" {m}>|</div></div>', "<div {m}>|</div>",
)
# The words that pages use for what is not their main text.
LIST_WORDS = "nav menu navbar navigation topnav breadcrumb breadcrumbs links related share social tags pagination pager toc".split()
AD_WORDS = "ad ads advert advertisement adslot sponsor sponsored promo promotion banner teaser".split()
NOTICE_WORDS = "notice cookie consent gdpr alert warning disclaimer message announcement popup modal overlay".split()
SIDE_WORDS = "sidebar aside widget newsletter subscribe signup secondary complementary trending popular author bio".split()
HEADER_WORDS = "header masthead top branding logo site-header".split()
FOOTER_WORDS = "footer bottom copyright legal site-footer colophon".split()
COMMENT_WORDS = "comments comment replies responses discussion comment-list comments-area disqus reviews".split()
COMMENTS = (
    '<article class="comment"><p>|</p></article>', '<li class="comment">|</li>', '<div class="reply"><p>|</p></div>',
    '<div class="comment-body"><b>{n}</b><p>|</p></div>', "<p>|</p>", "<div>|</div>", "<blockquote>|</blockquote>",
)


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        pick = self.random
        made = ["".join(pick.choices(_PARTS, k=pick.randint(1, 3))) for _ in range(pick.randint(low, high))]
        return " ".join(made)

    def sentences(self, count: int) -> str:
        return " ".join(
            self.words(1, 14).capitalize() + self.random.choice("....?!") for _ in range(count)
        )

    def inside(self, boxes: tuple[str, ...], text: str) -> str:
        before, _, after = self.random.choice(boxes).partition("|")
        return before.replace("{n}", self.words(1, 2)) + text + after

    def boxed(self, words: list[str], tags: tuple[str, ...], text: str) -> str:
        """An element that one of the words names, alone or among others, by class, id or role."""
        pick = self.random
        name = pick.choice(words)
        kind = pick.random()
        if kind < 0.3:
            name += pick.choice(("-box", "_area", "-wrap", " block", " section", "1", "Container", " clearfix"))
        elif kind < 0.4:
            name = f"{pick.choice(('site', 'page', 'main', 'post'))}-{name}"
        elif kind < 0.5:
            name += " " + pick.choice(words)
        where = pick.choice(("class", "class", "class", "id", "role"))
        hidden = " hidden" if pick.random() < 0.05 else ""
        tag = pick.choice(tags)
        if tag == "p" and "<p>" in text:  # a paragraph cannot hold another
            tag = "div"
        return f'<{tag} {where}="{name}"{hidden}>{text}</{tag}>'

    def links(self) -> str:
        shape = self.random.choice(('<li><a href="/x">{}</a></li>', '<a href="/x">{}</a> ', "<li>{}</li>"))
        return "".join(shape.format(self.words(1, 4)) for _ in range(self.random.randint(2, 8)))

    def form(self) -> str:
        return (
            f'<form class="{self.random.choice(("search", "login", "contact", ""))}"><label>{self.words(1, 3)}</label>'
            f"<input name=q><p>{self.sentences(1)}</p><button>{self.words(1, 2)}</button></form>"
        )

    def comments(self) -> str:
        rows = [self.inside(COMMENTS, self.sentences(self.random.randint(1, 4))) for _ in range(self.random.randint(1, 5))]
        if self.random.random() < 0.3:
            rows.insert(0, f"<h3>{self.words(1, 3)}</h3>")
        if self.random.random() < 0.3:
            rows.append(self.form())
        return self.boxed(COMMENT_WORDS, ("section", "div", "div", "ol", "aside"), "".join(rows))

    def side(self) -> str:
        kind = self.random.random()
        if kind < 0.05:
            return f"<noscript>{self.text_inside()}</noscript>"
        if kind < 0.12:
            return f"<nav><ul>{self.links()}</ul></nav>"
        if kind < 0.3:
            return self.boxed(LIST_WORDS, ("div", "ul", "section", "nav", "aside"), self.links())
        if kind < 0.4:
            return f"<aside><h3>{self.words(1, 3)}</h3>{self.text_inside()}</aside>"
        if kind < 0.88:
            words = self.random.choice((AD_WORDS, AD_WORDS, NOTICE_WORDS, NOTICE_WORDS, SIDE_WORDS))
            return self.boxed(words, ("div", "div", "div", "section", "aside", "p"), self.text_inside())
        return self.form()

    def text_inside(self) -> str:
        text = self.sentences(self.random.randint(1, 4))
        return f"<p>{text}</p>" if self.random.random() < 0.4 else text

    def paragraph(self) -> str:
        kind, text = self.random.random(), self.sentences(self.random.choice((1, 1, 1, 2, 3, 6, 10)))
        if self.random.random() < 0.25:
            # Text without sentences: lists, rows of symbols, single words.
            text = self.words(1, 12).replace(" ", self.random.choice((" ", " ", " | ", "### ", "!! ")))
        if kind < 0.75:
            opening = self.random.choice(("<p>", "<p>", "<p>", "<p><b>", '<p class="text">'))
            return opening + text + self.random.choice(("</p>", "</p>", "<br>", ""))
        if kind < 0.8:
            return f"<h2>{self.words(2, 8)}</h2>"
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{self.sentences(1)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.91:
            return f"<pre>{text}</pre>"
        if kind < 0.92:
            return f'<object data="/z"><p>{text}</p></object>'
        if kind < 0.94:
            return f"<table><tr><td>{self.words(1, 6)}<td>{self.words(1, 9)}</table>"
        if kind < 0.97:
            return f'<p>{self.words(2, 9)} <a href="/y">{self.words(1, 5)}</a> {self.words(1, 9)}.</p>'
        return f"<div>{text}</div>"

    def page(self) -> str:
        chance = self.random.random
        body = [f"<h1>{self.words(2, 12).capitalize()}</h1>"] if chance() < 0.8 else []
        for _ in range(self.random.randint(1, 12)):
            body.append(self.paragraph())
            if chance() < 0.2:
                # Not of the article, though it stands within.
                body.append(f"<!--out-->{self.side()}<!--in-->")
        if chance() < 0.2:
            body.append(f"<!--out-->{self.comments()}<!--in-->")
        box = self.random.choice(MAIN_BOXES)
        before, _, after = box.partition("|")
        main = "".join(self.marked(body))
        parts = [f"<nav><ul>{self.links()}</ul></nav>"] if chance() < 0.6 else []
        if chance() < 0.5:
            parts.append(self.boxed(LIST_WORDS, ("div", "ul"), self.links()))
        if chance() < 0.5:
            inner = self.words(1, 4) if chance() < 0.5 else f"<h2>{self.words(1, 5)}</h2><p>{self.sentences(1)}</p>"
            parts.append(
                f"<header>{inner}</header>" if chance() < 0.5 else self.boxed(HEADER_WORDS, ("div", "section"), inner)
            )
        parts += [self.side() for _ in range(self.random.randint(0, 3))]
        parts.append(before.replace("{m}", "") + main + after)
        if chance() < 0.4:
            parts.append(self.comments())
        parts += [self.side() for _ in range(self.random.randint(0, 2))]
        if chance() < 0.85:
            inner = f"{self.sentences(self.random.randint(1, 2))}"
            if chance() < 0.6:
                inner = f"&copy; {self.words(1, 4)} &middot; {inner}"
            parts.append(f"<footer>{inner}</footer>" if chance() < 0.6 else self.boxed(FOOTER_WORDS, ("div",), inner))
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join(parts)}</body></html>"

    def marked(self, body: list[str]) -> list[str]:
        """Each piece of the article with the mark on its first tag; pieces that are not of it without."""
        marked = []
        for piece in body:
            if piece.startswith("<!--out-->"):
                marked.append(piece)
            else:
                tag, _, rest = piece.partition(">")
                marked.append(f"{tag} {LABEL}>{rest}")
        return marked


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 11) -> list[str]:
    """Pages with the attribute LABEL on what belongs to the main text."""
    return [_Writer(seed * 100_003 + i).page() for i in range(count)]
