"""A small set of labelled pages, made by rule: every container of main text with every kind of page furniture.

A labelled page is a list of (html, words of main text, other words) parts; only structure matters, so texts are fillers.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Containers of main text: how they open and close.
CONTAINERS = [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<main id="main"><article class="post">', "</article></main>"), ('<div class="content">', "</div>"),
    ('<div id="article-body">', "</div>"), ('<section class="entry">', "</section>"), ('<div class="post text">', "</div>"), ('<div class="story">', "</div>"), ("<div>", "</div>"), ("", ""),
]
#: Elements that are furniture by their name.
ELEMENTS = ["nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "noscript", "iframe"]
#: Words of class and id that mark furniture.
MARKS = [
    "ad", "ads", "adbox", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead",
    "topbar", "footer", "copyright", "sidebar", "aside", "widget", "related", "recommended", "teaser", "trending", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login", "search", "form", "share", "social", "comment", "comments", "reply", "respond", "disqus", "discussion", "pagination", "pager", "tags", "toolbar", "skip", "hidden", "paywall", "alert", "legal", "disclaimer",
    "posts", "user", "users", "reader", "readers", "replies", "reviews", "responses", "feedback", "thread", "opinions", "talkback", "guestbook",
]
#: Elements that occur in main text.
INLINE = ["<h1>{}</h1>", "<p>{}</p>", "<p><b>{}</b></p>", "<p><b>{}<br><p>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<p>{} <a href='/x'>word</a> {}</p>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]


def furniture() -> Iterator[str]:
    """Pieces of furniture, with a few words each."""
    for name in ELEMENTS:
        yield f"<{name}><ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul></{name}>"
        yield f"<{name}><p>some few words here</p></{name}>"
        yield f"<{name}><p>A whole sentence that others want to be read, and it goes on for a while.</p><p>And one more of them, said for the same reason.</p></{name}>"
        yield f"<{name}>(c) somebody or other, and what is said here is theirs to say.</{name}>"
    for mark in MARKS:
        yield f'<div class="{mark}">words that are not the text</div>'
        yield f'<section id="{mark}"><p>words of others</p><p>more of them, said at some length and again</p></section>'
    yield "<ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li><li><a href='/c'>three</a></li></ul>"
    yield "<p><a href='/a'>only a link</a></p>"
    yield "<div><a href='/a'>Ten things that others have written about this and that</a></div><div><a href='/b'>Another long title of some other text.</a></div>"
    yield "<p>© 2019 by somebody, and all that is said here is theirs.</p>"
    yield "<div>Copyright by some name or other, all rights reserved.</div>"


def series(name: str) -> str:
    """What readers have said, in like containers without telling names."""
    said = "and here is what a reader has to say about it, at some length and more than once."
    return f"<{name}>" + "".join(f"<div><p>reader {k}</p><p>{said}</p></div>" for k in range(4)) + f"</{name}>"


#: Short blocks and sections of main text, which content alone must not give away.
SHORT_MAIN = ["<h2>few words</h2>", "<ul><li>apples</li><li>pears</li></ul>", "<p>So be it</p>", "<table><tr><td>one</td><td>two</td></tr></table>"]


def unmarked() -> Iterator[list[tuple[str, bool]]]:
    """Pages whose elements have no telling names, so that only content and position tell."""
    words = "the quick words of a text that goes on and on for some while."
    body = [(form.replace("{}", words), True) for form in INLINE]
    short = [(form, True) for form in SHORT_MAIN]
    section = [(f"<div><h2>part {k}</h2><p>{words}</p><p>{words}</p></div>", True) for k in range(4)]
    for inner in (body, [*body[:3], *short, *body[3:]], section, [*body[:2], *section, *body[2:]]):
        yield [("<body><table><tr><td>Home About us Contact</td><td>", False), *inner, ("</td></tr><tr><td>Copyright 2020 Some Name</td></tr></table></body>", False)]
        yield [("<body><div>Home</div><div>News</div><div>Shop now</div><div>", False), *inner, ("</div><div>© 2021 all rights reserved</div></body>", False)]
        yield [("<body><div>", False), *inner, ("</div>" + series("div") + "</body>", False)]
        yield [("<body><ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul>", False), *inner, (series("section") + "<p><a href='/c'>more of this</a></p></body>", False)]


def pages() -> Iterator[list[tuple[str, bool]]]:
    """Pages as parts of (html, is main text); joined, the parts are the page."""
    yield from unmarked()
    pieces = list(furniture())
    words = "the quick words of a text that goes on and on for some while"
    for k, (opened, closed) in enumerate(CONTAINERS):
        body = [(form.replace("{}", words), True) for form in INLINE]
        for j in range(0, len(pieces), 3):
            out = pieces[j : j + 3]
            inside = [(p, False) for p in out if k < len(CONTAINERS) - 2 and not p.startswith(("<ul", "<p"))]
            yield [("<html><body>", False), *((p, False) for p in out), (opened, False), *body[:4], *inside, *body[4:], (closed, False), *((p, False) for p in reversed(out)), ("</body></html>", False)]
        if opened:
            yield [("<html><body>", False), (f"{opened}<header>", False), (f"<h1>{words}</h1>", True), ("</header>", False), *body, (f"{closed}</body></html>", False)]
