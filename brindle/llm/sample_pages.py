"""Invented pages with known main text, to train the block labeller on."""

from __future__ import annotations

import random

MAIN = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"),
    ('<div class="post-body">', "</div>"), ('<div class="article-body entry">', "</div>"), ('<section class="story">', "</section>"), ('<article class="post">', "</article>"),
    ('<div id="main"><div class="text">', "</div></div>"), ("<div>", "</div>"),
]
AROUND = {
    "top": ["<header>{t}</header>", '<div class="header">{t}</div>', '<header class="site-header"><div>{t}</div></header>'],
    "menu": ["<nav><ul>{l}</ul></nav>", '<div class="menu"><ul>{l}</ul></div>', '<ul class="nav">{l}</ul>', '<div id="navigation">{l}</div>', '<div class="breadcrumb">{l}</div>'],
    "ad": ['<div class="ad">{t}</div>', '<div class="ads banner">{t}</div>', '<div class="advert"><p>{t}</p></div>', '<div class="promo">{t}</div>', '<aside class="sponsored">{t}</aside>'],
    "notice": ['<div class="cookie-notice">{n}</div>', '<div id="consent"><p>{n}</p></div>', '<div class="notice">{n}</div>', '<div class="popup newsletter">{n}</div>', '<div role="alert">{n}</div>'],
    "side": ["<aside><h3>{s}</h3><ul>{l}</ul></aside>", '<div class="sidebar"><h3>{s}</h3><p>{t}</p></div>', '<div id="sidebar">{l}</div>', '<div class="related"><h4>{s}</h4><ul>{l}</ul></div>', '<div class="widget">{t}</div>', '<div class="share">{l}</div>'],
    "form": ["<form><label>{s}</label><input name=q><button>{s}</button></form>", '<form class="search"><p>{n}</p><button type=submit>{s}</button></form>', '<div class="login"><form><label>{s}</label></form></div>'],
    "talk": ['<div class="comments"><h3>{s}</h3>{c}</div>', '<section id="comments"><ol>{c}</ol></section>', '<div id="comment-list">{c}</div>', '<ul class="replies">{c}</ul>', '<div class="discussion responses">{c}</div>'],
    "foot": ["<footer>&copy; {s} &middot; {t}</footer>", '<div class="footer"><p>{t}</p>{l}</div>', '<div id="footer">&copy; {s}</div>', "<footer><p>{t}</p><ul>{l}</ul></footer>"],
}
NOTICES = ["We use cookies to improve this site. Accept all", "Subscribe to our newsletter", "Please log in to continue", "This site uses cookies.", "Sign up for updates by email"]
SHORT = ["Home", "About", "Contact", "Search", "Login", "Share", "More", "Related", "Comments", "Reply", "Tags", "Archive", "Menu", "Next", "Privacy", "Terms"]
CLASSES = ["row", "col", "container", "wrapper", "inner", "grid", "flex", "layout", "mt", "px", "w", "block", "component", "module", "box", "md", "lg"]
SYLLABLES = "an ber ci da el fo gu hi is jo ka lem mi no or pa qui re su ti und ver wo xe yl za the and of de la".split()


def page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and whether each block of it, in page order, is main text."""
    marks: list[bool] = []

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(rng.randrange(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        text = words(lo, hi).capitalize()
        style = rng.random()
        if style < 0.08:
            text = text.upper().replace(" ", "!! ")
        elif style < 0.14:
            text = text.replace(" ", " | ")
        elif style < 0.2:
            text = text.replace(" ", "*** ")
        return text + rng.choice([".", ".", ".", "!", "?", ""])

    def around(kind: str) -> str:
        shape = rng.choice(AROUND[kind])
        out = ""
        for piece in _split(shape):
            if piece == "{t}":
                out += sentence(3, 25)
            elif piece == "{n}":
                out += rng.choice(NOTICES)
            elif piece == "{s}":
                out += rng.choice([rng.choice(SHORT), words(1, 3)])
            elif piece == "{l}":
                out += "".join(f'<li><a href="/{k}">{rng.choice([rng.choice(SHORT), words(1, 4)])}</a></li>' for k in range(rng.randrange(1, 8)))
            elif piece == "{c}":
                for _ in range(rng.randrange(1, 6)):
                    a, b = rng.choice([('<div class="comment">', "</div>"), ("<li>", "</li>"), ('<li class="comment">', "</li>"), ("<p>", "</p>")])
                    tag = rng.choice(["b", "strong", "cite", "span", "a"])
                    out += f"{a}<{tag}>{words(1, 3)}</{tag}> {sentence(3, 40)}{b}"
            else:
                out += piece
        return out

    def main() -> str:
        a, b = rng.choice(MAIN)
        title = sentence(1, 10)
        out = a + rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f'<h1 class="title">{title}</h1>', ""])
        style = rng.random()
        tiny = rng.random() < 0.15
        for k in range(1 if tiny else rng.randrange(1, 14)):
            r = 1.0 if tiny else rng.random()
            if r < 0.08:
                out += f"<h2>{sentence(2, 7)}</h2>"
            elif r < 0.14:
                out += "<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>"
            elif r < 0.17:
                out += f"<blockquote>{sentence(5, 30)}</blockquote>"
            elif r < 0.2:
                out += "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randrange(1, 4))) + "</table>"
            elif style < 0.5:
                mark = rng.choice(["", "", "<b>", "<strong>", "<em>", '<a href="#">']) if k else rng.choice(["<b>", "<strong>", "<i>", ""])
                out += f"<p>{mark}{sentence(1, 4 if tiny or rng.random() < 0.1 else 90)}{'<br>' * (rng.random() < 0.3)}"
            elif style < 0.6:
                out += f"<div>{sentence(1, 4 if tiny else 60)}</div>"
            else:
                link = f' <a href="#">{words(1, 3)}</a> {words(1, 9)}.' if rng.random() < 0.2 else ""
                out += f"<p>{sentence(1, 4 if tiny or rng.random() < 0.1 else 60)}{link}</p>"
        return out + b

    parts: list[tuple[bool, str]] = []
    for kinds in (["top", "menu", "ad", "notice", "form"], None, ["talk", "side", "ad", "form", "notice", "foot"]):
        if kinds is None:
            parts.append((True, main()))
        else:
            parts += [(False, around(k)) for k in kinds if rng.random() < 0.55]
    from brindle.llm.blocks import leaves

    head = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
    body = ""
    deep = rng.random() < 0.15
    for is_main, part in parts:
        if deep:  # many levels with many classes between a region's marker and its text
            depth = rng.randrange(2, 7)
            part = _deepened(part, "".join(f'<div class="{rng.choice(CLASSES)} {rng.choice(CLASSES)}-{rng.choice(CLASSES)} {rng.choice(CLASSES)}">' for _ in range(depth)), "</div>" * depth)
        body += part if rng.random() < 0.8 else f"<div>{part}</div>"
        marks += [is_main] * len(leaves(part))
    return head + body + rng.choice(["</body></html>", ""]), marks


def _deepened(part: str, opened: str, closed: str) -> str:
    """The levels right inside the part's outermost element."""
    a, b = part.index(">") + 1, part.rindex("<")
    return part[:a] + opened + part[a:b] + closed + part[b:]


def _split(shape: str) -> list[str]:
    import re

    return re.split(r"(\{[tnslc]\})", shape)
