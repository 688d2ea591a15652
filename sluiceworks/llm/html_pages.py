"""Labelled pages to train the extractor on: made from a grammar, each block known to be article text or not."""

from __future__ import annotations

import random
import re

#: End tags that HTML lets a page leave out where these stand.
OPTIONAL = re.compile(r"</(?:head|li|td|tr|body|html)>|</p>(?=<(?:p|ul|ol|div|h[1-6]|table|section|blockquote|pre|figure|article|aside|footer|header|nav|form|main)\b|</(?:article|main|div|section|blockquote|aside|footer|header|li|form)>)")
SYLLABLES = "ba de fi go lu ma ne po ra si to vu an el in or us ta ke mi".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def sentence(r: random.Random, low: int = 5, high: int = 18) -> str:
    return " ".join(word(r) for _ in range(r.randint(low, high))).capitalize() + r.choice(".....!?")


def text(r: random.Random) -> str:
    return " ".join(sentence(r, 1 if r.random() < 0.2 else 5) for _ in range(r.randint(1, 6)))


def link(r: random.Random) -> str:
    return f'<a href="/{word(r)}">{word(r)}</a>'


def menu(r: random.Random) -> str:
    items = [link(r) for _ in range(r.randint(3, 9))]
    return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])


def attribute(r: random.Random, names: list[str]) -> str:
    name = r.choice(names)
    return r.choice([f' class="{name}"', f' id="{name}"', f' class="{word(r)} {name}"'])


def plain_boiler(r: random.Random) -> str:
    """A part of a page that is not the article, in elements that do not say so: rows of links, a line of rights, a slogan."""
    tag = r.choice(["div", "div", "div", "td", "p", "section", "center"])
    tag = "div" if tag == "td" else tag
    name = r.choice(["", "", attribute(r, ["top", "bottom", "left", "right", "row", "col", "foot", "head", "bar", "wrap", "box"])])
    links = r.choice([" | ", " ", " &middot; ", "</div><div>"]).join(link(r) for _ in range(r.randint(2, 9)))
    rights = r.choice(["&copy; ", "Copyright ", "Copyright &copy; ", "(c) "]) + f"{r.randint(1999, 2024)} {word(r)}" + r.choice(["", " " + sentence(r, 1, 5), ". All rights reserved."])
    return f"<{tag}{name}>{r.choice([links, links, rights, rights, word(r), word(r) + ' ' + word(r), links + rights])}</{tag}>"


def boiler(r: random.Random) -> str:
    """A part of a page that is not the article."""
    if r.random() < 0.2:
        return plain_boiler(r)
    t = lambda: r.choice([text(r), sentence(r), f"<p>{text(r)}</p>", f"<p>{sentence(r)}</p><p>{link(r)}</p>"])
    box = lambda names, body, tags=("div", "section", "aside", "div"): (lambda k: f"<{k}{attribute(r, names)}>{body}</{k}>")(r.choice(tags))
    kind = r.randrange(11)
    if kind == 0:
        return f"<nav>{menu(r)}</nav>"
    if kind == 1:
        return f"<footer>{r.choice(['&copy; ', 'Copyright ', ''])}{t()}{r.choice(['', menu(r)])}</footer>"
    if kind == 2:
        return f"<header>{r.choice([sentence(r, 1, 4), f'<h1>{sentence(r, 1, 4)}</h1>', f'<h2>{word(r)}</h2>', ''])}{r.choice([menu(r), t()])}</header>"
    if kind == 3:
        return f"<aside>{r.choice(['', f'<h3>{word(r)}</h3>'])}{r.choice([t(), menu(r), t() + menu(r)])}</aside>"
    if kind == 4:
        return box(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"], t())
    if kind == 5:
        return box(["cookie", "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal"], t() + r.choice(["", "<button>Ok</button>"]))
    if kind == 6:
        return box(["comments", "comment", "comment-list", "discussion", "replies", "reader-comments"], "".join(r.choice([f'<div class="comment">{t()}</div>', f"<p>{text(r)}</p>", f"<article class=\"comment\"><p>{text(r)}</p></article>", f"<ul><li>{text(r)}</li></ul>", f"<ol><li><p>{text(r)}</p></li></ol>"]) for _ in range(r.randint(1, 4))))
    if kind == 7:
        return box(["sidebar", "related", "share", "social", "newsletter", "widget", "recommended", "trending", "subscribe"], r.choice([t(), menu(r), t() + menu(r)]))
    if kind == 8:
        return f"<form><label>{word(r)}</label><input type=text><select><option>{word(r)}</select><p>{sentence(r)}</p><button>{word(r)}</button></form>"
    if kind == 9:
        return box(["menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination"], menu(r), ("div", "ul", "div"))
    return box(["footer", "site-footer", "header", "site-header", "masthead", "copyright", "legal", "disclaimer"], r.choice([t(), menu(r)]), ("div",))


def block(r: random.Random) -> str:
    """A block of the article; the attribute marks it for the labels and is taken off before parsing."""
    inside = text(r)
    if r.random() < 0.25:
        inside = inside.replace(" ", f" <b>{word(r)}</b> ", 1)
    if r.random() < 0.2:
        inside = inside.replace(" ", f" {link(r)} ", 1)
    kind = r.randrange(14)
    if kind == 0:
        return f"<h{r.randint(2, 4)} y>{sentence(r, 1, 7)}</h2>"
    if kind == 1:
        return "<ul y>" + "".join(f"<li y>{sentence(r)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
    if kind == 2:
        return f"<blockquote y>{r.choice([text(r), f'<p y>{text(r)}</p>'])}</blockquote>"
    if kind == 3:
        return r.choice([f"<pre y>{text(r)}</pre>", f"<table y><tr y><td y>{sentence(r)}</td><td y>{word(r)}</td></tr></table>", f"<figure y><img src=x><figcaption y>{sentence(r)}</figcaption></figure>", f"<div y>{inside}</div>", f"<section y><h2 y>{sentence(r, 1, 5)}</h2><p y>{inside}</p></section>"])
    if kind == 4:
        return f"<p y><b>{sentence(r)}<br>"
    return f"<p y>{inside}</p>"


def bare_page(r: random.Random) -> str:
    """A page without landmarks: the article in divisions or cells that have no names, or names that say nothing."""
    nothing = lambda: r.choice(["", "", "", attribute(r, ["wrap", "wrapper", "container", "inner", "row", "col", "box", "text", "body", "page", "center", "left", "w"])])
    long = lambda: " ".join(sentence(r) for _ in range(r.randint(2, 9)))
    one = lambda: r.choice([f"<div y{nothing()}>{long()}</div>", f"<div y>{long()}<br><br>{long()}</div>", f"<p y>{long()}</p>", block(r), f"<h2 y>{sentence(r, 1, 6)}</h2>"])
    parts = "".join(one() for _ in range(r.randint(1, 8)))
    title = r.choice(["", f"<h1 y>{sentence(r, 1, 8)}</h1>", f"<div y><b>{sentence(r, 2, 8)}</b></div>"])
    before, after = ("".join(r.choice([plain_boiler, plain_boiler, boiler])(r) for _ in range(r.randint(0, 3))) for _ in range(2))
    kind = r.randrange(4)
    if kind == 0:
        body = f"{before}<div y{nothing()}>{title}{parts}</div>{after}"
    elif kind == 1:
        body = f"<div y{nothing()}>{before}<div y{nothing()}>{title}{parts}</div>{after}</div>"
    elif kind == 2:
        body = f"<table y><tr y><td>{r.choice([menu(r), plain_boiler(r)])}</td><td y>{title}{parts}</td></tr></table>{after}"
    else:
        body = f"{before}{title}{parts}{after}"
    return f"<html y><head><title>{word(r)}</title></head><body y>{body}</body></html>"


def page(r: random.Random) -> str:
    """A whole page; elements with the attribute y hold article text."""
    if r.random() < 0.3:
        return bare_page(r)
    blocks = [block(r) for _ in range(r.randint(1, 12))]
    if r.random() < 0.35:
        blocks.insert(r.randint(0, len(blocks)), boiler(r))
    title = f"<h1 y>{sentence(r, 1, 9)}</h1>"
    title = r.choice([title, title, f"<header y>{title}</header>", ""])
    tag, attr = r.choice([("article", ""), ("article", ""), ("article", attribute(r, ["post", "article", "entry"])), ("main", ""), ("div", attribute(r, ["content", "article", "post", "entry-content", "main", "story", "article-body"])), ("section", attribute(r, ["content", "article", "main"]))])
    article = f"<{tag} y{attr}>{title}{''.join(blocks)}</{tag}>"
    if r.random() < 0.3:
        article = r.choice([f"<main y>{article}{boiler(r) if r.random() < 0.5 else ''}</main>", f'<div y class="container">{article}</div>', f'<div y id="page">{boiler(r)}{article}</div>'])
    before, after = ("".join(boiler(r) for _ in range(r.randint(0, 4))) for _ in range(2))
    whole = f"<!DOCTYPE html><html y><head><title>{word(r)}</title><style>p{{}}</style></head><body y>{before}{article}{after}<script>x(0)</script></body></html>"
    return without_optional_ends(whole) if r.random() < 0.25 else whole


def without_optional_ends(html: str) -> str:
    return OPTIONAL.sub("", html)


def pages(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
