"""Labelled pages for training the block labeller: random pages of several layouts with known main text."""

from __future__ import annotations

import random
from collections.abc import Callable

#: Marks of what is not main text, as class or id names; fixed values.
AWAY = {
    "menu": ("menu", "nav", "navbar", "breadcrumb", "topnav", "toolbar"),
    "header": ("header", "masthead", "site-header", "banner", "logo", "branding"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom"),
    "sidebar": ("sidebar", "aside", "widget", "related", "recommended", "trending", "tags", "share", "social"),
    "notice": ("notice", "cookie", "consent", "alert", "popup", "modal", "newsletter", "subscribe"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion"),
    "comments": ("comments", "comment", "reply", "discussion", "respond"),
    "form": ("form", "search", "login", "signup"),
}
MAIN = ("content", "main", "post", "entry", "article", "article-body", "story", "post-content", "entry-content", "text", "body")
SYLLABLES = ("the", "an", "re", "ti", "on", "er", "st", "ing", "ou", "ha", "le", "de", "ci", "ment", "ver", "ich", "au", "qu", "el", "lo")


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def sentence(r: random.Random, most: int = 18) -> str:
    words = [word(r) for _ in range(r.randint(1, most))]
    if r.random() < 0.15:  # marks in odd places do not tell main text from the rest
        words = [w + r.choice(("***", "%%%", "$$$", "!!", " |", "&amp;")) for w in words]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?", ""))


def paragraph(r: random.Random) -> str:
    text = " ".join(sentence(r) for _ in range(r.choice((1, 1, 2, 3, 4, 8))))
    return text.upper() if r.random() < 0.05 else text


def links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{word(r)}">{word(r)}</a></li>' for _ in range(n)) + "</ul>"


def away(r: random.Random, kind: str) -> str:
    """A part of a page that is not main text: by its tag, its class or both, with text of any look."""
    tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
    name = r.choice(AWAY[kind])
    if tag != "div" and r.random() < 0.5:
        opening = f"<{tag}>"
    else:
        if r.random() < 0.5:
            tag = r.choice(("div", "section", "ul" if kind == "menu" else "div"))
        opening = f'<{tag} {r.choice(("class", "id"))}="{name}{r.choice(("", "-" + word(r), " " + word(r), "s" if kind == "advert" else ""))}">'
    if kind == "menu":
        inner = links(r, r.randint(2, 8)) if tag != "ul" else links(r, 5)[4:-5]
    elif kind == "form":
        inner = f"<label>{sentence(r, 3)}</label><input name=q><button>{word(r)}</button>" + (f"<p>{sentence(r)}</p>" if r.random() < 0.5 else "")
    elif kind == "comments":
        inner = f"<h3>{sentence(r, 3)}</h3>" + "".join(f'<div class="{r.choice(AWAY["comments"])}"><p>{paragraph(r)}</p></div>' for _ in range(r.randint(1, 4)))
    elif kind == "footer":
        inner = r.choice(("", "&copy; ", "&copy; 2020 ")) + sentence(r) + r.choice(("", " &middot; " + sentence(r)))
    elif kind == "header":
        inner = f"<h1>{sentence(r, 4)}</h1>" if r.random() < 0.5 else f"<p>{sentence(r, 5)}</p>" + links(r, 3)
    else:
        inner = r.choice((sentence(r), f"<p>{paragraph(r)}</p>", f"<h3>{sentence(r, 4)}</h3>" + links(r, r.randint(2, 6)), f"<p>{paragraph(r)}</p><p>{paragraph(r)}</p>"))
    return f"{opening}{inner}</{tag}>"


def bare(r: random.Random, title: str, block: Callable[[], str]) -> str:
    """The body of a page that names its text neither by tag nor by class: paragraphs in the body, in plain boxes or in a grid,
    between link lists, forms and small print, some of which are named and some not."""

    def around() -> str:
        kind = r.random()
        if kind < 0.4:
            return away(r, r.choice(("menu", "header", "notice", "advert", "sidebar", "form", "footer")))
        if kind < 0.6:
            return r.choice((links(r, r.randint(3, 9)), "<p>" + " | ".join(f'<a href="/{word(r)}">{word(r)}</a>' for _ in range(r.randint(2, 7))) + "</p>"))
        if kind < 0.75:
            return f'<div><a href="/">{word(r)}</a> {" ".join(f"<a href=/{word(r)}>{word(r)}</a>" for _ in range(r.randint(1, 6)))}</div>'
        return r.choice((f"<p>&copy; 20{r.randint(10, 25)} {word(r)}</p>", f"<div>{word(r)}</div>", f"<form><label>{word(r)}</label><select><option>{word(r)}<option>{word(r)}</select><button>{word(r)}</button></form>"))

    inner = [f"<h1>\x01{title}\x02</h1>"] if r.random() < 0.8 else []
    inner += [block() for _ in range(r.randint(1, 14))]
    kind = r.random()
    text = "".join(inner)
    if kind < 0.4:
        text = f"<div{r.choice(('', ' class=c' + str(r.randint(1, 9)), f' id={word(r)}x'))}>{text}</div>"
    elif kind < 0.7:
        side = f'<div class="col-md-{r.randint(2, 5)}">{around()}</div>' if r.random() < 0.5 else ""
        text = f'<div class="container"><div class="row"><div class="col-md-{r.randint(6, 9)}">{text}</div>{side}</div></div>'
    elif kind < 0.8:
        text = f"<table><tr><td>{around()}</td><td>{text}</td></tr></table>"
    before, after = "".join(around() for _ in range(r.randint(0, 3))), "".join(around() for _ in range(r.randint(0, 3)))
    return before + text + after


def page(seed: int) -> str:
    """One page; main text is what stands between the marks \\x01 and \\x02, which ``label`` takes out."""
    r = random.Random(seed)

    def block() -> str:
        p, kind = paragraph(r), r.random()
        if kind < 0.65:
            return f"<p>\x01{p}\x02</p>"
        if kind < 0.75:
            return f"<h{(n := r.randint(2, 4))}>\x01{sentence(r, 6)}\x02</h{n}>"
        if kind < 0.83:
            return f"<p><b>\x01{p}\x02<br>"
        if kind < 0.85:
            return f"<figure><img src=a.png><figcaption>\x01{sentence(r)}\x02</figcaption></figure>" if r.random() < 0.5 else f"<pre>\x01{p}\x02</pre>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>\x01{sentence(r)}\x02</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        return f"<blockquote>\x01{p}\x02</blockquote>" if kind < 0.95 else f'<p>\x01{sentence(r)} <a href="/{word(r)}">{word(r)}</a> {sentence(r)}\x02</p>'

    title = sentence(r, 10)
    inner = [f"<h1>\x01{title}\x02</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 14)):
        inner.append(block())
        if r.random() < 0.08:
            inner.append(away(r, r.choice(("advert", "sidebar", "notice", "form"))))
    kind = r.random()
    if kind < 0.55:
        opening, closing = ("<article>", "</article>") if r.random() < 0.7 else (f'<article class="{r.choice(MAIN)}">', "</article>")
    elif kind < 0.75:
        opening, closing = "<main>", "</main>"
    else:
        opening, closing = f'<div {r.choice(("class", "id"))}="{r.choice(MAIN)}">', "</div>"
    if r.random() < 0.2:
        inner.append(away(r, "comments"))
    before = [away(r, k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.5]
    after = [away(r, k) for k in ("comments", "sidebar", "advert", "notice", "footer", "menu") if r.random() < 0.5]
    body = "".join([*before, opening, *inner, closing, *after])
    if r.random() < 0.3:
        body = f'<div class="{r.choice(("wrapper", "page", "container", "site", word(r)))}">{body}</div>'
    if r.random() < 0.22:
        body = bare(r, title, block)
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"
