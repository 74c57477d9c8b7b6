"""Small labelled pages that the block classifier is trained on, made from layouts by rule.

``data-label`` says of an element's text whether it belongs to the article (1) or not (0).
"""

from __future__ import annotations

import random

_WORDS = "water stone light people under morning road letter river made small began never again house through many while number answer field window later often carry music paper winter across town young early ground order table story market found hands night along summer bridge garden voice second".split()


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def text(self, least: int, most: int) -> str:
        words = self.rng.choices(_WORDS, k=self.rng.randint(least, most))
        return " ".join(words).capitalize() + "."

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.text(1, 3)[:-1]}</a></li>' for k in range(n)) + "</ul>"

    def paragraphs(self, n: int, least: int = 1) -> str:
        made = []
        for _ in range(n):
            words = self.text(least, self.rng.choice([2, 12, 40, 120]) + least)
            linked = f'<a href="/x">{self.text(1, 6)}</a>'
            made.append(self.rng.choices([f"<p>{words}</p>", f"<p>{words} {linked} {self.text(3, 9)}</p>", f"<p>{linked}</p>"], [8, 2, 1])[0])
        return "".join(made)

    def bar(self, n: int) -> str:
        return self.rng.choice([" ", " | ", ""]).join(f'<a href="/{k}">{self.text(1, 2)[:-1]}</a>' for k in range(n))

    def notice(self) -> str:
        return self.text(3, 30)


#: Names that wrappers of whole pages and articles bear, some of them those of side parts.
_WRAPPERS = ["wrap", "outer", "page-header-wrap", "site-nav-container", "widget-area content", "social-wall", "with-sidebar", "ad-free", "newsletter-site", "c12", "layout", "banner-page", "form-body", "menu-open"]


def _wrapped(m: _Maker, inner: str, most: int) -> str:
    for _ in range(m.rng.randint(0, most)):
        name = m.rng.choice(_WRAPPERS)
        inner = m.rng.choice([f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>', f"<div>{inner}</div>"])
    return inner


def _page(k: int) -> str:
    m = _Maker(k)
    menu = m.rng.choice([f"<nav>{m.links(5)}</nav>", f'<div class="menu">{m.links(4)}</div>', f'<div id="navbar">{m.links(6)}</div>', m.links(5)])
    head = m.rng.choice(["", f"<header><h1>{m.text(1, 4)}</h1><p>{m.notice()}</p></header>", f'<div class="masthead">{m.text(2, 6)}</div>'])
    ad = m.rng.choice([f'<div class="ad">{m.notice()}</div>', f'<div class="sponsored-box"><p>{m.text(5, 60)}</p></div>', f"<aside><p>{m.text(3, 50)}</p></aside>"])
    foot = m.rng.choice([f"<footer>{m.notice()}</footer>", f'<div id="footer"><p>{m.notice()}</p><a href="/">{m.text(1, 3)}</a></div>', f'<div class="copyright">{m.text(3, 12)}</div>'])
    cookie = m.rng.choice(["", f'<div class="cookie-notice"><p>{m.text(8, 40)}</p><button>{m.text(1, 2)}</button></div>', f'<div role="dialog">{m.text(8, 30)}</div>'])
    form = m.rng.choice(["", f"<form><p>{m.text(2, 20)}</p><input name=q></form>", f'<div class="newsletter"><p>{m.text(4, 30)}</p></div>'])
    bar = m.rng.choice(["", f'<div class="sidebar"><h3>{m.text(1, 4)}</h3>{m.links(3)}<p>{m.text(4, 40)}</p></div>', f"<aside><h3>{m.text(1, 3)}</h3><p>{m.text(2, 60)}</p></aside>"])
    says = "".join(f'<div class="comment"><p>{m.text(1, 70)}</p></div>' for _ in range(m.rng.randint(1, 4)))
    comments = m.rng.choice(["", f'<section id="comments"><h2>{m.text(1, 2)}</h2>{says}</section>', f'<section class="responses"><article class="comment"><p>{m.text(1, 60)}</p></article><article class="comment"><p>{m.text(3, 30)}</p></article></section>'])
    hidden = m.rng.choice(["", f"<div hidden><p>{m.text(4, 50)}</p></div>", f'<div style="display:none"><p>{m.text(10, 40)}</p></div>'])
    extra = m.rng.choice(["", ad, form, f'<div class="related"><h3>{m.text(1, 3)}</h3>{m.links(3)}</div>', f'<div class="share">{m.text(1, 3)}</div>', hidden])
    loose = [m.rng.choice(["", f"<div>{m.text(1, 12)}</div>", f"<p>{m.text(2, 40)}</p>", f"<h2>{m.text(1, 4)}</h2>"]) for _ in range(2)]
    title = f"<h1>{m.text(1, 9)}</h1>"
    body = title + m.paragraphs(m.rng.randint(1, 4)) + f'<div data-label="0">{extra}</div>' + m.rng.choice(["", f"<h2>{m.text(1, 5)}</h2>"]) + m.paragraphs(m.rng.randint(0, 4))
    plain = title + "".join(f"<p>{m.text(8, 90)}</p>" for _ in range(m.rng.randint(2, 6))) + f"<h2>{m.text(2, 5)}</h2>" + "".join(f"<p>{m.text(8, 90)}</p>" for _ in range(m.rng.randint(1, 3)))
    layout = k % 12
    if m.rng.random() < 0.3:  # of few words
        body = f"<h1>{m.text(1, 3)}</h1>" + "".join(f"<p>{m.text(1, 8)}</p>" for _ in range(m.rng.randint(1, 3)))
    name = m.rng.choice(["", *_WRAPPERS])
    article = f'<div data-label="1">{plain}</div>'
    if layout in (0, 1):
        article = f'<article class="{name}" data-label="1">{body}</article>'
    elif layout == 2:
        article = f'<main data-label="1">{body}</main>'
    elif layout == 3:
        article = f'<div class="{m.rng.choice(["post-content", "article-body", "entry"])}" data-label="1">{body}</div>'
    if layout in (1, 2) and m.rng.random() < 0.4:  # an article and hardly anything else
        short = m.rng.choice([body, f"<p>{m.text(1, 30)}</p>", f"<p>{m.text(1, 40)}<br>{m.text(1, 9)}</p>", m.text(1, 20)])
        tag = m.rng.choice(["article", "main"])
        return f'<html><body data-label="0">{m.rng.choice(["", "", menu, foot, cookie])}<{tag} data-label="1">{short}</{tag}>{m.rng.choice(["", "", foot, comments])}</body></html>'
    if layout == 8 and m.rng.random() < 0.4:  # no article at all
        parts = m.rng.sample([f"<nav>{m.rng.choice([m.text(1, 4), m.links(3)])}</nav>", menu, foot, cookie, form, ad, head], m.rng.randint(1, 4))
        return f'<html><body data-label="0">{"".join(parts)}</body></html>'
    if layout in (4, 5):  # nothing but text and links to go by
        menu, ad, loose = m.links(6), f"<p>{m.text(1, 4)}</p>", ["", ""]
    elif layout == 6:  # cells of a table, without names
        side = f"<td>{m.links(4)}<p>{m.text(1, 9)}</p></td>"
        cells = [f"<td>{m.links(6)}</td>", f'<td data-label="1">{plain}</td>', m.rng.choice(["", side])]
        return f'<html><body data-label="0"><table><tr><td colspan=3>{m.text(1, 5)}</td></tr><tr>{"".join(cells)}</tr><tr><td colspan=3>{m.text(2, 12)}</td></tr></table></body></html>'
    elif layout == 7:  # an article without signs, in wrappers with wrong ones
        article = _wrapped(m, f'<div class="{name}" data-label="1">{plain}</div>', 2)
        loose = ["", ""]
    elif layout in (9, 10):  # links and an article, hardly anything else
        tag = m.rng.choice(["div", "center", "font", "section", "main", "article", "object", "noscript", "span", "blockquote"])
        broken = "<br><br>".join(m.text(8, 90) for _ in range(m.rng.randint(2, 6)))
        article = f'<{tag} data-label="1">{m.rng.choice([plain, broken])}</{tag}>'
        bars = [m.rng.choice([m.links(5), f"<center>{m.bar(6)}</center>", f"<div>{m.bar(5)}</div>", f"<dl><dt>{m.bar(3)}<dd>{m.bar(4)}</dl>"]) for _ in range(2)]
        end = m.rng.choice(["", foot, f"<hr>{m.bar(m.rng.randint(2, 9))}"])
        return f'<html><body data-label="0">{_wrapped(m, bars[0] + article + m.rng.choice(["", bars[1]]) + end, 2)}</body></html>'
    elif layout == 11:  # links and an article beside each other in one wrapper
        inner = m.rng.choice([m.links(4), f"<p>{m.bar(5)}</p>", m.bar(6), f"<ul><li>{m.bar(m.rng.randint(2, 9))}</li></ul>"]) + f'<span data-label="1">{plain}</span>'
        name = m.rng.choice(["", "content", "widget-area content", "page-body", "main"])
        return f'<html><body data-label="0">{_wrapped(m, f"<div class={chr(34)}{name}{chr(34)}>{inner}</div>", 2)}{m.rng.choice(["", foot, comments])}</body></html>'
    else:
        article = f'<section data-label="1">{plain}</section>'
        loose = ["", ""]
    return f'<html><body data-label="0">{_wrapped(m, f"{head}{menu}{cookie}{loose[0]}{ad}{article}{loose[1]}{bar}{comments}{form}{foot}", 2)}</body></html>'


#: How many pages; some thirty thousand blocks in all.
N_PAGES = 1_500
PAGES = [_page(k) for k in range(N_PAGES)]
