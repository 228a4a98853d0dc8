"""Labelled training pages, made from layout rules.

Every page has an article in one of several containers and a choice of the furniture that web
pages carry, named in one of several styles (semantic elements, classes, ids, or neither).  Texts
are random words, so a model can learn from structure and form only.  Text of the article begins
with ``MAIN``, which the reader of these pages turns into the label."""

from __future__ import annotations

import random
import string

MAIN = "\ue000"

CONTAINERS = [
    "<article>{}</article>",
    "<main><article>{}</article></main>",
    "<main>{}</main>",
    '<div id="content"><div class="post">{}</div></div>',
    '<div class="entry-content">{}</div>',
    '<div class="article-body" itemprop="articleBody">{}</div>',
    '<section class="story-text">{}</section>',
    '<div class="container"><div class="row"><div class="col-8 main-column">{}</div></div></div>',
    '<table><tr><td class="text">{}</td></tr></table>',
    "<div>{}</div>",
]

FURNITURE = {
    "menu": [
        "<nav>{links}</nav>", '<nav class="toc">{links}</nav>', '<div class="menu">{links}</div>', '<div id="navigation" role="navigation">{links}</div>',
        '<ul class="nav navbar">{items}</ul>', '<div class="breadcrumbs">{inline}</div>', '<div class="pagination">{inline}</div>', "<div>{links}</div>",
        '<ul class="tags">{items}</ul>', '<div class="share social">{inline}</div>', '<section class="related"><h3>{short}</h3>{links}</section>',
    ],
    "header": [
        "<header><h2>{short}</h2><p>{short}</p></header>", '<div id="header"><a href="/">{short}</a><p>{sentence}</p></div>',
        '<div class="masthead banner">{short}</div>', '<header class="site-header"><div>{short}</div>{links}</header>', '<div class="topbar">{short}</div>',
    ],
    "footer": [
        "<footer>&copy; {short} &middot; {text}</footer>", "<footer><p>{sentence}</p>{links}</footer>", '<div id="footer">&copy; 2001 {sentence}</div>',
        '<div class="page-footer"><p>{text}</p><p>{inline}</p></div>', '<div class="copyright">&copy; {short}</div>', "<footer>{text}</footer>",
    ],
    "sidebar": [
        "<aside><h3>{short}</h3><p>{text}</p></aside>", '<div class="sidebar">{items_plain}</div>', '<div id="right-rail"><h4>{short}</h4><p>{sentence}</p></div>',
        '<div class="widget"><p>{text}</p></div>', '<aside class="promo">{sentence}</aside>', "<aside><ul>{items}</ul><p>{text}</p></aside>",
    ],
    "notice": [
        '<div class="cookie-notice"><p>{text}</p><button>{word}</button></div>', '<div id="consent" role="dialog">{sentence}</div>', '<p class="notice">{sentence}</p>',
        '<div class="alert" role="alert">{sentence}</div>', '<div class="gdpr-banner">{text}</div>', '<div class="newsletter-popup modal"><h4>{short}</h4><p>{sentence}</p></div>',
    ],
    "advert": [
        '<div class="ad">{text}</div>', '<div class="ad">{sentence}</div>', '<div class="advertisement"><a href="/x">{sentence}</a></div>', '<div id="ads-top">{short}</div>',
        '<aside class="sponsored"><p>{text}</p></aside>', '<div class="ad-slot banner-ad">{text}</div>', '<ins class="adsbox">{sentence}</ins>', '<div class="sponsor">{text}</div>',
    ],
    "form": [
        "<form><label>{short}</label><input name=q><button>{word}</button></form>", '<form action="/s"><p>{sentence}</p><textarea>{text}</textarea></form>',
        '<form class="subscribe"><h4>{short}</h4><p>{text}</p><select><option>{word}</option></select></form>', "<fieldset><legend>{short}</legend><label>{sentence}</label></fieldset>",
    ],
    "comments": [
        '<section id="comments"><h3>{short}</h3><div class="comment"><b>{word}</b><p>{text}</p></div><div class="comment"><p>{sentence}</p></div></section>',
        '<div class="comments"><p>{text}</p><p>{text}</p></div>', '<ol class="commentlist"><li><p>{text}</p></li><li><p>{sentence}</p><p>{text}</p></li></ol>',
        '<div id="disqus_thread" class="user-comments"><div class="reply"><p>{text}</p></div></div>', '<section class="responses discussion"><p>{text}</p></section>',
        '<div class="reviews"><div class="review"><p>{text}</p></div></div>',
    ],
    "code": ['<script>var t="</p>";</script>', "<style>p{{margin:0}}</style>", "<noscript>{sentence}</noscript>", "<!-- {sentence} -->", '<div hidden>{sentence}</div>'],
}
BEFORE = ["menu", "header", "notice", "advert", "sidebar", "form", "code"]
AFTER = ["footer", "comments", "menu", "sidebar", "advert", "form", "notice", "code"]
WITHIN = ["advert", "menu", "form", "notice", "sidebar", "code", "comments"]


class Pages:
    def __init__(self, seed: int = 7):
        self.random = random.Random(seed)

    def word(self) -> str:
        r = self.random
        w = "".join(r.choice(string.ascii_lowercase) for _ in range(min(14, 1 + int(r.expovariate(0.25)))))
        form = r.random()
        return w.capitalize() if form < 0.1 else w.upper() if form < 0.13 else str(r.randint(1, 9999)) if form < 0.15 else w

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        end = self.random.choice([".", ".", ".", ".", "!", "?", ""])
        return self.words(low, high).capitalize().replace(" ", self.random.choice([" ", " ", ", "]), 1) + end

    def text(self, most: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(1, most)))

    def odd(self) -> str:
        """Article text of poor form: short, shouting, with symbols or cells."""
        r = self.random
        kind = r.randrange(5)
        words = self.words(1, 40).split()
        if kind == 0:
            return self.word().capitalize() + "."
        if kind == 1:
            return " ".join(w.upper() + "!!" for w in words)
        if kind == 2:
            return " ".join(w + r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;"]) for w in words)
        if kind == 3:
            return " | ".join(words)
        return " ".join([words[0]] * r.randint(2, 30))

    def fill(self, pattern: str) -> str:
        r = self.random
        link = lambda: f'<a href="/{r.randint(0, 99)}">{self.words(1, 4)}</a>'
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7)))
        return pattern.format(
            links=f"<ul>{items}</ul>",
            items=items,
            items_plain="<ul>" + "".join(f"<li>{self.words(1, 6)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
            inline=r.choice([" | ", " &raquo; ", " "]).join(link() for _ in range(r.randint(2, 6))),
            short=self.words(1, 5),
            word=self.word(),
            sentence=self.sentence(),
            text=self.text(),
        )

    def paragraph(self) -> str:
        r = self.random
        body = MAIN + (self.odd() if r.random() < 0.25 else self.text(8))
        kind = r.random()
        if kind < 0.70:
            return f"<p>{body}" + ("</p>" if r.random() < 0.8 else "")
        if kind < 0.76:
            return f"<p><b>{body}<br>"
        if kind < 0.80:
            return f"<h2>{MAIN}{self.words(1, 8)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{MAIN}{self.words(1, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{body}</p></blockquote>"
        if kind < 0.91:
            return f'<p>{body} <a href="/y">{self.words(1, 4)}</a> {self.words(2, 9)}.</p>'
        if kind < 0.94:
            return f"<table><tr><td>{MAIN}{self.words(1, 3)}</td><td>{MAIN}{self.word()}</td></tr></table>"
        if kind < 0.97:
            return f'<figure><img src="x.png"><figcaption>{MAIN}{self.sentence()}</figcaption></figure>'
        return f"<pre>{body}</pre>"

    def page(self) -> str:
        r = self.random
        pick = lambda kinds, n: [self.fill(r.choice(FURNITURE[k])) for k in r.sample(kinds, n)]
        parts = [f"<h1>{MAIN}{self.words(2, 9)}</h1>"] if r.random() < 0.8 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        parts += [self.paragraph() for _ in range(r.choice([0, 1, 2, 4, 8, 14]))]
        for extra in pick(WITHIN, r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(min(1, len(parts)), len(parts)), extra)
        body = pick(BEFORE, r.randint(1, 4)) + [r.choice(CONTAINERS).format("".join(parts))] + pick(AFTER, r.randint(1, 4))
        if r.random() < 0.3:
            body = ['<div class="wrapper">', *body, "</div>"]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{''.join(body)}</body></html>"


def training_pages(n: int, seed: int = 7) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
