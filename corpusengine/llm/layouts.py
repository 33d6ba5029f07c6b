"""Invented pages with known main text, to train a block labeller on.

A page is dealt at random from usual ways of marking up an article and of putting menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around and within it. Words are invented, so that what a block says tells little
but for the few phrases that such parts really have.
"""

from __future__ import annotations

import numpy as np

#: Names that sites give to the parts of a page, and phrases seen in them.
MAIN = ["<article>", "<main>", '<div id="content">', '<div class="post-content">', '<div class="entry-content">', '<div class="article-body">', '<section class="story">', '<article class="post">', '<div class="main">', '<div role="main">', '<main id="main"><article>', '<div class="text">']
MENUS = ["<nav>", '<nav class="menu">', '<div class="nav">', '<div id="menu">', '<ul class="navbar">', '<div class="breadcrumb">', '<div class="breadcrumbs">', '<header><nav>', '<div role="navigation">']
HEADERS = ["<header>", '<div id="header">', '<div class="header">', '<div class="site-header">', '<div class="masthead">', '<div class="banner">', '<div role="banner">']
FOOTERS = ["<footer>", '<div id="footer">', '<div class="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div role="contentinfo">']
SIDES = ["<aside>", '<div class="sidebar">', '<aside class="sidebar">', '<div id="sidebar">', '<div class="related">', '<section class="related">', '<div class="widget">', '<aside class="recommended">', '<div class="popular">']
NOTICES = ['<div class="cookie-notice">', '<div class="cookie">', '<div id="cookie-banner">', '<div class="notice">', '<div class="newsletter">', '<div class="popup">', '<div class="alert">', '<div class="gdpr">', '<div class="consent">', '<div class="modal">', '<div class="subscribe">', '<div class="paywall">', '<div role="alert">', '<div class="disclaimer">']
ADS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-1">', '<aside class="ad">', '<div class="banner-ad">', '<section class="advert">', '<div class="social">', '<div class="share">']
FORMS = ["<form>", '<form class="search">', '<form id="login">', '<div class="search"><form>', '<form class="newsletter">']
COMMENTS = ['<div class="comments">', '<section id="comments">', '<div id="comments">', '<section class="comments">', '<ol class="commentlist">', '<div class="comment">', '<ul class="comments">', '<div class="responses">', '<div class="reader-comments">', '<div class="discussion">']
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Blog", "Login", "Sign in", "Products", "Help", "Start", "Kontakt", "Accueil", "Inicio"],
    "footer": ["© 2024", "Copyright", "All rights reserved", "Privacy Policy", "Terms of Service", "Imprint", "Impressum", "Mentions légales", "Aviso legal", "·"],
    "notice": ["We use cookies", "Accept all", "Subscribe to our newsletter", "Diese Website verwendet Cookies", "Nous utilisons des cookies", "Usamos cookies", "Sign up"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité", "Publicidad", "Offer", "Share", "Tweet"],
    "side": ["Related articles", "Popular", "Read more", "Recent posts", "Tags", "Archive"],
    "form": ["Search", "Submit", "E-mail", "Password", "Send", "Name"],
    "comment": ["Comments", "Reply", "Leave a comment", "says:", "wrote:", "Antworten", "Great post", "I agree", "Thanks for sharing"],
}
#: Stands before the text of main blocks.
MARK = "\ue000"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu que eau ch ung heit keit lich ción mente os rr ll ñ ai è é ä ö ü ß".split()


class _Page:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng

    def one(self, choices: list[str]) -> str:
        return choices[self.rng.integers(len(choices))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        made = ["".join(self.one(SYLLABLES) for _ in range(self.rng.integers(1, 5))) for _ in range(n)]
        style = self.rng.random()
        if style < 0.06:
            made = [w.upper() + "!!" for w in made]
        elif style < 0.12:
            made = [w + self.one(["***", "$$$", "%%%", "###", "&amp;&amp;"]) for w in made]
        elif style < 0.18:
            made = [made[0]] * n
        else:
            made = [w + self.one([".", ",", "?", "!"]) if self.chance(0.15) else w for w in made]
        return " ".join(made).capitalize()

    def wrap(self, opening: str, inner: str) -> str:
        tags = [t.split()[0].strip("<>") for t in opening.split("<") if t]
        return opening + inner + "".join(f"</{t}>" for t in reversed(tags))

    def say(self, kind: str, text: str) -> str:
        return f"{self.one(PHRASES[kind])} {text}" if self.chance(0.5) else text

    def links(self, kind: str) -> str:
        items = [f'<a href="/x">{self.say(kind, self.words(1, 3)) if self.chance(0.7) else self.one(PHRASES[kind])}</a>' for _ in range(self.rng.integers(2, 9))]
        return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if self.chance(0.7) else " ".join(items)

    def prose(self, kind: str) -> str:
        text = self.say(kind, self.words(2, 40))
        return f"<p>{text}</p>" if self.chance(0.5) else text

    def junk(self, which: str) -> str:
        if which == "menu":
            return self.wrap(self.one(MENUS), self.links("menu"))
        if which == "header":
            return self.wrap(self.one(HEADERS), (f"<h1>{self.words(1, 4)}</h1>" if self.chance(0.5) else "") + (self.links("menu") if self.chance(0.6) else self.prose("menu")))
        if which == "footer":
            return self.wrap(self.one(FOOTERS), self.prose("footer") + (self.links("footer") if self.chance(0.4) else ""))
        if which == "side":
            return self.wrap(self.one(SIDES), (f"<h3>{self.say('side', self.words(1, 4))}</h3>" if self.chance(0.5) else "") + (self.links("side") if self.chance(0.5) else self.prose("side")))
        if which == "notice":
            return self.wrap(self.one(NOTICES), self.prose("notice") + ("<button>OK</button>" if self.chance(0.3) else ""))
        if which == "ad":
            return self.wrap(self.one(ADS), self.prose("ad"))
        if which == "form":
            return self.wrap(self.one(FORMS), f"<label>{self.say('form', self.words(1, 3))}</label><input name='q'><button>{self.one(PHRASES['form'])}</button>")
        said = "".join(self.wrap(self.one(["<div class=\"comment\">", "<li>", "<p>", "<div>", "<article>", '<article class="comment">']), self.prose("comment")) for _ in range(self.rng.integers(1, 5)))
        return self.wrap(self.one(COMMENTS), (f"<h3>{self.say('comment', self.words(1, 3))}</h3>" if self.chance(0.5) else "") + said)

    def article(self) -> str:
        out = [f"<h1>{MARK}{self.words(1, 14)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.geometric(0.2))):
            kind, text = self.rng.random(), MARK + (self.words(1, 5) if self.chance(0.15) else self.words(5, 120))
            if kind < 0.6:
                out.append(f"<p>{text}</p>")
            elif kind < 0.75:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.82:
                out.append(f"<h2>{text}</h2>")
            elif kind < 0.88:
                out.append(f"<ul><li>{text}</li></ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.96:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f'<p><a href="/y">{text}</a></p>')
            if self.chance(0.06):
                out.append(self.junk(self.one(["ad", "ad", "side", "notice", "form", "comment"])))
        if self.chance(0.12):
            out.append(self.junk("comment"))
        return self.wrap(self.one(MAIN) if self.chance(0.5) else "<article>", "".join(out))

    def made(self) -> str:
        above = [self.junk(k) for k, p in (("notice", 0.2), ("header", 0.4), ("menu", 0.7), ("form", 0.2), ("ad", 0.4), ("side", 0.2)) if self.chance(p)]
        below = [self.junk(k) for k, p in (("comment", 0.35), ("side", 0.35), ("ad", 0.25), ("form", 0.15), ("menu", 0.1), ("notice", 0.12), ("footer", 0.75)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(above)
        inner = "".join(above) + self.article() + "".join(below)
        inner = f'<div class="{self.one(["wrapper", "page", "container", "layout"])}">{inner}</div>' if self.chance(0.35) else inner
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{inner}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    """n pages, in which blocks of main text begin with MARK; the same for the same seed."""
    rng = np.random.default_rng(seed)
    return [_Page(rng).made() for _ in range(n)]
