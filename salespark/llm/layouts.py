"""Made-up pages with known main text, from which the extraction model learns.

Each page is put together at random from the parts that web pages have, in varying order, nesting, naming and length,
with and without the class names that give a part away. Every word of the main text starts with `MARK`.
"""

from __future__ import annotations

import random

MARK = "\ue000"

# Names that authors of web pages give to parts, by kind of part.
NAMES = {
    "main": "article post entry content story body text main page articlebody postcontent entrycontent maincontent blog news single".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toolbar pagination pager tabs topnav mainmenu submenu skip links toc".split(),
    "header": "header masthead topbar banner logo brand site-title head sitehead top".split(),
    "footer": "footer colophon copyright legal bottom sitefoot foot imprint credits".split(),
    "side": "sidebar aside widget related recommended trending popular rail more secondary teaser promo-box readmore latest also".split(),
    "notice": "cookie consent gdpr notice alert newsletter subscribe popup modal overlay message warning announcement paywall signup disclaimer".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsored sponsor banner-ad promo promotion dfp adslot outbrain taboola commercial".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion thread feedback responses".split(),
    "share": "share sharing social follow tags tag-list meta-links buttons like tweet print".split(),
    "form": "form search login field input signin contact-form button".split(),
}
_SYLLABLES = "an er on en th re ti ou in es la ra ko mi su ne do va le po ça né ß ö 漢 字 при вет".split()


class Maker:
    def __init__(self, seed: int):
        self.pick = random.Random(seed)
        p = self.pick
        self.naming = p.choice(("plain", "plain", "wrapped", "hashed", "none"))
        self.noise = p.random() < 0.15
        self.stops = p.random() > 0.1
        self.joined = p.random() < 0.05
        self.closing = p.random() > 0.2

    def words(self, least: int, most: int, keep: bool) -> str:
        p, out = self.pick, []
        for i in range(p.randint(least, most)):
            word = "".join(p.choice(_SYLLABLES) for _ in range(p.randint(1, 4)))
            if self.noise and p.random() < 0.7:
                word += p.choice(("***", "%%%", "&amp;&amp;&amp;", "$$$", "###"))
            out.append((MARK if keep else "") + (word.capitalize() if i == 0 else word))
            if self.stops and p.random() < 0.12:
                out[-1] += p.choice((",", ".", ".", "!", "?"))
        text = ("" if self.joined else " ").join(out)
        return text + ("." if self.stops and most > 6 and p.random() < 0.85 else "")

    def named(self, kind: str, sure: float = 1.0) -> str:
        """Attributes that may name the kind of part."""
        p = self.pick
        if self.naming == "none" or p.random() > sure:
            return ""
        if self.naming == "hashed" and p.random() < 0.6:
            return f' class="css-{p.randrange(10**6):x}"'
        name = p.choice(NAMES[kind])
        if self.naming == "wrapped":
            name = p.choice((f"c-{name}", f"{name}-box", f"site_{name}", f"{name}{p.randrange(9)}", f"js-{name} block", f"{name}Area", f"{name} clearfix"))
        return f' {p.choice(("class", "class", "id"))}="{name}"'

    def box(self, tags: str, kind: str, inside: str, sure: float = 0.9) -> str:
        tag = self.pick.choice(tags.split())
        return f"<{tag}{self.named(kind, 1.0 if tag in ('div', 'section', 'span', 'ul', 'p') else sure * 0.6)}>{inside}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.pick.randrange(10**4)}">{text}</a>'

    def links(self, kind: str, least: int = 3, most: int = 10) -> str:
        p = self.pick
        made = [self.link(self.words(1, 4, False)) for _ in range(p.randint(least, most))]
        if p.random() < 0.7:
            return f"<ul{self.named(kind, 0.3)}>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>"
        return p.choice((" | ", " ", " &middot; ", "<br>")).join(made)

    # Parts without main text.

    def menu(self) -> str:
        return self.box("nav nav div ul", "menu", self.links("menu"))

    def header(self) -> str:
        p = self.pick
        inside = p.choice((self.link(self.words(1, 3, False)), f"<h1>{self.words(1, 3, False)}</h1>", f"<p>{self.words(3, 9, False)}</p>", ""))
        return self.box("header header div", "header", inside + (self.menu() if p.random() < 0.6 else ""))

    def footer(self) -> str:
        p = self.pick
        inside = p.choice(("", "&copy; ")) + self.words(2, 25, False) + (self.links("footer") if p.random() < 0.5 else "")
        return self.box("footer footer footer div", "footer", f"<p>{inside}</p>" if p.random() < 0.5 else inside)

    def side(self) -> str:
        p = self.pick
        teasers = "".join(f"<div><h3>{self.link(self.words(2, 6, False))}</h3><p>{self.words(5, 25, False)}</p></div>" for _ in range(p.randint(0, 3)))
        return self.box("aside aside div section", "side", f"<h2>{self.words(1, 3, False)}</h2>" + p.choice((self.links("side"), teasers, teasers + self.links("side"), f"<p>{self.words(8, 40, False)}</p>")))

    def notice(self) -> str:
        p = self.pick
        inside = p.choice(("<p>{}</p>", "{}", "<span>{}</span>")).format(self.words(4, 30, False)) + (f"<button>{self.words(1, 2, False)}</button>" if p.random() < 0.5 else "")
        if p.random() < 0.25:
            return f'<div role="{p.choice(("alert", "dialog", "banner", "status"))}">{inside}</div>'
        return self.box("div div section aside p", "notice", inside)

    def advert(self) -> str:
        p = self.pick
        inside = p.choice((self.words(3, 25, False), self.link(self.words(3, 12, False)), f"<p>{self.words(3, 20, False)}</p>", f"<span>{self.words(1, 2, False)}</span>"))
        return p.choice(("", f"<!-- ad {p.randrange(99)} -->")) + self.box("div div div aside ins p section", "advert", inside)

    def share(self) -> str:
        return self.box("div ul p", "share", self.links("share", 2, 5))

    def form(self) -> str:
        p = self.pick
        return f"<form{self.named('form', 0.5)}><label>{self.words(1, 5, False)}</label><input name=q><button>{self.words(1, 2, False)}</button>" + (f"<p>{self.words(4, 15, False)}</p>" if p.random() < 0.4 else "") + "</form>"

    def comments(self) -> str:
        p = self.pick
        tag = p.choice(("div", "li", "article", "section"))
        said = "".join(
            f'<{tag}{self.named("comment", 0.6)}>{p.choice(("", f"<b>{self.words(1, 2, False)}</b>", f"<h4>{self.words(1, 3, False)}</h4>"))}<p>{self.words(5, 60, False)}</p></{tag}>'
            for _ in range(p.randint(1, 6))
        )
        said = f"<ol>{said}</ol>" if tag == "li" else said
        naming, self.naming = self.naming, "plain" if self.naming in ("none", "hashed") else self.naming  # nothing else tells readers' words from the author's
        made = self.box("div section aside", "comment", f"<h3>{self.words(1, 3, False)}</h3>" + said + (self.form() if p.random() < 0.5 else ""))
        self.naming = naming
        return made

    def rest(self, most: int) -> str:
        p = self.pick
        return "".join(p.choice((self.menu, self.side, self.notice, self.advert, self.advert, self.share, self.form))() for _ in range(p.randint(0, most)))

    # The main text.

    def inline(self, least: int, most: int) -> str:
        p, text = self.pick, self.words(least, most, True)
        if p.random() < 0.35:
            tag = p.choice(("b", "em", "strong", "i", "span", "code"))
            text += f" <{tag}>{self.words(1, 6, True)}</{tag}> {self.words(1, 10, True)}"
        if p.random() < 0.2:
            text += " " + self.link(self.words(1, 4, True)) + " " + self.words(0, 8, True)
        return text

    def block(self) -> str:
        p, end = self.pick, self.closing or self.pick.random() < 0.5
        kind = p.random()
        if kind < 0.68:
            opened = p.choice(("<p>", "<p>", "<p>", "<p><b>", "<div>")) if self.closing else p.choice(("<p>", "<p><b>"))
            return opened + self.inline(1, p.choice((4, 15, 60, 150))) + (f"<br>{self.inline(2, 20)}" if p.random() < 0.1 else "") + ("</div>" if opened == "<div>" else "</p>" if end else "<br>")
        if kind < 0.76:
            return f"<h2>{self.words(1, 8, True)}</h2>"
        if kind < 0.84:
            tag = p.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.link(self.words(1, 8, True)) if p.random() < 0.15 else self.inline(1, 15)}</li>" for _ in range(p.randint(1, 6))) + f"</{tag}>"
        if kind < 0.89:
            return f"<blockquote>{p.choice(('<p>{}</p>', '{}')).format(self.inline(4, 40))}</blockquote>"
        if kind < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5, True)}</td>" for _ in range(3)) + "</tr>" for _ in range(p.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{self.words(2, 15, True)}</figcaption></figure>"
        return f"<pre>{self.words(3, 30, True)}</pre>"

    def article(self) -> str:
        p = self.pick
        title = f"<h1>{self.words(1, 10, True)}</h1>" if p.random() < 0.85 else ""
        byline = p.choice(("", "", f'<p class="byline">{self.words(2, 6, True)}</p>', f"<time>{self.words(1, 3, True)}</time>"))
        head = f"<header>{title}{byline}</header>" if p.random() < 0.2 else title + byline
        blocks = [self.block() for _ in range(p.choice((0, 1, 1, 2, 4, 8, 15)))]
        if not title and not blocks:
            blocks = [self.block()]
        for _ in range(p.choice((0, 0, 0, 1, 2))):
            blocks.insert(p.randint(0, len(blocks)), p.choice((self.advert, self.side, self.notice, self.form, self.share))())
        end = p.choice(("", "", "", self.share(), f"<footer>{self.share()}</footer>", self.comments()))
        inside = head + ("<br><br>".join(self.inline(5, 50) for _ in range(3)) if p.random() < 0.06 else "".join(blocks)) + end
        tag = p.choice(("article", "article", "article", "main", "div", "section", "td"))
        sure = 0.4 if tag in ("article", "main") else 0.8
        attributes = ' itemprop="articleBody"' if p.random() < 0.08 else ' role="main"' if p.random() < 0.06 else self.named("main", sure)
        made = f"<{tag}{attributes}>{inside}</{tag}>"
        if tag == "td":
            made = f"<table><tr>{made}</tr></table>"
        for _ in range(p.choice((0, 0, 1, 2))):
            made = f"<{p.choice(('div', 'main', 'section'))}{self.named('main', 0.5)}>{made}"
        return made

    def page(self) -> str:
        p = self.pick
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 8, False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        wrap = p.choice(("", "", f"<div{p.choice(('', ' class=wrapper', ' id=container', ' id=page'))}>"))
        top = [part() for part in (self.header, self.menu, self.notice, self.advert, self.side) if p.random() < 0.45]
        p.shuffle(top)
        after = [part() for part in (self.comments, self.side, self.advert, self.share, self.notice) if p.random() < 0.35]
        p.shuffle(after)
        foot = self.footer() if p.random() < 0.85 else ""
        return head + wrap + "".join(top) + self.article() + "".join(after) + foot + ("</body></html>" if p.random() < 0.9 else "")
