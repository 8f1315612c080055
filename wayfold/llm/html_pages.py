"""Labelled pages in many forms of markup, to learn from: an article of given texts among menus, notices, adverts, sidebars, forms, comments and the like."""

from __future__ import annotations

import random
from html import escape

#: The attribute that a made page's elements are labelled by.
LABEL = "data-label="
CONTENT, OTHER = f'{LABEL}"1"', f'{LABEL}"0"'
#: The tag that a part of a page may have, and words of its class or id.
_PARTS = {
    "menu": ("nav", "nav navbar menu main-menu navigation breadcrumb breadcrumbs pagination pager toc top-links links tabs"),
    "header": ("header", "header site-header masthead branding logo topbar page-header top"),
    "footer": ("footer", "footer site-footer page-footer bottom colophon copyright legal credits"),
    "sidebar": ("aside", "sidebar aside side-bar widget widgets rail secondary related related-posts recommended most-read popular trending more-stories teaser"),
    "notice": ("div", "notice cookie-notice cookie-banner consent gdpr privacy alert warning message popup modal overlay announcement banner info-bar"),
    "advert": ("div", "ad ads advert advertisement ad-slot ad-container ad-box adsense sponsor sponsored promo promotion dfp-ad commercial"),
    "form": ("form", "form search search-form login newsletter subscribe signup contact-form comment-form"),
    "comments": ("section", "comments comment-list discussion replies responses disqus thread reader-comments respond"),
    "share": ("div", "share social sharing share-buttons follow tags post-tags toolbar tools"),
    "meta": ("div", "meta byline author post-meta date dateline entry-meta published author-bio"),
    "article": ("article", "article post content entry story main-content article-body post-content entry-content story-body text body-text page-content"),
    "wrapper": ("main", "main wrapper container page content site-content layout row column primary"),
}
_SHORT = {
    "menu": "Home|News|About|Contact|Sport|World|Shop|Next|Previous|Archive", "notice": "We use cookies to improve this site.|By continuing you accept our privacy policy.|Accept all|This site is for subscribers.|Your browser is out of date.",
    "advert": "Advertisement|Sponsored content|Buy now and save|Special offer|Promoted", "form": "Search|Your e-mail|Subscribe to our newsletter|Sign up|Log in|Password|Send|Name",
    "comments": "Comments|Reply|2 hours ago|Leave a reply|Log in to comment|3 replies|Posted by", "share": "Share|Tweet|Follow us|Print|Share this on|Tags", "meta": "By|Published|Updated|5 min read",
    "sidebar": "Related|Most read|Read more|Trending now|You may also like|Popular", "footer": "All rights reserved.|Imprint|Terms of use|Privacy|Copyright|Contact us", "header": "The daily page|Menu|Welcome",
}


class _Maker:
    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts = rng, texts
        # whether elements have the tags that say what they mean, and names that do, with a prefix of the site's
        self.tags = rng.random() < 0.5
        self.named = not self.tags or rng.random() < 0.7
        self.prefix = rng.choice(["", "", "", "site-", "x-", "td-", "c-"])
        self.closing = rng.random() < 0.8

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self, most: int = 60) -> str:
        if self.texts and self.chance(0.9):
            words = self.rng.choice(self.texts).split()
            at = self.rng.randrange(len(words))
            words = words[at : at + self.rng.randint(1, most)]
        else:
            words = ["".join(self.rng.choices("abcdefghiklmnoprstuvw", k=self.rng.randint(2, 9))) for _ in range(self.rng.randint(1, most))]
        text = " ".join(words)
        return escape(text[:1].upper() + text[1:] + ("" if text.endswith(".") or self.chance(0.2) else "."), quote=False)

    def words(self, k: int) -> str:
        return self.prose(k).rstrip(".")

    def short(self, kind: str) -> str:
        return self.rng.choice(_SHORT[kind].split("|")) if self.chance(0.5) else self.words(4)

    def open(self, kind: str, label: str = OTHER) -> tuple[str, str]:
        tag, names = _PARTS[kind]
        tag = tag if self.tags and self.chance(0.9) or kind == "form" and self.chance(0.8) else self.rng.choice(["div", "div", "div", "section", "table"] if kind == "wrapper" else ["div", "div", "section"])
        if tag == "table":
            tag = "div"
        name = self.prefix + self.rng.choice(names.split()) if self.named or tag == "div" else ""
        if name and self.chance(0.15):
            name = " ".join([name, self.rng.choice(["left", "clearfix", "wide", "inner", "grid", "section", "block", "js-x1", "is-open"])])
        return f"<{tag} {label}" + (f' {self.rng.choice(["class", "class", "class", "id"])}="{name}"' if name else "") + ">", f"</{tag}>"

    def inside(self, kind: str, body: str, label: str = OTHER) -> str:
        begin, end = self.open(kind, label)
        return begin + body + end

    def links(self, kind: str, most: int = 8) -> str:
        items = [f'<a href="/{k}">{self.short(kind) if self.chance(0.3) else self.words(self.rng.choice([1, 2, 8]))}</a>' for k in range(self.rng.randint(2, most))]
        way = self.rng.random()
        if way < 0.6:
            return "<ul>" + "".join(f"<li>{i}" + ("</li>" if self.closing else "") for i in items) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(items) if way < 0.85 else "".join(f"<div>{i}</div>" for i in items)

    def menu(self) -> str:
        return self.inside("menu", self.links("menu"))

    def header(self) -> str:
        return self.inside("header", f"<{(h := self.rng.choice(['h1', 'div', 'p', 'h2']))}>{self.short('header')}</{h}>" + (f"<p>{self.prose(10)}</p>" if self.chance(0.4) else "") + (self.menu() if self.chance(0.4) else ""))

    def footer(self) -> str:
        body = self.rng.choice(["&copy; ", "© 2024 ", ""]) + self.words(4) + self.rng.choice([" &middot; ", " | ", ". "]) + (self.prose(14) if self.chance(0.6) else self.short("footer"))
        body = f"<p>{body}</p>" if self.chance(0.5) else body
        return self.inside("footer", body + (self.links("footer", 4) if self.chance(0.4) else "") + (f"<div>{self.prose(20)}</div>" if self.chance(0.2) else ""))

    def sidebar(self) -> str:
        head = f"<{(h := self.rng.choice(['h2', 'h3', 'h4', 'div']))}>{self.short('sidebar')}</{h}>" if self.chance(0.8) else ""
        return self.inside("sidebar", head + (self.links("sidebar") if self.chance(0.6) else "".join(f"<p>{self.prose(30)}</p>" for _ in range(self.rng.randint(1, 3)))))

    def notice(self) -> str:
        body = self.prose(30) if self.chance(0.4) else self.short("notice")
        return self.inside("notice", (f"<p>{body}</p>" if self.chance(0.6) else body) + ("<button>OK</button>" if self.chance(0.5) else "") + (f'<a href="/p">{self.short("notice")}</a>' if self.chance(0.4) else ""))

    def advert(self) -> str:
        body = self.prose(30) if self.chance(0.7) else self.short("advert")
        return self.inside("advert", (f"<p>{body}</p>" if self.chance(0.4) else f'<a href="/ad">{body}</a>' if self.chance(0.3) else body) + (f"<p>{self.prose(20)}</p>" if self.chance(0.2) else ""))

    def form(self) -> str:
        return self.inside("form", "".join(f"<{(t := self.rng.choice(['label', 'p', 'div', 'legend']))}>{self.short('form') if self.chance(0.7) else self.prose(12)}</{t}><input name=q>" for _ in range(self.rng.randint(1, 3))))

    def share(self) -> str:
        return self.inside("share", self.links("share", 4) if self.chance(0.6) else f"<span>{self.short('share')}</span> <span>{self.words(3)}</span>")

    def meta(self) -> str:
        return self.inside("meta", f"{self.short('meta')} {self.words(3)}" + (f"<time>{self.rng.randint(1, 28)} May 20{self.rng.randint(10, 26)}</time>" if self.chance(0.6) else ""))

    def comments(self) -> str:
        each = []
        for _ in range(self.rng.randint(1, 5)):
            who = f"<{(t := self.rng.choice(['b', 'div', 'cite', 'h4', 'span']))}>{self.words(2)}</{t}>" + (f"<span>{self.short('comments')}</span>" if self.chance(0.4) else "")
            each.append(f"{who}<p>{self.prose(50)}</p>" if self.chance(0.8) else f"{who} {self.prose(40)}")
        one = self.rng.choice(["div", "li", "article", "p"])
        name = ' class="comment"' if self.named and self.chance(0.6) else ""
        each = [f"<{one} {OTHER}{name}>{x}</{one}>" if one != "p" else f"<div{name}>{x}</div>" for x in each]
        head = f"<{(h := self.rng.choice(['h2', 'h3', 'div']))}>{self.short('comments')}</{h}>" if self.chance(0.7) else ""
        return self.inside("comments", head + (f"<ul>{''.join(each)}</ul>" if one == "li" else "".join(each)) + (self.form() if self.chance(0.3) else ""))

    def stray(self) -> str:
        """What articles have now and then that looks like what isn't theirs: numbers, addresses, terms of licences, the words of notices."""
        digits = lambda k: "".join(self.rng.choices("0123456789", k=k))
        return self.rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", digits(4), f"{digits(3)}.{digits(2)}.{digits(2)}.{digits(1)}", f"{self.words(1)}@example.com", "Copyright (c) 2020. All rights reserved.", "* | # | &amp;", self.short(self.rng.choice(list(_SHORT)))])

    def paragraph(self) -> str:
        way, text = self.rng.random(), self.prose(self.rng.choice([3, 20, 60, 120, 200]))
        if self.chance(0.15):
            words = text.split()
            k = self.rng.randrange(len(words))
            words[k] = f'<{(t := self.rng.choice(["a href=/x", "b", "em"]))}>{words[k]}</{t.split()[0]}>'
            text = " ".join(words)
        if self.chance(0.15):  # articles speak of such things too
            text = self.rng.choice([f"{text} {self.stray()}", f"{self.stray()} {text}", self.stray(), f"{self.stray()} {self.stray()} {self.words(6)}"])
        if way < 0.08:
            return f"<{(h := self.rng.choice(['h2', 'h3', 'h4']))}>{self.words(7)}</{h}>"
        if way < 0.14:
            return "<ul>" + "".join(f"<li>{self.prose(15)}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>"
        if way < 0.18:
            return f"<blockquote><p>{text}</p></blockquote>" if self.chance(0.5) else f"<blockquote>{text}</blockquote>"
        if way < 0.21:
            return f"<figure><img src=x.png><figcaption>{self.prose(15)}</figcaption></figure>"
        if way < 0.23:
            return "<table>" + "".join(f"<tr><td>{self.words(3)}</td><td>{self.rng.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>"
        if way < 0.25:
            return f"<pre>{text}</pre>"
        if way < 0.33:
            return f"<div>{text}</div>"
        if way < 0.38:
            return f"<p><b>{text}<br>"
        return f"<p>{text}" + ("</p>" if self.closing else "")

    def article(self) -> str:
        title = f"<{(h := self.rng.choice(['h1', 'h1', 'h1', 'h2']))}>{self.words(12)}</{h}>"
        if self.chance(0.25):
            title = f"<header {CONTENT}>{title}{self.meta() if self.chance(0.5) else ''}</header>"
        elif self.chance(0.3):
            title += self.meta()
        body = [self.paragraph() for _ in range(self.rng.choice([1, 2, 4, 8, 15]))]
        for make, p in ((self.advert, 0.45), (self.sidebar, 0.2), (self.share, 0.2), (self.notice, 0.12), (self.form, 0.12)):
            if self.chance(p):
                body.insert(self.rng.randint(0, len(body)), make())
        inner = "".join(body)
        if self.chance(0.3):
            inner = self.inside("article", inner, CONTENT)
        tail = "".join(make() for make, p in ((self.share, 0.15), (self.meta, 0.1), (self.sidebar, 0.12), (self.comments, 0.2), (self.footer, 0.1)) if self.chance(p))
        return self.inside("article", title + inner + tail, CONTENT)

    def page(self) -> str:
        ahead = [make() for make, p in ((self.notice, 0.3), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.2), (self.menu, 0.15)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(ahead)
        around = [self.article()]
        for make, p in ((self.sidebar, 0.35), (self.advert, 0.2), (self.menu, 0.1)):
            if self.chance(p):
                around.insert(self.rng.randint(0, len(around)), make())
        if self.chance(0.25):
            around.append(self.comments())
        middle = "".join(around)
        if self.chance(0.5):
            middle = self.inside("wrapper", middle)
        behind = [make() for make, p in ((self.comments, 0.12), (self.form, 0.2), (self.sidebar, 0.2), (self.advert, 0.15), (self.notice, 0.15)) if self.chance(p)]
        behind += [self.footer()] if self.chance(0.85) else []
        return f"<!DOCTYPE html><html><head><title>{self.words(6)}</title><style>p{{margin:0}}</style></head><body>{''.join(ahead)}{middle}{''.join(behind)}</body></html>"


def labelled_page(rng: random.Random, texts: list[str]) -> str:
    """A page made of texts (made-up words where there are none), each of whose parts has an element that is labelled."""
    return _Maker(rng, texts).page()
