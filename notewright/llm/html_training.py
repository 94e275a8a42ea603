"""Labelled pages for the HTML extractor, made by rule: layouts, their names and their text vary, labels are known.

No table holds labelled pages, so the extractor's training set is this generator with a fixed seed. A page is built
from parts that are main text or not; each block's text is a new random string, which tells its label after parsing.
"""

from __future__ import annotations

import random

#: Names that web pages give to their parts.
MAIN_NAMES = "content main article post entry story body text page-content post-content entry-content article-body story-body article-text main-content blog-post hentry prose".split()
MENU_NAMES = "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs toolbar tabs pagination pager mega-menu links".split()
HEADER_NAMES = "header site-header masthead top-bar banner branding logo page-header-bar".split()
FOOTER_NAMES = "footer site-footer bottom copyright colophon page-footer legal foot".split()
SIDE_NAMES = "sidebar aside secondary widget widget-area rail right-rail related related-posts recommended popular trending more-stories read-more see-also tags tag-cloud".split()
NOTICE_NAMES = "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal overlay privacy-banner paywall subscribe-banner".split()
AD_NAMES = "ad ads advert advertisement sponsored sponsor promo promotion ad-slot adsbygoogle banner-ad ad-container partner".split()
FORM_NAMES = "form search search-form newsletter signup subscribe login contact-form register".split()
COMMENT_NAMES = "comments comment comment-list comment-body respond discussion replies reply disqus user-comments reader-comments".split()
SHARE_NAMES = "share social social-links share-buttons follow".split()
LAYOUT_NAMES = "layout wrapper container page outer frame".split()
THREAD_NAMES = "thread topic forum-thread discussion-topic".split()
MESSAGE_NAMES = "message post topic-post message-body post-body postcontent".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}

    def words(self, low: int, high: int) -> str:
        r = self.r
        letters = "abcdefghijklmnopqrstuvwxyzéüñö"
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def text(self, label: int, low: int, high: int, stop: float) -> str:
        r = self.r
        out, left = [], r.randint(low, high)
        while left > 0:
            n = min(left, r.randint(4, 16))
            s = self.words(n, n)
            out.append(s[:1].upper() + s[1:] + (r.choice(".....?!") if r.random() < stop else ""))
            left -= n
        s = " ".join(out)
        if r.random() < 0.12:
            s += f" {r.randint(1, 2030)}"
        if r.random() < 0.1:
            s = " ".join(w + r.choice(["***", "%%%", "###", "$$$"]) for w in s.split())
        self.labels[s] = label
        return s

    def inside(self, s: str) -> str:
        """The text with inline markup somewhere."""
        r = self.r
        if r.random() < 0.25 and " " in s:
            w = s.split(" ")
            i = r.randrange(len(w))
            w[i] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(w[i])
            return " ".join(w)
        return s

    def named(self, tag: str, names: list[str], inner: str, chance: float = 0.9) -> str:
        r = self.r
        if r.random() > chance:
            return f"<{tag}>{inner}</{tag}>"
        n = r.choice(names)
        how = r.choice([' class="{}"', ' id="{}"', ' class="{} x1"', ' class="c-{}"'])
        return f"<{tag}{how.format(n)}>{inner}</{tag}>"

    def menu(self, wrap: bool = True) -> str:
        r = self.r
        items = "".join(f'<li><a href="/{i}">{self.text(0, 1, 3, 0)}</a></li>' for i in range(r.randint(2, 8)))
        body = f"<ul>{items}</ul>" if r.random() < 0.8 else "".join(f'<div><a href="/{i}">{self.text(0, 1, 2, 0)}</a></div>' for i in range(r.randint(2, 6)))
        return (self.named("nav", MENU_NAMES, body, 0.3) if r.random() < 0.6 else self.named("div", MENU_NAMES, body, 1)) if wrap else body

    def header(self) -> str:
        r = self.r
        parts = [f'<a href="/"><div>{self.text(0, 1, 4, 0)}</div></a>']
        if r.random() < 0.5:
            parts.append(f"<p>{self.text(0, 3, 10, 0.5)}</p>")
        if r.random() < 0.6:
            parts.append(self.menu())
        return self.named("header", HEADER_NAMES, "".join(parts), 0.4) if r.random() < 0.6 else self.named("div", HEADER_NAMES, "".join(parts), 1)

    def footer(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.4:
            parts.append(self.menu(r.random() < 0.5))
        t = self.text(0, 2, 25, 0.6)
        if r.random() < 0.5:
            self.labels["© " + t] = 0
            parts.append(f"&copy; {t}" if r.random() < 0.5 else f"<p>&copy; {t}</p>")
        else:
            parts.append(f"<p>{t}</p>" if r.random() < 0.6 else t)
        return self.named("footer", FOOTER_NAMES, "".join(parts), 0.3) if r.random() < 0.7 else self.named("div", FOOTER_NAMES, "".join(parts), 1)

    def side(self) -> str:
        r = self.r
        parts = []
        for _ in range(r.randint(1, 3)):
            kind = r.random()
            parts.append(f"<h3>{self.text(0, 1, 4, 0)}</h3>" + (self.menu(False) if kind < 0.6 else f"<p>{self.text(0, 8, 40, 0.8)}</p>"))
        return self.named("aside", SIDE_NAMES, "".join(parts), 0.5) if r.random() < 0.5 else self.named("div", SIDE_NAMES, "".join(parts), 1)

    def notice(self) -> str:
        r = self.r
        inner = f"<p>{self.text(0, 5, 30, 0.9)}</p>" if r.random() < 0.6 else self.text(0, 5, 30, 0.9)
        return self.named(r.choice(["div", "div", "section", "aside"]), NOTICE_NAMES, inner, 1)

    def advert(self) -> str:
        r = self.r
        inner = self.text(0, 2, 30, 0.7)
        inner = inner if r.random() < 0.6 else f"<p>{inner}</p>"
        return self.named(r.choice(["div", "div", "div", "aside", "section"]), AD_NAMES, inner, 1)

    def form(self) -> str:
        inner = f"<p>{self.text(0, 2, 14, 0.5)}</p><label>{self.text(0, 1, 3, 0)}</label><input name='q'><button>ok</button>"
        f = f"<form action='/s'>{inner}</form>"
        return self.named("div", FORM_NAMES, f, 1) if self.r.random() < 0.5 else f

    def comments(self) -> str:
        r = self.r
        rows = []
        for _ in range(r.randint(1, 6)):
            who = f"<div class='{r.choice(['author', 'meta', 'name'])}'>{self.text(0, 1, 3, 0)}</div>"
            rows.append((who if r.random() < 0.6 else "") + f"<p>{self.text(0, 3, 60, 0.85)}</p>")
        head = f"<h3>{self.text(0, 1, 3, 0)}</h3>" if r.random() < 0.7 else ""
        if r.random() < 0.5:
            body = "<ol>" + "".join(self.named("li", COMMENT_NAMES, x, 0.6) for x in rows) + "</ol>"
        else:
            body = "".join(self.named("div", COMMENT_NAMES, x, 0.8) for x in rows)
        return self.named(r.choice(["div", "section", "section"]), COMMENT_NAMES, head + body, 1)

    def share(self) -> str:
        return self.named("div", SHARE_NAMES, f'<a href="#">{self.text(0, 1, 2, 0)}</a><br>', 1)

    def article(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.85:
            h = f"<h1>{self.text(1, 1, 12, 0.3)}</h1>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.randint(0, 10) if r.random() < 0.95 else 0):
            k = r.random()
            if k < 0.62:
                t = self.inside(self.text(1, 1 if r.random() < 0.2 else 8, 90, 0.9))
                parts.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(t))
            elif k < 0.72:
                parts.append(f"<h{r.choice('234')}>{self.text(1, 1, 8, 0.2)}</h2>")
            elif k < 0.80:
                tag = r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{self.inside(self.text(1, 2, 20, 0.5))}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif k < 0.84:
                parts.append(f"<blockquote><p>{self.text(1, 5, 40, 0.9)}</p></blockquote>")
            elif k < 0.88:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(1, 1, 5, 0)}</td><td>{self.text(1, 1, 5, 0)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.90:
                parts.append(f"<pre>{self.text(1, 3, 30, 0.3)}</pre>")
            elif k < 0.92:
                parts.append(f"<figure><img src='a.png'><figcaption>{self.text(1, 3, 15, 0.5)}</figcaption></figure>")
            elif k < 0.96:
                parts.append(self.advert())
            elif k < 0.98:
                parts.append(self.side())
            else:
                parts.append(self.form() if r.random() < 0.5 else self.share())
        inner = "".join(parts)
        k = r.random()
        if k < 0.4:
            return self.named("article", MAIN_NAMES, inner, 0.3)
        if k < 0.55:
            return self.named("main", MAIN_NAMES, inner, 0.3)
        if k < 0.9:
            return self.named(r.choice(["div", "div", "section"]), MAIN_NAMES, inner, 0.9)
        return inner

    def page(self) -> str:
        r = self.r
        top = [f() for f, p in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.65), (self.advert, 0.35), (self.form, 0.1)) if r.random() < p]
        end = [f() for f, p in ((self.share, 0.15), (self.comments, 0.35), (self.side, 0.4), (self.advert, 0.25), (self.form, 0.2), (self.menu, 0.15), (self.notice, 0.12), (self.footer, 0.8)) if r.random() < p]
        if r.random() < 0.05:
            top, end = [], []
        middle = self.article()
        if r.random() < 0.2:
            middle = f"<div class='{r.choice(['wrapper', 'container', 'row', 'layout', 'page'])}'>{middle}{self.side() if r.random() < 0.5 else ''}</div>"
        title = self.words(2, 8)
        return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body>{''.join(top)}{middle}{''.join(end)}</body></html>"

    def paragraphs(self, low: int, high: int) -> str:
        r = self.r
        head = f"<h1>{self.text(1, 1, 12, 0.2)}</h1>" if r.random() < 0.4 else ""
        return head + "".join(f"<p>{self.inside(self.text(1, 1, 6 if r.random() < 0.25 else 90, 0.95))}</p>" for _ in range(r.randint(low, high)))

    def short_page(self) -> str:
        """Few paragraphs and nothing else, or next to nothing: bare, in an article, in a named part."""
        r = self.r
        inner = self.paragraphs(1, 3)
        k = r.random()
        if k < 0.3:
            inner = f"<article>{inner}</article>"
        elif k < 0.45:
            inner = self.named(r.choice(["main", "div", "section"]), MAIN_NAMES, inner, 0.7)
        end = self.footer() if r.random() < 0.2 else ""
        k = r.random()
        if k < 0.4:
            return inner + end
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{inner}{end}</body></html>" if k < 0.8 else f"<body>{inner}{end}</body>"

    def thread_page(self) -> str:
        """A thread of one message: who wrote it is not its text."""
        r = self.r
        who = self.named(r.choice(["div", "p"]), ["author", "meta", "username", "poster", "user-info"], self.text(0, 1, 3, 0), 1)
        body = "".join(f"<p>{self.inside(self.text(1, 3, 80, 0.95))}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.6 else self.text(1, 3, 80, 0.95)
        message = self.named("div", MESSAGE_NAMES, (who if r.random() < 0.7 else "") + self.named("div", MESSAGE_NAMES, body, 0.6), 1)
        title = f"<{r.choice(['h1', 'h2'])}>{self.text(1, 2, 10, 0.2)}</h1>" if r.random() < 0.8 else ""
        thread = self.named(r.choice(["div", "section", "main"]), THREAD_NAMES, title + message, 0.8)
        return f"<html><body>{self.menu() if r.random() < 0.5 else ''}{thread}{self.form() if r.random() < 0.4 else ''}{self.footer() if r.random() < 0.5 else ''}</body></html>"

    def table_page(self) -> str:
        """A page laid out as a table: a banner's row, a menu's cell, the text's cell, a row at the foot."""
        r = self.r
        links = [f"<a href='/{i}'>{self.text(0, 1, 3, 0)}</a>" for i in range(r.randint(2, 7))]
        menu = r.choice(["<br>".join(links), "".join(f"<div>{x}</div>" for x in links), "".join(f"<p>{x}</p>" for x in links), " | ".join(links)])
        cells = [f"<td>{menu}</td>", self.named("td", MAIN_NAMES, self.paragraphs(1, 6), 0.2)]
        if r.random() < 0.3:
            cells.append(f"<td>{self.side()}</td>")
        banner = f"<tr><td colspan='2'>{r.choice(['<h1>{}</h1>', '<b>{}</b>', '{}']).format(self.text(0, 1, 4, 0))}</td></tr>" if r.random() < 0.6 else ""
        foot = f"<tr><td colspan='2'>&copy; {self.text(0, 2, 10, 0.4)}</td></tr>" if r.random() < 0.6 else ""
        return f"<html><body>{self.named('table', LAYOUT_NAMES, f'{banner}<tr>{"".join(cells)}</tr>{foot}', 0.4)}</body></html>"

    def titled_page(self) -> str:
        """The site's own title as a first heading of its header; notices that are named paragraphs."""
        r = self.r
        tag = r.choice(["h1", "h1", "h2"])
        head = f"<{tag}>{self.text(0, 1, 4, 0)}</{tag}>" + (f"<p>{self.text(0, 3, 9, 0.4)}</p>" if r.random() < 0.5 else "") + (self.menu() if r.random() < 0.5 else "")
        top = self.named("header", HEADER_NAMES, head, 0.4)
        note = lambda: self.named("p", [*NOTICE_NAMES, "disclaimer", "disclaimer notice", "warning", "legal-notice"], self.text(0, 5, 30, 0.95), 1)
        middle = self.article() if r.random() < 0.5 else self.named("article" if r.random() < 0.5 else "div", MAIN_NAMES, self.paragraphs(1, 6), 0.6)
        return f"<html><body>{top}{note() if r.random() < 0.5 else ''}{middle}{note() if r.random() < 0.6 else ''}{self.footer() if r.random() < 0.6 else ''}</body></html>"

    def odd_page(self) -> str:
        """A page of a kind that ``page`` never makes."""
        return self.r.choice([self.short_page, self.thread_page, self.table_page, self.titled_page])()
