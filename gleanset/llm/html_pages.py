"""Labelled pages to train the page model on, made by rule from a seed.

The tables have no labels for pages, so the model learns from layouts written here. Each block of a page
is known to be content or not when it is written; a marker attribute carries that into the tree and is
taken away before features are computed. Words are invented, so nothing can be learned from them.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

from gleanset.llm.html_main import NAME_GROUP, Node, TreeModel, fit, tree

#: Pages that the model is trained on.
PAGES = 400
#: Written before every block of content and removed again; no page can hold it by chance.
MARK = "\ue000"


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = True

    def words(self, low: int, high: int) -> str:
        part = ("an", "be", "cor", "di", "el", "fu", "gan", "ho", "in", "ka", "lo", "mer", "no", "pra", "qui", "ro", "sta")
        out = ["".join(self.r.choices(part, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high))]
        return " ".join(out).capitalize()

    def sentence(self, low: int = 3, high: int = 25) -> str:
        end = self.r.choice((".", ".", ".", "!", "?"))
        return self.words(low, high) + (end if self.plain else self.r.choice((end + "###", "***", " |", "&&&")))

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 9))))

    def named(self, tag: str, names: tuple[str, ...], chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return f"<{tag}>"
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}">'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(n))

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        body = self.links(self.r.randint(2, 9))
        open_ = self.named(tag, ("menu", "nav", "main-nav", "navbar", "breadcrumb", "top-menu"), 0.5 if tag == "nav" else 1)
        return f"{open_}{body if tag == 'ul' else f'<ul>{body}</ul>'}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        inner = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 7)}</p>", f"<a href='/'>{self.words(1, 2)}</a>"))
        menu = self.menu() if self.r.random() < 0.4 else ""
        return f"{self.named(tag, ('header', 'masthead', 'site-header', 'topbar'), 0.5 if tag == 'header' else 1)}{inner}{menu}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "footer", "div"))
        bits = [f"&copy; {self.words(1, 2)} &middot; {self.sentence(2, 9)}", f"<p>{self.sentence(2, 9)}</p>", f"<ul>{self.links(3)}</ul>", f"<p>{self.sentence(4, 14)} {self.sentence(4, 14)}</p>"]
        inner = "".join(self.r.sample(bits, self.r.randint(1, 3)))
        return f"{self.named(tag, ('footer', 'site-footer', 'copyright', 'legal'), 0.3 if tag == 'footer' else 1)}{inner}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        inner = self.r.choice((self.sentence(3, 12), self.paragraph(), f"<a href='/b'>{self.words(2, 6)}</a>"))
        if tag != "p" and self.r.random() < 0.4:
            inner = f"<p>{inner}</p>"
        return f"{self.named(tag, ('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'banner'), 1)}{inner}</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        bits = [f"<h3>{self.words(1, 4)}</h3>", f"<ul>{self.links(self.r.randint(2, 6))}</ul>", f"<p>{self.paragraph()}</p>", f"<p>{self.sentence(3, 9)}</p>"]
        inner = "".join(self.r.sample(bits, self.r.randint(1, 3)))
        return f"{self.named(tag, ('sidebar', 'related', 'widget', 'side', 'recommended', 'rail'), 0.5 if tag == 'aside' else 1)}{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "div", "section", "dialog"))
        inner = self.r.choice(("{0}", "<p>{0}</p><button>{1}</button>", "{0} <a href='/p'>{1}</a>", "<p>{0}</p>")).format(
            self.paragraph() if self.r.random() < 0.4 else self.sentence(5, 18), self.words(1, 2)
        )
        return f"{self.named(tag, ('cookie', 'cookie-notice', 'consent', 'notice', 'newsletter', 'alert', 'popup', 'gdpr'), 1)}{inner}</{tag}>"

    def form(self) -> str:
        inner = self.r.choice(
            (f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>", f"<p>{self.sentence(3, 12)}</p><input name=q><button>{self.words(1, 1)}</button>")
        )
        return f"{self.named('form', ('search', 'login', 'subscribe', 'contact'), 0.4)}{inner}</form>"

    def comments(self) -> str:
        tag = self.r.choice(("section", "div", "ol"))
        each = self.r.choice(("<div class='comment'><p>{}</p></div>", "<li class='comment'>{}</li>", "<article class='comment'><p>{}</p></article>", "<p>{}</p>"))
        inner = "".join(each.format(self.paragraph()) for _ in range(self.r.randint(1, 5)))
        title = f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.5 and tag != "ol" else ""
        return f"{self.named(tag, ('comments', 'comment-list', 'reader-comments', 'discussion', 'replies'), 1)}{title}{inner}</{tag}>"

    def share(self) -> str:
        return f"{self.named('div', ('share', 'social', 'share-buttons', 'follow', 'tags', 'meta'), 1)}{self.r.choice((self.words(1, 4), f'<ul>{self.links(3)}</ul>'))}</div>"

    def opening(self) -> str:
        """The article's heading, now and then in a header of its own with a line below."""
        title = f"<h1>{MARK}{self.words(1, 12)}{self.r.choice(('', '.'))}</h1>"
        if self.r.random() < 0.75:
            return title
        lead = f"<p>{MARK}{self.sentence(3, 20)}</p>" if self.r.random() < 0.5 else ""
        return f"{self.named('header', ('entry-header', 'post-header', 'article-header', 'header'), 0.5)}{title}{lead}</header>"

    def article(self) -> str:
        """Content blocks, each marked, with now and then something foreign between them. In some pages
        sentences do not end as they should."""
        self.plain = self.r.random() < 0.85
        out = [self.opening()] if self.r.random() < 0.85 else []
        if self.r.random() < 0.15:  # a very short article
            title = self.sentence(1, 3)
            return f"<h1>{MARK}{title}</h1><p>{MARK}{self.r.choice((title, self.sentence(1, 4)))}</p>"
        foreign = (self.advert, self.share, self.side, self.notice, self.form)
        for _ in range(self.r.choice((1, 2, 3, 5, 8, 13, 20))):
            kind = self.r.random()
            if kind < 0.05:  # names that hold a word of other parts by chance
                tag = self.r.choice(("p", "p", "p", "h2", "blockquote", "pre"))
                name = self.r.choice(tuple(NAME_GROUP))
                name = self.r.choice((f"{name}-{self.words(1, 1).lower()}", f"{self.words(1, 1).lower()}-{name}", f"{self.words(1, 1).lower()}_{name}"))
                out.append(f'<{tag} class="{name}">{MARK}{self.paragraph()}</{tag}>')
            elif kind < 0.7:
                out.append(f"<p>{MARK}{self.paragraph() if self.r.random() < 0.85 else self.sentence(1, 3)}</p>")
            elif kind < 0.8:  # a short block, an open inline element, no end tag
                out.append(self.r.choice((f"<p>{MARK}{self.words(1, 2)}.</p>", f"<p><b>{MARK}{self.paragraph()}<br>", f"<p>{MARK}{self.paragraph()}")))
            elif kind < 0.85:
                out.append(f"<h{(k := self.r.randint(2, 4))}>{MARK}{self.words(1, 8)}</h{k}>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(2, 12)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>{MARK}{self.paragraph()}</blockquote>")
            elif kind < 0.94:
                out.append(
                    self.r.choice(
                        (f"<pre>{MARK}{self.paragraph()}</pre>", f"<figure><img src=x><figcaption>{MARK}{self.sentence(2, 12)}</figcaption></figure>")
                    )
                )
            elif kind < 0.95:
                out.append(f"<table><tr><td>{MARK}{self.words(1, 5)}</td><td>{MARK}{self.words(1, 5)}</td></tr></table>")
            else:
                out.append(self.r.choice(foreign)())
        return "".join(out)

    def page(self) -> str:
        body = self.article()
        tag, names, chance = self.r.choice(
            (
                ("article", ("post", "article"), 0.2), ("article", ("story",), 0.1), ("main", ("main",), 0.2),
                ("div", ("content", "article-body", "post", "entry-content", "story", "text"), 1.0), ("div", ("x1", "c-2", "wrap"), 0.6),
                ("section", ("content", "post"), 0.5),
            )
        )
        body = f"{self.named(tag, names, chance)}{body}</{tag}>"
        if self.r.random() < 0.3:
            body = f"{self.named(self.r.choice(('main', 'div')), ('main', 'content', 'page', 'wrapper'), 0.6)}{body}"
        self.plain = True
        before = [f() for f in (self.menu, self.header, self.advert, self.notice, self.form, self.side) if self.r.random() < 0.4]
        after = [f() for f in (self.comments, self.side, self.share, self.advert, self.form, self.notice) if self.r.random() < 0.35]
        if self.r.random() < 0.8:
            after.append(self.footer())
        self.r.shuffle(before)
        end = "</body></html>" if self.r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}{end}"


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """The tree of a marked page without the marks, and 1 for nodes that hold content themselves or, if
    they have no text of their own, in a node below."""
    nodes = tree(page)
    label = np.zeros(len(nodes), int)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        marked = any(MARK in t for _, t in node.texts)
        node.texts = [(o, t.replace(MARK, "")) for o, t in node.texts]
        label[i] = label[i] or marked
        if label[i] and node.parent >= 0 and not nodes[node.parent].texts:
            label[node.parent] = 1
    return nodes, label


@cache
def trained(pages: int = PAGES, seed: int = 42) -> TreeModel:
    """The same model for the same number and seed, trained once a process."""
    writer = Writer(seed)
    return fit([labelled(writer.page()) for _ in range(pages)])
