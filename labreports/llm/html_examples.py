"""Labelled pages to train on: made-up pages whose every block is known to be article or not."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_SYLLABLES = "an er in on st re nd ou le de ch ei un la mo ti va su po ka ri to me".split()
# Names that pages give to their parts.
NOISE_NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs tabs pagination pager toc",
    "header": "header site-header masthead topbar banner logo branding page-header",
    "footer": "footer site-footer copyright legal bottom colophon footer-links",
    "aside": "sidebar aside widget right-rail related related-posts recommended trending popular tags",
    "notice": "cookie cookie-notice consent gdpr notice alert popup modal overlay privacy-banner message",
    "ad": "ad ads advert advertisement sponsored promo promoted banner-ad sponsor ad-slot adsense",
    "form": "form newsletter subscribe signup search login contact-form search-box poll",
    "share": "share social social-links sharing follow share-buttons",
    "comments": "comments comment comment-list disqus replies responses discussion reader-comments user-comment",
}
CONTENT_NAMES = (
    "content article post entry entry-content post-content article-body story story-body main "
    "body-text text main-content post-body"
).split()
_WRAPPERS = "wrapper container page row col inner outer layout grid section box block app root".split()


@dataclass
class _Page:
    random: np.random.Generator
    html: list[str] = field(default_factory=list)
    labels: list[bool] = field(default_factory=list)

    def pick(self, items):
        return items[int(self.random.integers(len(items)))]

    def chance(self, share: float) -> bool:
        return self.random.random() < share

    def words(self, low: int, high: int) -> str:
        count = int(self.random.integers(low, high + 1))
        made = ["".join(self.pick(_SYLLABLES) for _ in range(self.random.integers(1, 4))) for _ in range(count)]
        text = " ".join(made).capitalize()
        return text + self.pick([".", ".", ".", "!", "?", "", ":"]) if count > 4 else text

    def block(self, tag: str, text: str, content: bool, link: bool = False) -> None:
        text = f'<a href="/{len(self.labels)}">{text}</a>' if link else text
        self.html.append(f"<{tag}>{text}</{tag}>" if tag else f"{text}<hr>")
        self.labels.append(content)

    def named(self, names: str | list[str]) -> str:
        names = names.split() if isinstance(names, str) else names
        return f'{self.pick(["class", "class", "id"])}="{self.pick(names)}"'

    def noise(self, kind: str) -> None:
        tags = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        names = self.named(NOISE_NAMES[kind])
        plain = self.chance(0.4)
        if kind in tags and not plain:
            tag, attributes = tags[kind], names if self.chance(0.4) else ""
        else:
            tag, attributes = self.pick(["div", "div", "section", "ul" if kind == "nav" else "div"]), names
        if kind == "comments":
            tag = self.pick(["div", "section", "ol"])
        self.html.append(f"<{tag} {attributes}>")
        if kind == "nav" or (kind in ("footer", "aside", "share") and self.chance(0.5)):
            if kind != "nav" and self.chance(0.5):
                self.block(self.pick(["h3", "h4", "p"]), self.words(1, 4), False)
            item = "li" if self.chance(0.8) else "div"
            self.html.append("<ul>" if item == "li" and tag != "ul" else "<div>")
            for _ in range(self.random.integers(2, 9)):
                self.block(item, self.words(1, 5), False, link=self.chance(0.9))
            self.html.append("</ul>" if item == "li" and tag != "ul" else "</div>")
        elif kind == "comments":
            if self.chance(0.6):
                self.block(self.pick(["h2", "h3", "h4"]), self.words(1, 3), False)
            for _ in range(self.random.integers(1, 7)):
                inner = self.pick(['div class="comment"', "li", "div", "article", 'div class="reply"'])
                self.html.append(f"<{inner}>")
                if self.chance(0.5):
                    self.block(self.pick(["h4", "div", "p"]), self.words(1, 3), False, self.chance(0.3))
                for _ in range(self.random.integers(1, 3)):
                    self.block(self.pick(["p", "p", "div"]), self.words(3, 60), False)
                self.html.append(f"</{inner.split()[0]}>")
        elif kind == "form":
            for _ in range(self.random.integers(1, 4)):
                self.block(self.pick(["label", "p", "h3", "button", "option", "legend"]), self.words(1, 12), False)
            self.html.append('<input type="text">')
            self.block("button", self.words(1, 2), False)
        else:
            if self.chance(0.3):
                self.block(self.pick(["h2", "h3", "h1" if kind == "header" else "h4"]), self.words(1, 6), False)
            for _ in range(self.random.integers(1, 4)):
                self.block(self.pick(["p", "p", "div", "", "li"]), self.words(1, 40), False, self.chance(0.2))
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        tag, attributes = self.pick(
            [("article", ""), ("article", self.named(CONTENT_NAMES)), ("main", ""), ("div", self.named(CONTENT_NAMES)), ("section", self.named(CONTENT_NAMES))]
        )
        self.html.append(f"<{tag} {attributes}>")
        if self.chance(0.85):
            inner = self.chance(0.15)
            self.html.append("<header>" if inner else "")
            self.block("h1", self.words(2, 12), True)
            self.html.append("</header>" if inner else "")
        for _ in range(self.random.integers(1, 14)):
            kind = self.random.random()
            if kind < 0.7:
                self.block("p", self.words(1, 90), True, self.chance(0.02))
            elif kind < 0.76:
                self.block(self.pick(["h2", "h3", "h4"]), self.words(1, 8), True)
            elif kind < 0.82:
                self.html.append(list_tag := self.pick(["<ul>", "<ol>"]))
                for _ in range(self.random.integers(1, 6)):
                    self.block("li", self.words(1, 25), True, self.chance(0.1))
                self.html.append(list_tag.replace("<", "</"))
            elif kind < 0.86:
                self.html.append("<blockquote>")
                self.block(self.pick(["p", "div"]), self.words(5, 50), True)
                self.html.append("</blockquote>")
            elif kind < 0.88:
                self.block("pre", self.words(2, 30), True)
            elif kind < 0.9:
                self.html.append("<figure>")
                self.block("figcaption", self.words(2, 14), True)
                self.html.append("</figure>")
            elif kind < 0.92:
                self.html.append("<table><tr>")
                for _ in range(self.random.integers(2, 6)):
                    self.block(self.pick(["td", "th"]), self.words(1, 6), True)
                self.html.append("</tr></table>")
            elif kind < 0.95:
                self.html.append("<div>")
                self.block(self.pick(["p", "div"]), self.words(8, 60), True)
                self.html.append("</div>")
            else:
                self.noise(self.pick(["ad", "ad", "aside", "share", "form", "notice"]))
        if self.chance(0.12):
            self.noise(self.pick(["comments", "share", "aside", "footer"]))
        self.html.append(f"</{tag}>")


def labelled_page(random: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its leaf blocks in order, whether it belongs to the article."""
    page = _Page(random)
    depth = int(random.integers(0, 3))
    for _ in range(depth):
        page.html.append(f'<div class="{page.pick(_WRAPPERS)}">' if page.chance(0.7) else "<div>")
    for kind, share in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.45), ("aside", 0.15)):
        if page.chance(share):
            page.noise(kind)
    if page.chance(0.96):
        page.article()
    late = [("share", 0.2), ("comments", 0.4), ("aside", 0.35), ("form", 0.25), ("ad", 0.25), ("nav", 0.15)]
    for kind, share in late:
        if page.chance(share):
            page.noise(kind)
    if page.chance(0.75):
        page.noise("footer")
    page.html.append("</div>" * depth)
    return "".join(page.html), page.labels
