"""A small document tree for work that needs nesting: cleaning, main content, markdown, product fields.

Runs on the executors in Arrow batches; nothing here imports Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def find(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def find_all(self, test: Callable[[Element], bool]) -> list[Element]:
        return [e for e in self.walk() if test(e)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                parts.append(e)
            else:
                stack.extend(reversed(e.children))
        return "".join(parts)

    def stripped(self) -> str | None:
        return "".join(p for p in (x.strip() for x in self.strings()) if p) or None

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                yield e
            else:
                stack.extend(reversed(e.children))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#document", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    """The tree of any text; comments are dropped, damaged markup is taken as it comes."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except AssertionError:  # the parser's own check on markup declarations it can't read
        pass
    return builder.root


# Default patterns of the markdown engine (substrings of id and class).
COOKIE_PATTERNS = ("cookie", "consent", "gdpr", "privacy-banner", "cc-banner", "cookie-notice", "cookieConsent")
AD_PATTERNS = ("ad-", "ads-", "advert", "banner-ad", "google_ads", "sponsored", "dfp-", "gpt-ad")


@dataclass(frozen=True)
class MarkdownConfig:
    """Switches of the markdown engine."""

    strip_scripts: bool = True
    strip_styles: bool = True
    strip_nav: bool = True
    strip_footer: bool = True
    strip_header: bool = True
    strip_cookies: bool = True
    strip_ads: bool = True
    extract_main: bool = True
    cookie_patterns: tuple[str, ...] = COOKIE_PATTERNS
    ad_patterns: tuple[str, ...] = AD_PATTERNS


def sanitize(root: Element, config: MarkdownConfig = MarkdownConfig()) -> Element:
    """Removes what the configuration names, and hidden elements, noscript and iframes in any case."""
    switched = {"script": config.strip_scripts, "style": config.strip_styles, "nav": config.strip_nav, "footer": config.strip_footer, "header": config.strip_header, "noscript": True, "iframe": True}
    patterns = [p.lower() for p, on in ((config.cookie_patterns, config.strip_cookies), (config.ad_patterns, config.strip_ads)) if on for p in p]
    for e in root.find_all(lambda e: True):
        name = " ".join((e.attrs.get("id", ""), e.attrs.get("class", ""))).lower()
        style = e.attrs.get("style", "").replace(" ", "").lower()
        if switched.get(e.tag) or "display:none" in style or e.attrs.get("aria-hidden") == "true" or (name.strip() and any(p in name for p in patterns)):
            e.remove()
    return root


def main_content(root: Element) -> Element:
    """The main element, the longest article, the element of role main (each with over 50 characters of text), the body, the document."""
    long_enough = lambda e: e is not None and len(e.text().strip()) > 50
    main = root.find(lambda e: e.tag == "main")
    if long_enough(main):
        return main
    article = max(root.find_all(lambda e: e.tag == "article"), key=lambda e: len(e.text()), default=None)
    if long_enough(article):
        return article
    role = root.find(lambda e: e.attrs.get("role") == "main")
    if long_enough(role):
        return role
    return root.find(lambda e: e.tag == "body") or root


_BLOCKS = frozenset("address article aside blockquote body details div dl dt dd fieldset figure footer form header html main nav p section table #document".split())
_SKIPPED = frozenset("head title script style template meta link".split())


def to_markdown(html: str | None, config: MarkdownConfig = MarkdownConfig()) -> str:
    """Markdown of a page: cleaned, cut to the main content, "#" headings and "-" lists, one blank line between blocks."""
    root = sanitize(parse(html), config)
    target = main_content(root) if config.extract_main else root
    text = _render(target)
    lines = [line.rstrip() for line in text.split("\n")]
    out = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return out + "\n" if out else ""


def _inline(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _render(e: Element | str, depth: int = 0) -> str:
    if isinstance(e, str):
        return _inline(e)
    if e.tag in _SKIPPED:
        return ""
    if depth > 400:  # deeper nesting is read as text
        return _inline(e.text())
    if e.tag == "pre":
        return "\n\n```\n" + e.text().strip("\n") + "\n```\n\n"
    if e.tag == "br":
        return "\n"
    if e.tag == "hr":
        return "\n\n---\n\n"
    if e.tag == "img":
        return f"![{e.attrs.get('alt', '')}]({e.attrs.get('src', '')})"
    if e.tag in ("ul", "ol"):
        items = [c for c in e.children if isinstance(c, Element) and c.tag == "li"]
        rows = []
        for i, item in enumerate(items):
            mark = "- " if e.tag == "ul" else f"{i + 1}. "
            body = "".join(_render(c, depth + 1) for c in item.children).strip()
            rows.append(mark + re.sub(r"\n+", "\n  ", body))
        return "\n\n" + "\n".join(rows) + "\n\n"
    if e.tag == "table":
        rows = [[_inline("".join(_render(c, depth + 1) for c in cell.children)).strip() for cell in r.children if isinstance(cell, Element) and cell.tag in ("td", "th")] for r in e.find_all(lambda x: x.tag == "tr")]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
        return "\n\n" + "\n".join(lines) + "\n\n"
    inner = "".join(_render(c, depth + 1) for c in e.children)
    if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456":
        title = _inline(inner).strip()
        return f"\n\n{'#' * int(e.tag[1])} {title}\n\n" if title else ""
    if e.tag == "a":
        label, href = inner.strip(), e.attrs.get("href")
        return f"[{label}]({href})" if href and label else inner
    if e.tag in ("strong", "b"):
        return f"**{inner.strip()}**" if inner.strip() else inner
    if e.tag in ("em", "i"):
        return f"*{inner.strip()}*" if inner.strip() else inner
    if e.tag == "code":
        return f"`{inner}`" if inner.strip() else inner
    if e.tag == "blockquote":
        return "\n\n" + "\n".join("> " + line for line in inner.strip().split("\n")) + "\n\n"
    return f"\n\n{inner.strip()}\n\n" if e.tag in _BLOCKS else inner
