"""HTML pages: what a page says, and its lines with section marks. Both are linear in the page, however broken it is."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

# Elements whose contents are no text of a page.
SILENT = {"script", "style", "noscript"}


class Stream(HTMLParser):
    """The tags and texts of a page in order: (1, name) where an element starts, (-1, name) where one ends, (0, text) between.

    An unfinished tag at the page's end, and what follows it, is not read. A marked section that is none is a comment.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[int, str]] = []
        self.feed(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append((1, tag))

    def handle_endtag(self, tag: str) -> None:
        self.events.append((-1, tag))

    def handle_data(self, data: str) -> None:
        self.events.append((0, data))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


def page_text(html: str | None) -> str | None:
    """A3: what a page says. Text counts where as many silent elements have ended as have started, whatever their names; an end
    without a start counts for nothing. Entities are decoded, white space is collapsed."""
    if html is None:
        return None
    said, depth = [], 0
    for step, what in Stream(html).events:
        if not step:
            if not depth:
                said.append(what)
        elif what in SILENT:
            depth = max(0, depth + step)
    return " ".join(" ".join(said).split())


# What starts a section, what ends a line, in the order in which they are looked for.
_SECTION = re.compile(r"<(?:section|article)\b[^>]*>", re.I)
_DIV, _CLASS, _QUOTE, _SLIDE = re.compile(r"<div\b", re.I), re.compile("class=[\"']", re.I), re.compile("[\"']"), re.compile(r"\bslide\b", re.I)
_HEADING = re.compile(r"<h[1-6]\b[^>]*>", re.I)
_END = re.compile(r"</(?:p|div|li|h[1-6]|td|th|tr|section|article|header|footer|blockquote)>", re.I)
_BREAK = re.compile(r"<(?:br|hr)\s*/?>", re.I)
_TAG = re.compile(r"<[^>]+>")
_RAW = re.compile("<(?:(?P<script>script)|(?P<style>style))", re.I)
_RAW_END = {"script": re.compile("</script>", re.I), "style": re.compile("</style>", re.I)}
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x85\u2028\u2029]")


def without_raw(html: str) -> str:
    """Scripts and styles that end become a blank. One that doesn't end is looked for once."""
    out, kept, at, endless = [], 0, 0, set()
    while len(endless) < len(_RAW_END) and (head := _RAW.search(html, at)):
        at = head.end()
        end = None if head.lastgroup in endless else _RAW_END[head.lastgroup].search(html, at)
        if end is None:
            endless.add(head.lastgroup)
        else:
            out += [html[kept : head.start()], " "]
            kept = at = end.end()
    return "".join([*out, html[kept:]])


def put(pattern: re.Pattern, value: str, text: str) -> str:
    """Substitutes tags. All end with ``>``, so what follows the last one holds none and is not tried."""
    stop = text.rfind(">") + 1
    return pattern.sub(value, text[:stop]) + text[stop:]


class _Next:
    """The next place of a character from rising places on; none is looked for twice."""

    def __init__(self, text: str, sign: re.Pattern):
        self.text, self.sign, self.found = text, sign, -1

    def __call__(self, at: int) -> int:
        """The place, or the text's length."""
        if self.found < at:
            hit = self.sign.search(self.text, at)
            self.found = hit.start() if hit else len(self.text)
        return self.found


def _slide_classes(text: str) -> Iterator[tuple[int, int]]:
    """Where attributes with the class ``slide`` start, and where the tag around them ends."""
    quote, close = _Next(text, _QUOTE), _Next(text, re.compile(">"))
    for found in _CLASS.finditer(text):
        end = quote(found.end())
        if end == len(text):
            return
        if _SLIDE.search(text[found.end() : end]) and (stop := close(end + 1)) < len(text):
            yield found.start(), stop + 1


def marked_slides(text: str, mark: str) -> str:
    """The start of each ``div`` that has a ``slide`` class before its first ``>`` becomes the mark; the last such class counts."""
    classes = list(_slide_classes(text))
    if not classes:
        return text
    starts = [c for c, _ in classes]
    out, at, close = [], 0, _Next(text, re.compile(">"))
    for found in _DIV.finditer(text):
        if found.start() < at:
            continue
        last = bisect_left(starts, close(found.end())) - 1
        if last >= 0 and starts[last] >= found.end():
            out += [text[at : found.start()], mark]
            at = classes[last][1]
    return "".join([*out, text[at:]])


def page_lines(html: str | None, mark: str) -> list[str] | None:
    """The lines of a page; one that begins a section, a heading or a slide begins with the mark. A mark in the page ends a line."""
    if html is None:
        return None
    text = put(_SECTION, f"\n{mark}", without_raw(html.replace(mark, "\n")))
    text = put(_HEADING, f"\n{mark}", marked_slides(text, f"\n{mark}"))
    for pattern, value in ((_END, "\n"), (_BREAK, "\n"), (_TAG, " ")):
        text = put(pattern, value, text)
    return _LINE.split(unescape(text))
