"""A tolerant reader of HTML into text blocks with the path of elements above them."""

from __future__ import annotations

import re
from html import unescape

ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"[>\"']")
SPACE = re.compile(r"\s+")
NUMBER, LONG_NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
#: Elements whose content is no text of the page, and which of them swallow the rest of a page that never ends them.
RAW = {"script", "style", "textarea", "title", "template", "iframe"}
SWALLOWS = {"script", "style", "textarea", "title"}
#: Elements nested deeper belong to the branch at this depth.
MOST_DEEP = 256
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that only mark text inside a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
#: A start of one of these ends an open paragraph.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: A start of the key ends an open element of the values, up to the nearest of its containers.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
            "option": ({"option"}, {"select"})}


def signature(tag: str, attributes: str) -> str:
    """Presentation of an element: its tag with class, id and role. Numbers are left out, as they count things, but for those of
    one or two digits in a class, which tell columns and levels apart."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    names: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        names.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    out = tag
    for key, mark in (("class", "."), ("id", "#"), ("role", "@")):
        if names.get(key):
            out += mark + (LONG_NUMBER if key == "class" else NUMBER).sub("", " ".join(names[key].split()))
    style = names.get("style", "").replace(" ", "")
    if "hidden" in names and names["hidden"] != "false" or names.get("aria-hidden") == "true" or "display:none" in style:
        out += "!hidden"
    return out


class Scanner:
    """Finds the tags of a page in one forward pass: what fails once is not looked for again, so that no page takes more
    than time in proportion to its length."""

    def __init__(self, html: str) -> None:
        self.html, self.last_end = html, html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.plain_until = 0  # tags that begin before this have a quote that nothing closes
        self.never: set[str] = set()  # raw elements that nothing ends from here on

    def tag_end(self, at: int) -> int:
        """Place of the `>` that ends the tag whose name ends here: the first one outside quotes."""
        first = self.html.find(">", at)
        if at < self.plain_until:
            return first
        while True:
            m = QUOTE_OR_END.search(self.html, at)
            if m is None:
                return first
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last_quote[m[0]]:
                self.plain_until = m.start()
                return first
            at = self.html.index(m[0], m.end()) + 1

    def next_tag(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag, comment or declaration (name empty); `<` that begins
        none of these is text."""
        while True:
            start = self.html.find("<", at)
            if start < 0 or start > self.last_end and not self.html.startswith("<!--", start):
                return None
            if self.html.startswith("<!--", start):
                end = self.html.find("-->", start + 4)
                return start, len(self.html) if end < 0 else end + 3, "", False, ""
            if self.html[start + 1] in "!?":
                return start, self.html.index(">", start) + 1, "", False, ""
            closing = self.html[start + 1] == "/"
            m = NAME.match(self.html, start + 1 + closing)
            if m:
                end = self.tag_end(m.end())
                return start, end + 1, m[0].lower(), closing, self.html[m.end() : end]
            at = start + 1

    def raw_end(self, tag: str, at: int) -> int | None:
        """Where the content of a raw element ends, its end tag included."""
        if tag not in self.never:
            m = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(self.html, at)
            if m:
                return m.end()
            self.never.add(tag)
        return len(self.html) if tag in SWALLOWS else None


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of the text blocks of a page, in order. The path holds the presentation of
    the elements above, without those that only mark text unless they hide it."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    tags: list[str] = []
    paths: list[tuple[str, ...]] = [()]
    text: list[str] = []
    scanner, where, begun = Scanner(html), (), False
    links = linked = 0

    def flush() -> None:
        nonlocal linked, begun
        if begun:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                out.append((where, joined, linked))
        text.clear()
        linked, begun = 0, False

    def close_to(depth: int) -> None:
        nonlocal links
        links -= tags[depth:].count("a")
        del tags[depth:], paths[depth + 1 :]

    def opened(tag: str, attributes: str) -> None:
        nonlocal links
        if len(tags) < MOST_DEEP:
            links += tag == "a"
            tags.append(tag)
            element = signature(tag, attributes)
            paths.append(paths[-1] if tag in INLINE and "!" not in element else (*paths[-1], element))

    at, n = 0, len(html)
    while at < n:
        found = scanner.next_tag(at)
        end = found[0] if found else n
        if end > at:
            piece = html[at:end]
            if not piece.isspace():
                if not begun:
                    where, begun = paths[-1], True
                if links:
                    linked += len(piece.strip())
            text.append(piece)
        if not found:
            break
        _, at, tag, closing, attributes = found
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID:
                if not closing:
                    opened(tag, attributes)
                else:
                    for i in range(len(tags) - 1, -1, -1):
                        if tags[i] == tag:
                            if i == len(tags) - 1:
                                close_to(i)
                            else:  # overlapping marks: the others stay open
                                later = paths[i + 2 :]
                                links -= tag == "a"
                                del tags[i], paths[i + 1 :]
                                paths.extend(later)
                            break
                        if tags[i] not in INLINE:
                            break
            continue
        flush()
        if closing:
            if tag in tags:
                close_to(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag in RAW:
            # a raw element ends at its own end tag, whatever stands inside
            stop = scanner.raw_end(tag, at)
            at = at if stop is None else stop
            continue
        if tag in CLOSES_P and "p" in tags:
            close_to(len(tags) - 1 - tags[::-1].index("p"))
        if tag in SIBLINGS:
            open_ones, container = SIBLINGS[tag]
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in container:
                    break
                if tags[i] in open_ones:
                    close_to(i)
                    break
        if tag not in VOID:
            opened(tag, attributes)
    flush()
    return out
