"""HTML reader: a page to blocks."""

from __future__ import annotations

import re

from ..functions.text import S, SPACES, collapse, encode_link_target, escape_inline, trim, wrap_emphasis
from ..functions.vocab import BLOCK_CHILDREN, CHROME_HINT, CHROME_ROLES, CHROME_TAGS, CONTENT_ROOTS, DROP_TAGS
from .dom import HEADINGS, Node, parse

_CHROME = re.compile(CHROME_HINT, re.IGNORECASE)
_MSO_HEADING = re.compile(rf"(?:^|{S})(?:Mso)?Heading([1-6])(?:CxSp[A-Za-z0-9_]+)?(?:{S}|\Z)", re.IGNORECASE)
_MSO_TOC = re.compile(rf"(?:^|{S})(?:Mso)?Toc[0-9]?(?:CxSp[A-Za-z0-9_]+)?(?:{S}|\Z)", re.IGNORECASE)
_MSO_LIST = re.compile(rf"(?:^|{S})MsoListParagraph(?:CxSp[A-Za-z0-9_]+)?(?:{S}|\Z)", re.IGNORECASE)
_SIDECAR = re.compile(r"(?:^|/)[^/]+_files/", re.IGNORECASE)
_BULLET = re.compile(rf"{S}*[•·▪◦‣∙o§\-–—]{S}+")
_LANG = re.compile("(?:language|lang|highlight-source|brush:?)[-_ ]([a-z0-9+#]+)", re.IGNORECASE)
_BREAK = re.compile(rf"{S}*\n{S}*")
MONO = frozenset(("code", "kbd", "samp", "tt", "var"))
MARKERS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
LEAST_ROOT, CHROME_SHARE, DEEPEST = 200, 0.5, 3


def matches(node: Node, selector: str) -> bool:
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    if selector[0] == "[":
        key, _, value = selector[1:-1].partition("=")
        return node.attrs.get(key) == value
    return node.tag == selector


def pick_root(html: Node, body: Node) -> Node:
    """The first content element of enough text."""
    for selector in CONTENT_ROOTS:
        found = next((n for n in html.walk() if matches(n, selector)), None)
        if found is not None and len(trim(found.text())) > LEAST_ROOT:
            return found
    return body


def chrome_kind(node: Node) -> str | None:
    """Semantic (the markup says so), named (only a name does, and links or no heading confirm it), or None."""
    if node.tag in CHROME_TAGS or node.attrs.get("role", "").lower() in CHROME_ROLES:
        return "semantic"
    if node.tag != "header" and not any(_CHROME.search(node.attrs.get(k, "")) for k in ("id", "class")):
        return None
    inside = list(node.walk())
    links = sum(n.tag == "a" and "href" in n.attrs for n in inside)
    return "named" if links >= 3 or not any(n.tag in HEADINGS for n in inside) else None


def code_language(node: Node) -> str:
    """X8"""
    first = next(iter(node.elements()), None)
    if m := _LANG.search(f"{node.attrs.get('class', '')} {first.attrs.get('class', '') if first else ''}"):
        return m[1].lower()
    return (node.attrs.get("data-lang") or node.attrs.get("data-language") or "").lower()


class Reader:
    """Blocks and report of one page."""

    def __init__(self):
        self.blocks: list[dict] = []
        self.report: dict = {}

    def count(self, key: str) -> None:
        self.report[key] = self.report.get(key, 0) + 1

    def add(self, kind: str, text: str, **more) -> None:
        self.blocks.append({"kind": kind, "text": text, **more})

    # inline

    def inline(self, node: Node) -> str:
        """X13"""
        return "".join(self._piece(c) for c in node.children)

    def _piece(self, child: Node | str) -> str:
        if isinstance(child, str):
            return escape_inline(re.sub(f"{S}+", " ", child))
        if child.tag in DROP_TAGS:
            return ""
        if child.tag == "br":
            return "\n"
        if child.tag in MONO:
            code = collapse(child.text())
            ticks = "`" * (max(map(len, re.findall("`+", code)), default=0) + 1)
            return f"{ticks}{code}{ticks}" if code else ""
        if child.tag == "img":
            return self.image(child)
        inner = self.inline(child)
        if child.tag == "a":
            href, text = trim(child.attrs.get("href", "")), trim(inner)
            plain = not text or not href or href[0] == "#" or href.lower().startswith("javascript:")
            return text if plain else f"[{text}]({encode_link_target(href)})"
        return wrap_emphasis(inner, MARKERS[child.tag]) if child.tag in MARKERS else inner

    def image(self, node: Node) -> str:
        """X15"""
        src = trim(node.attrs.get("src") or node.attrs.get("data-src") or "")
        if not src:
            return ""
        if _SIDECAR.search(src):
            self.count("htmlWordSidecar")
            return ""
        self.count("htmlAbsoluteImages" if re.match("(?:https?:)?//|data:", src, re.IGNORECASE) else "htmlRelativeImages")
        return f"![{escape_inline(re.sub('[][]', '', node.attrs.get('alt', '')))}]({encode_link_target(src)})"

    def one_line(self, node: Node, joint: str = " ") -> str:
        return trim(_BREAK.sub(joint, self.inline(node)))

    # blocks

    def read(self, html: str) -> None:
        tree = parse(html)
        body = next(n for n in tree.elements() if n.tag == "body")
        title = next((n for n in tree.walk() if n.tag == "title"), None)
        if title is not None and trim(title.text()):
            self.report["htmlTitle"] = trim(title.text())
        root = pick_root(tree, body)
        self.report["htmlRoot"] = root.tag + (f"#{root.attrs['id']}" if root.attrs.get("id") else "")
        self.size = len(trim(root.text()))
        self.children(root)
        if not self.blocks:
            raise ValueError("no readable content found in this HTML")

    def children(self, parent: Node) -> None:
        for node in parent.elements():
            if node.tag not in DROP_TAGS:
                self.element(node)

    def element(self, node: Node) -> None:
        tag, cls = node.tag, node.attrs.get("class", "")
        chrome = chrome_kind(node)
        if chrome == "semantic" or chrome == "named" and len(trim(node.text())) < self.size * CHROME_SHARE or _MSO_TOC.search(cls):
            self.count("htmlChromeDropped")
        elif tag not in HEADINGS and (m := _MSO_HEADING.search(cls)):
            if text := collapse(node.text()):
                self.add("heading", text, level=int(m[1]))
                self.count("htmlWordHeadings")
        elif _MSO_LIST.search(cls):
            text = self.one_line(node)
            if m := _BULLET.match(text):
                self.add("list", trim(text[m.end() :]), level=0, ordered=False)
                self.count("htmlWordLists")
            elif text:
                self.add("para", text)
        elif tag in HEADINGS:
            if text := collapse(node.text()):
                self.add("heading", text, level=int(tag[1]))
        elif tag == "pre":
            self.code(node)
        elif tag == "table":
            self.table(node)
        elif tag in ("ul", "ol"):
            self.items(node, 0)
        elif tag in ("hr", "br"):
            pass
        elif tag == "figure":
            self.figure(node)
        elif tag not in ("img", "blockquote") and any(c.tag in BLOCK_CHILDREN for c in node.elements()):
            self.children(node)
        else:
            if tag == "img":
                text = self.image(node)
            elif tag == "blockquote":
                text = self.one_line(node)
            else:
                text = trim(re.sub("[ \t]+", " ", self.inline(node)))
            if text:
                self.add("para", text)

    def code(self, node: Node) -> None:
        text = node.text().rstrip(SPACES)
        if trim(text):
            self.add("code", text.removeprefix("\n"), lang=code_language(node))
            self.count("htmlCodeBlocks")

    def figure(self, node: Node) -> None:
        inside = list(node.walk())
        image = next((n for n in inside if n.tag == "img"), None)
        caption = next((n for n in inside if n.tag == "figcaption"), None)
        parts = [self.image(image)] if image is not None else []
        if caption is not None and trim(caption.text()):
            parts.append(escape_inline(trim(caption.text())))
        if parts:
            self.add("para", "\n".join(parts))

    def items(self, parent: Node, depth: int) -> None:
        """X10"""
        for item in parent.elements():
            if item.tag != "li":
                continue
            apart = [c for c in item.elements() if c.tag in ("ul", "ol", "pre")]
            text = trim(_BREAK.sub(" ", "".join(self._piece(c) for c in item.children if not any(c is a for a in apart))))
            if text:
                self.add("list", text, level=min(DEEPEST, depth), ordered=parent.tag == "ol")
            for code in (c for c in apart if c.tag == "pre"):
                self.code(code)
            for nested in (c for c in apart if c.tag != "pre"):
                self.items(nested, min(DEEPEST, depth + 1))

    def table(self, node: Node) -> None:
        """X9"""
        rows = []
        for tr in node.walk():
            if tr.tag != "tr" or tr.closest("table") is not node:
                continue
            cells: list[str] = []
            for cell in tr.elements():
                if cell.tag in ("td", "th"):
                    span = re.match(rf"{S}*([0-9]+)", cell.attrs.get("colspan", ""))
                    cells.append(self.one_line(cell, "<br />").replace("|", "\\|"))
                    cells += [""] * ((int(span[1]) if span else 1) - 1)
            if cells:
                rows.append(cells)
        if rows:
            self.blocks.append({"kind": "table", "rows": rows})
            self.count("htmlTables")


def html_to_blocks(html: str | None) -> tuple[list[dict], dict]:
    reader = Reader()
    reader.read(html or "")
    return reader.blocks, reader.report
