"""HTML tree construction on the standard library's tokenizer.

Covers what browsers do to real pages: optional html, head and body, void elements, implied end
tags, the list of active formatting elements with at most three equal entries, reconstruction of formatting in later
paragraphs, and the adoption agency for misnested end tags. Not covered: foster parenting out of tables.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template body".split())
SPECIAL = CLOSES_P | SCOPE | frozenset("button col colgroup tbody tfoot thead tr iframe img input link meta script style textarea title select head".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template".split())
MARKED = frozenset("applet object marquee td th caption".split())
ROW_PARTS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"}}
ROW_PARTS["thead"] = ROW_PARTS["tfoot"] = ROW_PARTS["tbody"]


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, child) -> None:
        if isinstance(child, Node):
            if child.parent is not None:
                child.parent.children.remove(child)
            child.parent = self
        elif self.children and isinstance(self.children[-1], str):
            self.children[-1] += child
            return
        self.children.append(child)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """Elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(x.children[::-1])
        return "".join(out)

    def closest(self, tag: str) -> Node | None:
        node = self
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.html.append(self.head), self.html.append(self.body)
        self.open: list[Node] = [self.body]
        self.active: list[Node | None] = []  # None is a marker
        self.in_head, self.raw = True, None

    # tokens

    def handle_data(self, data: str) -> None:
        if self.raw is not None:
            self.raw.append(data)
        elif self.in_head and not data.strip():
            return
        else:
            self.in_head = False
            self._reconstruct()
            self.open[-1].append(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.raw is not None and self.raw.tag == "title":
            self.raw.append(self.get_starttag_text())
            return
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            node.attrs = attrs | node.attrs
            self.in_head &= tag != "body"
            return
        if tag in ("script", "style", "title", "textarea"):
            node = Node(tag, attrs)
            (self.head if self.in_head and tag != "textarea" else self.open[-1]).append(node)
            self.raw = node
            return
        if self.in_head and tag in HEAD_ONLY:
            if tag not in VOID:
                self.in_head = False
            else:
                self.head.append(Node(tag, attrs))
                return
        self.in_head = False
        self._before(tag)
        node = Node(tag, attrs)
        self.open[-1].append(node)
        if tag in VOID:
            return
        self.open.append(node)
        if tag in FORMATTING:
            self._remember(node)
        elif tag in MARKED:
            self.active.append(None)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.raw is not None:
            if tag == self.raw.tag:
                self.raw = None
            elif self.raw.tag == "title":
                self.raw.append(f"</{tag}>")
            return
        if tag in ("html", "body", "head"):
            self.in_head &= tag == "head"
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self._in_scope({"p"}, SCOPE | {"button"}):
            self.handle_starttag("p", [])
            self._pop_to({"p"})
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._pop_to(HEADINGS)
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in CLOSES_P or tag in MARKED or tag in ROW_PARTS or tag in ("table", "button"):
            stop = {"table", "html", "body"} if tag in ROW_PARTS or tag == "table" else SCOPE - {tag}
            if self._in_scope({tag}, stop - {tag}):
                self._pop_to({tag})
                if tag in MARKED:
                    self._unmark()
        else:
            for node in reversed(self.open[1:]):
                if node.tag == tag:
                    self._pop_node(node)
                    return
                if node.tag in SPECIAL:
                    return

    # stack

    def _in_scope(self, tags, stop=SCOPE) -> bool:
        for node in reversed(self.open[1:]):
            if node.tag in tags:
                return True
            if node.tag in stop:
                return False
        return False

    def _pop_to(self, tags) -> None:
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def _pop_node(self, node: Node) -> None:
        while len(self.open) > 1 and self.open.pop() is not node:
            pass

    def _before(self, tag: str) -> None:
        """What a start tag closes first."""
        if tag == "li" or tag in ("dd", "dt"):
            own = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.open[1:]):
                if node.tag in own:
                    self._pop_node(node)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
        if tag in CLOSES_P and self._in_scope({"p"}, SCOPE | {"button"}):
            self._pop_to({"p"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in ROW_PARTS and self._in_scope({"table"}, {"html"}):
            while self.open[-1].tag != "table" and any(n.tag in ROW_PARTS[tag] for n in self.open[self._last("table") + 1 :]):
                if self.open.pop().tag in ("td", "th"):
                    self._unmark()
        if tag == "option" and self.open[-1].tag == "option":
            self.open.pop()
        if tag == "a" and (old := next((n for n in reversed(self._recent()) if n.tag == "a"), None)):
            self._adopt("a")
            self.active = [n for n in self.active if n is not old]
            self.open = [n for n in self.open if n is not old]
        if tag not in SPECIAL or tag in ("img", "input", "button"):
            self._reconstruct()

    def _last(self, tag: str) -> int:
        return max(i for i, n in enumerate(self.open) if n.tag == tag)

    # formatting

    def _recent(self) -> list[Node]:
        """Active entries after the last marker."""
        at = max((i for i, n in enumerate(self.active) if n is None), default=-1)
        return self.active[at + 1 :]

    def _unmark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _remember(self, node: Node) -> None:
        same = [n for n in self._recent() if n.tag == node.tag and n.attrs == node.attrs]
        if len(same) >= 3:
            self.active = [n for n in self.active if n is not same[0]]
        self.active.append(node)

    def _reconstruct(self) -> None:
        recent = self._recent()
        at = len(recent)
        while at and not any(recent[at - 1] is n for n in self.open):
            at -= 1
        base = len(self.active) - len(recent)
        for i in range(at, len(recent)):
            clone = Node(recent[i].tag, recent[i].attrs)
            self.open[-1].append(clone)
            self.open.append(clone)
            self.active[base + i] = clone

    def _adopt(self, tag: str) -> None:
        """The adoption agency: an end tag of a formatting element."""
        if self.open[-1].tag == tag and not any(self.open[-1] is n for n in self.active):
            self.open.pop()
            return
        for _ in range(8):
            element = next((n for n in reversed(self._recent()) if n.tag == tag), None)
            if element is None:
                return
            if not any(element is n for n in self.open):
                self.active = [n for n in self.active if n is not element]
                return
            place = next(i for i, n in enumerate(self.open) if n is element)
            if any(n.tag in SCOPE - {"body"} for n in self.open[place + 1 :]):
                return
            block = next((n for n in self.open[place + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[place:]
                self.active = [n for n in self.active if n is not element]
                return
            ancestor = self.open[place - 1]
            mark = next(i for i, n in enumerate(self.active) if n is element)
            last, index, count = block, next(i for i, n in enumerate(self.open) if n is block), 0
            between = self.open[place + 1 : index]
            for node in reversed(between):
                count += 1
                entry = next((i for i, n in enumerate(self.active) if n is node), None)
                if entry is None or count > 3:
                    self.open = [n for n in self.open if n is not node]
                    self.active = [n for n in self.active if n is not node]
                    continue
                clone = Node(node.tag, node.attrs)
                self.active[entry] = clone
                self.open[next(i for i, n in enumerate(self.open) if n is node)] = clone
                if last is block:
                    mark = entry + 1
                clone.append(last)
                last = clone
            ancestor.append(last)
            clone = Node(element.tag, element.attrs)
            for child in list(block.children):
                if isinstance(child, Node):
                    child.parent = clone
                clone.children.append(child)
            block.children = []
            block.append(clone)
            self.active.insert(min(mark, len(self.active)), clone)
            self.active = [n for n in self.active if n is not element]
            self.open = [n for n in self.open if n is not element]
            self.open.insert(next(i for i, n in enumerate(self.open) if n is block) + 1, clone)


def parse(html: str) -> Node:
    """The html element, with head and body."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.html
