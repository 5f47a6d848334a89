"""Generated Word, PDF and zip files, for queries and tests: no driver table holds any."""

from __future__ import annotations

import io
import zipfile
import zlib
from functools import cache, lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES_OF = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "dc": "http://purl.org/dc/elements/1.1/", "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}


def node(name: str, *inside, **attrs: str) -> ET.Element:
    """An element w:name (or of another prefix, as in a:blip) with attributes of the same name space; r_id is r:id."""
    prefix, _, local = name.rpartition(":")
    space = SPACES_OF[prefix or "w"]
    out = ET.Element(f"{{{space}}}{local}")
    for key, value in attrs.items():
        if key.startswith("r_"):
            out.set(f"{{{SPACES_OF['r']}}}{key[2:]}", value)
        else:
            out.set(key if prefix == "rel" else f"{{{space}}}{key}", value)
    for part in inside:
        if isinstance(part, str):
            out.text = part
        else:
            out.append(part)
    return out


_PREFIX = {space: prefix for prefix, space in SPACES_OF.items()}
_SPACES = "".join(f' xmlns:{prefix}="{space}"' for prefix, space in SPACES_OF.items())


@cache
def _name(tag: str) -> str:
    """{space}local as prefix:local."""
    space, _, local = tag[1:].rpartition("}")
    return f"{_PREFIX[space]}:{local}" if space else tag


def xml(tree: ET.Element) -> bytes:
    """A part of a package; its root declares all name spaces."""
    out: list[str] = []

    def walk(e: ET.Element, spaces: str = "") -> None:
        name = _name(e.tag)
        attrs = "".join([f" {_name(k)}={quoteattr(v)}" for k, v in e.items()]) + spaces
        if e.text or len(e):
            out.append(f"<{name}{attrs}>{escape(e.text) if e.text else ''}")
            for inside in e:
                walk(inside)
            out.append(f"</{name}>")
        else:
            out.append(f"<{name}{attrs} />")

    walk(tree, _SPACES)
    return "".join(out).encode()


class Style:
    """A paragraph or character style: outline level from 1, font, parent."""

    def __init__(self, sid: str, name: str = "", level: int = 0, font: str = "", parent: str = ""):
        self.sid, self.name, self.level, self.font, self.parent = sid, name or sid, level, font, parent

    def xml(self) -> ET.Element:
        inside = [node("name", val=self.name)]
        if self.parent:
            inside.append(node("basedOn", val=self.parent))
        if self.level:
            inside.append(node("pPr", node("outlineLvl", val=str(self.level - 1))))
        if self.font:
            inside.append(node("rPr", node("rFonts", hAnsi=self.font)))
        return node("style", *inside, styleId=self.sid)


STYLES = (Style("Part", "Part title", 1), Style("Topic", "Topic title", 2), Style("Detail", "Detail", 4), Style("SubTopic", "Sub topic", parent="Topic"), Style("Listing", "Program listing", font="Fira Code"), Style("Index", "toc entries"))
LISTS = {"dots": ("31", "bullet"), "steps": ("47", "upperRoman")}


@lru_cache(8)
def _styles(styles: tuple[Style, ...]) -> bytes:
    return xml(node("styles", *[s.xml() for s in styles]))


@cache
def _numbering() -> bytes:
    levels = [node("abstractNum", *[node("lvl", node("numFmt", val=fmt), ilvl=str(d)) for d in range(3)], abstractNumId=num) for num, fmt in LISTS.values()]
    return xml(node("numbering", *levels, *[node("num", node("abstractNumId", val=num), numId=num) for num, _ in LISTS.values()]))


class Word:
    """A Word package, built paragraph by paragraph."""

    def __init__(self, title: str = "", styles: tuple[Style, ...] = STYLES):
        self.title, self.styles = title, styles
        self.body: list[ET.Element] = []
        self.targets: list[tuple[str, str]] = []
        self.media: dict[str, bytes] = {}

    @staticmethod
    def text(words: str, *marks: str, font: str = "") -> ET.Element:
        """A run; marks are property names such as b, i, strike, vanish, or b=0."""
        props = [node(m.partition("=")[0], **({"val": m.partition("=")[2]} if "=" in m else {})) for m in marks]
        if font:
            props.append(node("rFonts", ascii=font))
        inside = []
        for i, line in enumerate(words.split("\n")):
            if i:
                inside.append(node("br"))
            inside.append(node("t", line))
        return node("r", node("rPr", *props), *inside)

    def relation(self, target: str) -> str:
        self.targets.append((f"k{len(self.targets) + 1}", target))
        return self.targets[-1][0]

    def link(self, words: str, target: str) -> ET.Element:
        return node("hyperlink", self.text(words), r_id=self.relation(target))

    def picture(self, target: str, data: bytes | None = None, part: str = "") -> ET.Element:
        """A run with a picture; without data its part is missing from the package."""
        if data is not None:
            self.media[part or f"word/{target}"] = data
        return self.same_picture(self.relation(target))

    @staticmethod
    def same_picture(rid: str) -> ET.Element:
        return node("r", node("drawing", node("a:blip", r_embed=rid)))

    @staticmethod
    def paragraph(*inside, style: str = "", list_of: str = "", depth: int = 0) -> ET.Element:
        props = []
        if style:
            props.append(node("pStyle", val=style))
        if list_of:
            props.append(node("numPr", node("ilvl", val=str(depth)), node("numId", val=LISTS[list_of][0])))
        return node("p", node("pPr", *props), *[Word.text(x) if isinstance(x, str) else x for x in inside])

    def add(self, *inside, **how) -> Word:
        self.body.append(self.paragraph(*inside, **how))
        return self

    def table(self, *rows: list) -> Word:
        """Rows of cells; a cell is a text, a list of paragraphs, or (cell, columns it spans)."""
        out = []
        for row in rows:
            cells = []
            for cell in row:
                cell, span = cell if isinstance(cell, tuple) else (cell, 1)
                width = [node("tcPr", node("gridSpan", val=str(span)))] if span > 1 else []
                cells.append(node("tc", *width, *[self.paragraph(x) if isinstance(x, str) else x for x in (cell if isinstance(cell, list) else [cell])]))
            out.append(node("tr", *cells))
        self.body.append(node("tbl", *out))
        return self

    def packed(self) -> bytes:
        parts = {
            "word/document.xml": xml(node("document", node("body", *self.body))), "word/styles.xml": _styles(self.styles), "word/numbering.xml": _numbering(),
            "word/_rels/document.xml.rels": xml(node("rel:Relationships", *[node("rel:Relationship", Id=rid, Target=target) for rid, target in self.targets])),
        }
        if self.title:
            parts["docProps/core.xml"] = xml(node("dc:core", node("dc:title", self.title)))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in (parts | self.media).items():
                z.writestr(name, data)
        return out.getvalue()


class Sheet:
    """One page of a PDF; texts are placed by their distance from the left and the top."""

    def __init__(self, width: int = 595, height: int = 842):
        self.width, self.height = width, height
        self.marks: list[bytes] = []

    def put(self, words: str, left: float, top: float, size: float = 11, fixed: bool = False) -> Sheet:
        safe = words.encode("cp1252")
        for char in (b"\\", b"(", b")"):
            safe = safe.replace(char, b"\\" + char)
        self.marks.append(b"BT /%s %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET" % (b"Fixed" if fixed else b"Body", size, left, self.height - top, safe))
        return self

    def lines(self, *texts: str, left: float = 60, top: float = 120, size: float = 11, step: float = 14) -> Sheet:
        for i, text in enumerate(texts):
            self.put(text, left, top + i * step, size)
        return self


def pdf(*sheets: Sheet) -> bytes:
    """A PDF of Flate streams with a proportional and a fixed font."""
    fonts = b"<< /Body 3 0 R /Fixed 4 0 R >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"}
    kids = []
    for i, sheet in enumerate(sheets):
        stream, page = 5 + 2 * i, 6 + 2 * i
        data = zlib.compress(b"\n".join(sheet.marks))
        objects[stream] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font %s >> /Contents %d 0 R >>" % (sheet.width, sheet.height, fonts, stream)
        kids.append(b"%d 0 R" % page)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


def generated(make, *columns):
    """A binary column of make(values of columns), one file a row."""

    @F.pandas_udf(T.BinaryType())
    def files(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([make(*row) for row in rows.itertuples(index=False)], dtype=object)

    return files(F.struct(*columns))
