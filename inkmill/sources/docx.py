"""Word reader: a package to blocks."""

from __future__ import annotations

import io
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

from ..functions.text import encode_link_target, escape_inline, norm_key, trim, wrap_emphasis
from ..functions.vocab import MONO_FONTS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"
# Stems of heading style names in several languages.
HEADING_STYLE = re.compile(r"(?:heading|titulo|titre|uberschrift|titolo|cabecalho|rubrik|overskrift|kop|naglowek|encabezado)[ ]?([1-6])\Z")
MONO_SHARE = 0.8


def xml_of(data: bytes | None) -> ElementTree.Element | None:
    return ElementTree.fromstring(data) if data else None


def attr(node, name: str, default: str | None = None) -> str | None:
    return default if node is None else node.get(W + name, default)


def on(parent, name: str) -> bool:
    """A flag that is there and not switched off."""
    node = None if parent is None else parent.find(W + name)
    return node is not None and attr(node, "val", "1") not in ("0", "false", "off")


def mono_fonts(props) -> bool | None:
    """Whether the fonts of properties mean code; None without fonts."""
    fonts = None if props is None else props.find(f"{W}rFonts")
    named = [attr(fonts, k) for k in ("ascii", "hAnsi", "cs") if attr(fonts, k)] if fonts is not None else []
    return any(n.lower() in MONO_FONTS for n in named) if named else None


@lru_cache(32)  # files made from one template share such parts
def style_table(data: bytes | None) -> dict[str, dict]:
    """Level, mono and toc of styles; only levels are inherited."""
    root, out = xml_of(data), {}
    for style in root.iter(f"{W}style") if root is not None else ():
        sid = attr(style, "styleId")
        name = attr(style.find(f"{W}name"), "val", "") or ""
        outline = attr(style.find(f"{W}pPr/{W}outlineLvl"), "val")
        named = next((m for m in (HEADING_STYLE.match(norm_key(x)) for x in (name, sid or "")) if m), None)
        level = int(outline) + 1 if outline and outline.isdigit() else int(named[1]) if named else None
        out[sid] = {"level": level, "mono": bool(mono_fonts(style.find(f"{W}rPr"))), "toc": bool(re.match(r"toc( |[0-9]|\Z)", norm_key(name))), "base": attr(style.find(f"{W}basedOn"), "val")}
    for sid, style in out.items():
        seen, at = {sid}, style["base"]
        while style["level"] is None and at in out and at not in seen:
            seen.add(at)
            style["level"], at = out[at]["level"], out[at]["base"]
    return out


@lru_cache(32)
def numbering_formats(data: bytes | None) -> dict[tuple[str, str], str]:
    """(numbering, level) to format."""
    root = xml_of(data)
    if root is None:
        return {}
    abstract = {(attr(a, "abstractNumId"), attr(lvl, "ilvl")): attr(lvl.find(f"{W}numFmt"), "val", "decimal") for a in root.iter(f"{W}abstractNum") for lvl in a.iter(f"{W}lvl")}
    return {(attr(n, "numId"), ilvl): fmt for n in root.iter(f"{W}num") for (aid, ilvl), fmt in abstract.items() if aid == attr(n.find(f"{W}abstractNumId"), "val")}


def relations(data: bytes | None) -> dict[str, str]:
    """S8"""
    root = xml_of(data)
    return {} if root is None else {r.get("Id"): r.get("Target") for r in root.iter(f"{RELS}Relationship")}


def run_text(run) -> str:
    """D6"""
    out = []
    for node in run:
        name = node.tag.removeprefix(W)
        if name == "t":
            out.append(node.text or "")
        elif name == "sym":
            code = attr(node, "char", "")
            out.append(chr(int(code, 16)) if re.fullmatch("[0-9A-Fa-f]+", code) else "")
        else:
            out.append({"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(name, ""))
    return "".join(out)


class Inline:
    """The runs of a paragraph as Markdown and as plain text."""

    def __init__(self, para, styles: dict, rels: dict, mono: bool = False):
        self.styles, self.rels, self.mono = styles, rels, mono
        self.spans: list[tuple[tuple | None, str]] = []  # equal neighbouring formats are one span; None is done
        self.images: list[str] = []
        self.plain, self.mono_chars, self.chars = "", 0, 0
        for child in para:
            self.child(child)
        self.markdown = "".join(text if fmt is None else self.marked(fmt, text) for fmt, text in self.spans)

    def child(self, node) -> None:
        name = node.tag.removeprefix(W)
        if name == "r":
            self.run(node)
        elif name == "hyperlink":
            self.link(node)
        elif name in ("smartTag", "sdt", "ins"):
            for run in node.iter(f"{W}r"):
                self.run(run)

    def is_mono(self, props) -> bool:
        style = attr(props.find(f"{W}rStyle"), "val") if props is not None else None
        if self.styles.get(style, {}).get("mono"):
            return True
        own = mono_fonts(props)
        return self.mono if own is None else own

    def run(self, node) -> None:
        props = node.find(f"{W}rPr")
        if on(props, "vanish"):
            return
        for blip in node.iter(f"{A}blip"):
            if rid := blip.get(R + "embed") or blip.get(R + "link"):
                self.images.append(rid)
        text = run_text(node)
        if not text:
            return
        mono = self.is_mono(props)
        size = len(trim(text))
        self.plain, self.chars, self.mono_chars = self.plain + text, self.chars + size, self.mono_chars + mono * size
        fmt = (on(props, "b"), on(props, "i"), on(props, "strike"), mono)
        if self.spans and self.spans[-1][0] == fmt:
            self.spans[-1] = (fmt, self.spans[-1][1] + text)
        else:
            self.spans.append((fmt, text))

    def link(self, node) -> None:
        text = "".join(run_text(r) for r in node.findall(f"{W}r"))
        if not trim(text):
            return
        self.plain, self.chars = self.plain + text, self.chars + len(trim(text))
        target = self.rels.get(node.get(R + "id"), "") or ""
        safe = escape_inline(text)
        self.spans.append((None, safe if not target or target[0] == "#" else f"[{safe}]({encode_link_target(target)})"))

    @staticmethod
    def marked(fmt: tuple, text: str) -> str:
        """D9"""
        bold, italic, strike, mono = fmt
        if not trim(text):
            return text
        if mono:
            out = wrap_emphasis(text, "`" * (max(map(len, re.findall("`+", text)), default=0) + 1))
        else:
            out = escape_inline(text)
        if strike:
            out = wrap_emphasis(out, "~~")
        if not mono and (bold or italic):
            out = wrap_emphasis(out, "**" * bold + "*" * italic)
        return out


class Reader:
    def __init__(self, parts: dict[str, bytes]):
        self.styles = style_table(parts.get("word/styles.xml"))
        self.formats = numbering_formats(parts.get("word/numbering.xml"))
        self.rels = relations(parts.get("word/_rels/document.xml.rels"))

    def body(self, data: bytes) -> list[dict]:
        """D17"""
        body = xml_of(data).find(f"{W}body")
        nodes = []
        for node in body if body is not None else ():
            nodes += list(node.find(f"{W}sdtContent") if node.find(f"{W}sdtContent") is not None else ()) if node.tag == f"{W}sdt" else [node]
        return [self.paragraph(n) if n.tag == f"{W}p" else self.table(n) for n in nodes if n.tag in (f"{W}p", f"{W}tbl")]

    def paragraph(self, node) -> dict:
        """D14, D15"""
        props = node.find(f"{W}pPr")
        style = self.styles.get(attr(props.find(f"{W}pStyle"), "val") if props is not None else None, {})
        if style.get("toc"):
            return {"kind": "toc"}
        inline = Inline(node, self.styles, self.rels, bool(style.get("mono")))
        if style.get("level") and trim(inline.plain):
            return {"kind": "heading", "level": style["level"], "text": trim(inline.plain)}
        if not trim(inline.plain) and not inline.images:
            return {"kind": "blank"}
        if trim(inline.plain) and inline.mono_chars >= max(1, int(MONO_SHARE * inline.chars)):
            return {"kind": "code", "text": inline.plain, "images": inline.images}
        number = props.find(f"{W}numPr") if props is not None else None
        num = attr(number.find(f"{W}numId"), "val") if number is not None else None
        if num and num != "0":
            level = attr(number.find(f"{W}ilvl"), "val", "0")
            fmt = self.formats.get((num, level), "decimal")
            return {"kind": "list", "text": trim(inline.markdown), "level": int(level), "ordered": fmt not in ("bullet", "none"), "images": inline.images}
        return {"kind": "para", "text": trim(inline.markdown), "images": inline.images}

    def table(self, node) -> dict:
        """D16"""
        rows = []
        for tr in node.findall(f"{W}tr"):
            cells: list[str] = []
            for tc in tr.findall(f"{W}tc"):
                texts = [trim(Inline(p, self.styles, self.rels).markdown) for p in tc.iter(f"{W}p")]
                cells.append("<br />".join(t for t in texts if t).replace("\n", "<br />").replace("|", "\\|"))
                span = attr(tc.find(f"{W}tcPr/{W}gridSpan"), "val", "1") or "1"
                cells += [""] * (int(span) - 1 if span.isdigit() else 0)
            rows.append(cells)
        return {"kind": "table", "rows": rows}


def parts_of(content: bytes) -> dict[str, bytes]:
    if content[:2] == b"\xd0\xcf":
        raise ValueError("this is the older Word format: save it as .docx and try again")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
    if "word/document.xml" not in parts:
        raise ValueError("no word/document.xml: not a .docx")
    return parts


def image_part(rid: str, rels: dict[str, str], parts: dict[str, bytes]) -> str | None:
    """The part a relation leads to, if the package has it."""
    target = rels.get(rid) or ""
    return next((p for p in (f"word/{target}", target.lstrip("/")) if p in parts), None)


def extension(part: str) -> str:
    base = part.rsplit("/", 1)[-1]
    dot = base.rfind(".")
    return base[dot:] if dot > 0 else ".png"


def docx_document(content: bytes) -> tuple[list[dict], dict, list[tuple[str, bytes]]]:
    """(blocks, report, (relation, data) of the image parts that blocks refer to)"""
    parts = parts_of(content)
    reader = Reader(parts)
    blocks, media = reader.body(parts["word/document.xml"]), {}
    for block in blocks:
        if block.get("images"):
            found = [image_part(rid, reader.rels, parts) for rid in block["images"]]
            block["exts"] = [part and extension(part) for part in found]
            media |= {rid: parts[part] for rid, part in zip(block["images"], found, strict=True) if part}
    core = xml_of(parts.get("docProps/core.xml"))
    title = core.find(f"{DC}title") if core is not None else None
    return blocks, {"docxTitle": trim(title.text or "") if title is not None else ""}, list(media.items())


def docx_to_blocks(content: bytes) -> tuple[list[dict], dict]:
    return docx_document(content)[:2]
