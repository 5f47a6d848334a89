"""PDF reader: positioned text to blocks (P1 to P11), and a small extractor of positioned text.

The extractor reads plain and Flate streams with simple fonts and the usual text operators; encrypted files, object
streams and composite fonts are beyond it and give an error row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

from ..functions.text import clean_heading, escape_inline, norm_key, trim
from ..functions.vocab import MONO_FONTS

LARGER, GUTTER, SAME_LINE, INDENT = 1.12, 1.6, 0.5, 6
_BULLET = re.compile(r"[•·▪◦‣∙]\s*|[-–—]\s+(?=\S)")
_NUMBERED = re.compile(r"[0-9]{1,2}[.)]\s+(?=\S)")


@dataclass
class Glyph:
    text: str
    x: float
    y: float  # from the top
    width: float
    size: float
    font: str = ""


def glyph(raw: dict, page_height: float) -> Glyph:
    """A text item with its y measured from the top."""
    a, b, c, d, x, y = raw["transform"]
    return Glyph(raw["str"], x, page_height - y, raw["width"], raw.get("height") or max(abs(d), abs(b)), raw.get("fontName", ""))


@dataclass
class Line:
    items: list[Glyph]

    @property
    def y(self) -> float:
        return self.items[0].y

    @property
    def size(self) -> float:
        return max(i.size for i in self.items)

    @property
    def text(self) -> str:
        out = self.items[0].text
        for a, b in zip(self.items, self.items[1:], strict=False):
            out += ("" if b.x - a.x - a.width < 0.15 * b.size or out.endswith(" ") else " ") + b.text
        return out

    @property
    def mono(self) -> bool:
        return all(any(m.replace(" ", "") in i.font.lower().replace(" ", "").replace("-", "") for m in MONO_FONTS) for i in self.items)

    def cells(self) -> list[Glyph]:
        """Items joined up to wide gutters."""
        out: list[Glyph] = []
        for i in self.items:
            if out and i.x - out[-1].x - out[-1].width < GUTTER * i.size:
                last = out[-1]
                out[-1] = Glyph(f"{last.text} {i.text}", last.x, last.y, i.x + i.width - last.x, last.size, last.font)
            else:
                out.append(i)
        return out


def group_lines(items: list[Glyph]) -> list[Line]:
    """Items of one baseline, in the order of x."""
    lines: list[Line] = []
    for i in sorted((i for i in items if trim(i.text)), key=lambda i: (i.y, i.x)):
        if lines and abs(lines[-1].y - i.y) <= SAME_LINE * min(i.size, lines[-1].size):
            lines[-1].items.append(i)
        else:
            lines.append(Line([i]))
    for line in lines:
        line.items.sort(key=lambda i: i.x)
    return lines


def _furniture(pages: list[list[Line]]) -> set[tuple[int, int]]:
    """(page, line) of first and last lines that stand on most pages, digits aside, and of page numbers."""
    seen: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for p, lines in enumerate(pages):
        for n in {0, len(lines) - 1} & set(range(len(lines))):
            seen[re.sub("[0-9]+", "#", norm_key(lines[n].text))].add((p, n))
    least = max(2, (len(pages) + 1) // 2)
    return {at for key, places in seen.items() if len({p for p, _ in places}) >= least for at in places}


def _tables(lines: list[Line]) -> list[tuple[int, int]]:
    """P5: runs of lines whose cells start in the same columns."""
    out, n = [], 0
    while n < len(lines):
        columns = [c.x for c in lines[n].cells()]
        end = n + 1
        while len(columns) > 1 and end < len(lines):
            own = [c.x for c in lines[end].cells()]
            if len(own) < 2 or any(min(abs(x - c) for c in columns) > INDENT for x in own):
                break
            end += 1
        if len(columns) > 1 and end - n >= 2:
            out.append((n, end))
        n = max(end if out and out[-1][1] == end else n + 1, n + 1)
    return out


def lines_to_blocks(pages: list[list[Line]], keep_cover: bool = False) -> tuple[list[dict], dict]:
    """P3 to P10"""
    report: dict = {}
    if not any(pages):
        raise ValueError("this PDF has no text layer: it looks scanned")
    sizes: Counter = Counter()
    for lines in pages:
        for line in lines:
            sizes[round(line.size, 1)] += len(line.text)
    body = sizes.most_common(1)[0][0]
    first = pages[0]
    if not keep_cover and len(pages) > 1 and first and len(first) <= 6 and sum(x.size > LARGER * body for x in first) * 2 >= len(first):
        report["coverLines"] = [x.text for x in first]
        pages = pages[1:]
    gone = _furniture(pages)
    if gone:
        report["pdfFurnitureDropped"] = len(gone)
    pages = [[x for n, x in enumerate(lines) if (p, n) not in gone] for p, lines in enumerate(pages)]
    ladder = sorted({round(x.size, 1) for lines in pages for x in lines if x.size > LARGER * body and not x.mono}, reverse=True)
    level_of = {size: min(6, rank) for rank, size in enumerate(ladder, 1)}
    blocks: list[dict] = []
    for lines in pages:
        tables = dict(_tables(lines))
        n, previous = 0, None
        while n < len(lines):
            line, text = lines[n], trim(lines[n].text)
            if n in tables and not line.mono:
                blocks.append(_table(lines[n : tables[n]]))
                report["pdfTables"] = report.get("pdfTables", 0) + 1
                n, previous = tables[n], None
                continue
            if line.mono:
                blocks.append({"kind": "code", "text": line.text})
            elif round(line.size, 1) in level_of:
                blocks.append({"kind": "heading", "level": level_of[round(line.size, 1)], "text": clean_heading(text) or text})
            elif m := _BULLET.match(text):
                blocks.append({"kind": "list", "text": escape_inline(text[m.end() :]), "level": 0, "ordered": False})
            elif m := _NUMBERED.match(text):
                blocks.append({"kind": "list", "text": escape_inline(text[m.end() :]), "level": 0, "ordered": True})
            elif previous is not None and blocks and blocks[-1]["kind"] in ("para", "list") and line.y - previous.y <= 1.6 * line.size and abs(line.size - previous.size) < 0.5:
                joined = blocks[-1]["text"]
                blocks[-1]["text"] = joined[:-1] + escape_inline(text) if re.search("[a-zà-ÿ]-$", joined) and text[0].islower() else f"{joined} {escape_inline(text)}"
            else:
                blocks.append({"kind": "para", "text": escape_inline(text)})
            previous = line
            n += 1
    return blocks, report


def _table(lines: list[Line]) -> dict:
    columns = sorted({c.x for c in lines[0].cells()})
    rows = []
    for line in lines:
        row = [""] * len(columns)
        for c in line.cells():
            row[min(range(len(columns)), key=lambda k: abs(columns[k] - c.x))] = escape_inline(trim(c.text)).replace("|", "\\|")
        rows.append(row)
    return {"kind": "table", "rows": rows}


_STRING = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>"
_OPS = re.compile(rb"(?P<array>\[(?:" + _STRING + rb"|[^\]()<])*\])|(?P<str>" + _STRING + rb")|(?P<name>/[^\s/\[\]()<>]+)|(?P<num>[-+]?[0-9]*\.?[0-9]+)|(?P<op>[A-Za-z'\"*]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", raw[1:-1])) % 2)).decode("cp1252", "replace")

    def one(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.DOTALL).decode("cp1252", "replace")


def _show(raw: bytes) -> str:
    return "".join(_string(s) for s in re.findall(_STRING, raw)) if raw[:1] == b"[" else _string(raw)


def _glyphs(content: bytes, fonts: dict[str, str], height: float) -> list[Glyph]:
    out: list[Glyph] = []
    stack: list = []
    font, size, x, y, lead, scale = "", 10.0, 0.0, 0.0, 0.0, 1.0
    x0, y0 = 0.0, 0.0

    def show(text: str) -> None:
        nonlocal x
        width = len(text) * size * scale * (0.6 if "cour" in font.lower() else 0.5)
        out.append(Glyph(text, x, height - y, width, size * scale, font))
        x += width

    def move(dx: float, dy: float) -> None:
        nonlocal x0, y0, x, y
        x0, y0 = x0 + dx * scale, y0 + dy * scale
        x, y = x0, y0

    for m in _OPS.finditer(content):
        if m["op"] is None:
            stack.append(float(m[0]) if m["num"] else m[0])
            continue
        op, args = m["op"], stack
        stack = []
        try:
            if op == b"BT":
                x0 = y0 = x = y = 0.0
                scale = 1.0
            elif op == b"Tf":
                font, size = fonts.get(args[-2][1:].decode("latin-1"), ""), args[-1]
            elif op == b"TL":
                lead = args[-1]
            elif op in (b"Td", b"TD"):
                lead = -args[-1] if op == b"TD" else lead
                move(args[-2], args[-1])
            elif op == b"Tm":
                scale = abs(args[-3]) or abs(args[-4]) or 1.0
                x0, y0 = args[-2], args[-1]
                x, y = x0, y0
            elif op == b"T*":
                move(0, -lead)
            elif op in (b"Tj", b"TJ"):
                show(_show(args[-1]))
            elif op in (b"'", b'"'):
                move(0, -lead)
                show(_show(args[-1]))
        except (IndexError, TypeError):
            continue  # operands missing: the operator is skipped
    return out


def extract(content: bytes) -> list[list[Glyph]]:
    """Positioned text of each page."""
    if b"/Encrypt" in content:
        raise ValueError("this PDF is encrypted")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(?<![0-9])([0-9]+)\s+[0-9]+\s+obj\b(.*?)\bendobj", content)}

    def stream(body: bytes) -> bytes:
        head, _, data = body.partition(b"stream")
        data = re.sub(rb"\A\r?\n", b"", data)
        data = data[: data.rfind(b"endstream")] if b"endstream" in data else data
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in head else data

    def deref(body: bytes, key: bytes) -> list[int]:
        m = re.search(re.escape(key) + rb"\s*(\[[^\]]*\]|[0-9]+\s+[0-9]+\s+R)", body)
        return [int(n) for n in re.findall(rb"([0-9]+)\s+[0-9]+\s+R", m[1])] if m else []

    pages = []
    for number in sorted(objects):
        body = objects[number]
        if not re.search(rb"/Type\s*/Page(?![a-zA-Z])", body):
            continue
        box = re.search(rb"/MediaBox\s*\[\s*[-0-9.]+\s+[-0-9.]+\s+[-0-9.]+\s+([-0-9.]+)", body)
        resources = body + b"".join(objects.get(n, b"") for n in deref(body, b"/Resources"))
        names = {m[1].decode("latin-1"): int(m[2]) for m in re.finditer(rb"/([^\s/\[\]()<>]+)\s+([0-9]+)\s+[0-9]+\s+R", resources)}
        fonts = {name: base[1].decode("latin-1") for name, n in names.items() if (base := re.search(rb"/BaseFont\s*/([^\s/\[\]()<>]+)", objects.get(n, b"")))}
        data = b"\n".join(stream(objects[n]) for n in deref(body, b"/Contents") if n in objects)
        pages.append(_glyphs(data, fonts, float(box[1]) if box else 792.0))
    return pages


def pdf_to_blocks(content: bytes, keep_cover: bool = False) -> tuple[list[dict], dict]:
    return lines_to_blocks([group_lines(p) for p in extract(content)], keep_cover)
