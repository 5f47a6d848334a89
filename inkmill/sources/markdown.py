"""Markdown reader: a text to blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.mdx_table import clean_tables
from ..functions.text import NOT_S, S, SPACES, escape_stray_tags, trim
from ..functions.vocab import QUOTE_EMOJI

_FRONT = re.compile(r"---\r?\n([\s\S]*?)\r?\n---\r?\n?")
_PAIR = re.compile(rf"([A-Za-z_][A-Za-z0-9_.-]*){S}*:{S}*(.*)\Z")
_FENCE = re.compile(rf"{S}*(`{{3,}}|~{{3,}}){S}*({NOT_S}*)")
_TABLE = re.compile(rf"{S}*<Table(?![A-Za-z0-9_])", re.IGNORECASE)
_ORPHAN = re.compile(rf"{S}*(?:</{S}*(?:li|ul|ol){S}*>?{S}*)+\Z", re.IGNORECASE)
_CALLOUT = re.compile(rf"{S}*<Callout(?![A-Za-z0-9_])([^>]*)>{S}*\Z", re.IGNORECASE)
_CALLOUT_END = re.compile(rf"{S}*</Callout>{S}*\Z", re.IGNORECASE)
_ATX = re.compile(rf"(#{{1,6}}){S}+(.*?){S}*#*{S}*\Z")
_UNDERLINE = re.compile(rf"{S}*(=+|-+){S}*\Z")
_PIPE = re.compile(rf"{S}*\|")
_DELIMITER = re.compile(rf"{S}*\|?(?:{S}|[:|-])+\|(?:{S}|[:|-])*\Z")
_QUOTE = re.compile(rf"{S}*>")
_RULE = re.compile(rf"(?:{S}*(?:\*{S}*){{3,}}|{S}*(?:-{S}*){{3,}}|{S}*(?:_{S}*){{3,}})\Z")
_ITEM = re.compile(rf"({S}*)([-*+]|[0-9]{{1,3}}[.)]){S}+(.*)\Z")
_OPENER = re.compile(rf"{S}*#{{1,6}}{S}|{S}*(?:`{{3,}}|~{{3,}})|{S}*\||{S}*>|{S}*<Callout(?![A-Za-z0-9_])|{S}*<Table(?![A-Za-z0-9_])|{S}*(?:[-*+]|[0-9]{{1,3}}[.)]){S}+", re.IGNORECASE)
DEEPEST = 3


def split_frontmatter(text: str) -> tuple[dict[str, str], str | None, str]:
    """(keys and values, block as it is, rest)"""
    m = _FRONT.match(text)
    if not m:
        return {}, None, text
    pairs = (_PAIR.match(line) for line in re.split(r"\r?\n", m[1]))
    return {p[1]: re.sub(r"^[\"']|[\"']\Z", "", trim(p[2])) for p in pairs if p}, m[1], text[m.end() :]


def split_row(row: str) -> list[str]:
    """M8: cells of a pipe row; escaped pipes stay in their cell."""
    body = re.sub(rf"\|{S}*\Z", "", _PIPE.sub("", row, count=1))
    cells = [""]
    for token in re.findall(r"\\[\s\S]?|\||[^\\|]+", body):
        if token == "|":
            cells.append("")
        else:
            cells[-1] += token
    return [trim(c) for c in cells]


class Reader:
    """A cursor over lines; each rule takes the lines of one construct or declines."""

    def __init__(self, text: str):
        self.meta, self.raw, body = split_frontmatter(re.sub(r"\r\n?", "\n", text))
        self.lines = body.split("\n")
        self.at = 0
        self.blocks: list[dict] = []
        self.stats: dict[str, int] = {}
        self.report: dict = {}
        self.rules: tuple[Callable[[str], bool], ...] = (self.blank, self.fence, self.mdx_table, self.orphan, self.callout, self.atx, self.setext, self.pipe_table, self.quote, self.thematic, self.item_run, self.paragraph)

    def take(self, going: Callable[[str], bool]) -> list[str]:
        """Lines from here on for as long as going holds."""
        start = self.at
        while self.at < len(self.lines) and going(self.lines[self.at]):
            self.at += 1
        return self.lines[start : self.at]

    def next_line(self) -> str | None:
        return self.lines[self.at + 1] if self.at + 1 < len(self.lines) else None

    def safe(self, text: str) -> str:
        return escape_stray_tags(text, self.stats)

    def add(self, kind: str, **fields) -> None:
        self.blocks.append({"kind": kind, **fields})

    def count(self, key: str) -> None:
        self.report[key] = self.report.get(key, 0) + 1

    def read(self) -> None:
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if not any(rule(line) for rule in self.rules):
                self.at += 1

    # rules, in order

    def blank(self, line: str) -> bool:
        self.at += not trim(line)
        return not trim(line)

    def fence(self, line: str) -> bool:
        if not (m := _FENCE.match(line)):
            return False
        end = re.compile(rf"{S}*{m[1][0]}{{{len(m[1])},}}{S}*\Z")
        self.at += 1
        code = self.take(lambda x: not end.match(x))
        self.at += 1
        self.add("code", text="\n".join(code), lang=m[2])
        self.count("mdCodeBlocks")
        return True

    def mdx_table(self, line: str) -> bool:
        if not _TABLE.match(line):
            return False
        start, depth = self.at, 0
        while self.at < len(self.lines):
            own = self.lines[self.at]
            self.at += 1
            depth += len(re.findall(r"<Table(?![A-Za-z0-9_])", own, re.IGNORECASE)) - len(re.findall(rf"</{S}*Table(?![A-Za-z0-9_])", own, re.IGNORECASE))
            if depth <= 0:
                break
        text, stats = clean_tables("\n".join(self.lines[start : self.at]))
        for key, n in stats.items():
            self.report[key] = self.report.get(key, 0) + n
        self.add("mdxtable", text=trim(text))
        return True

    def orphan(self, line: str) -> bool:
        if not _ORPHAN.match(line):
            return False
        self.stats["orphanClosers"] = self.stats.get("orphanClosers", 0) + 1
        self.at += 1
        return True

    def callout(self, line: str) -> bool:
        if not (m := _CALLOUT.match(line)):
            return False
        icon = re.search(rf'icon{S}*={S}*"([^"]*)"', m[1])
        icon = icon[1] if icon and icon[1] else "📘"
        self.at += 1
        body = "\n".join(self.take(lambda x: not _CALLOUT_END.match(x)))
        self.at += 1
        self.add("callout", emoji=QUOTE_EMOJI.get(icon, icon), text=self.safe(trim(re.sub(rf"^#+{S}*", "", body))))
        return True

    def atx(self, line: str) -> bool:
        if not (m := _ATX.match(line)):
            return False
        self.add("heading", level=len(m[1]), text=trim(m[2]))
        self.at += 1
        return True

    def setext(self, line: str) -> bool:
        under = self.next_line()
        if under is None or not (m := _UNDERLINE.match(under)):
            return False
        self.add("heading", level=1 if m[1][0] == "=" else 2, text=trim(line))
        self.at += 2
        return True

    def pipe_table(self, line: str) -> bool:
        under = self.next_line()
        if not _PIPE.match(line) or under is None or not _DELIMITER.match(under):
            return False
        self.at += 2
        rows = [line, *self.take(lambda x: _PIPE.match(x) is not None)]
        self.add("table", rows=[[self.safe(c) for c in split_row(r)] for r in rows])
        self.count("mdTables")
        return True

    def quote(self, line: str) -> bool:
        if not _QUOTE.match(line):
            return False
        body = trim("\n".join(re.sub(rf"^{S}*>{S}?", "", x) for x in self.take(lambda x: _QUOTE.match(x) is not None)))
        glyph = body[:2] if body[1:2] == "️" else body[:1]
        if glyph in QUOTE_EMOJI:
            self.add("callout", emoji=QUOTE_EMOJI[glyph], text=self.safe(trim(body[len(glyph) :].lstrip(SPACES + ":—-"))))
        else:
            self.add("para", text=self.safe(body))
        return True

    def thematic(self, line: str) -> bool:
        self.at += (hit := _RULE.match(line) is not None)
        return hit

    def item_run(self, line: str) -> bool:
        if not _ITEM.match(line):
            return False
        columns: list[int] = []
        while self.at < len(self.lines):
            own = self.lines[self.at]
            if m := _ITEM.match(own):
                column = len(m[1].replace("\t", "    "))
                while len(columns) > 1 and column < columns[-1]:
                    columns.pop()
                if not columns or column > columns[-1]:
                    columns.append(column)
                self.add("list", text=self.safe(trim(m[3])), level=min(DEEPEST, len(columns) - 1), ordered=m[2][0].isdigit())
            elif trim(own):
                if own[0] not in SPACES or self.blocks[-1]["kind"] != "list":
                    break
                self.blocks[-1]["text"] += " " + self.safe(trim(own))
            elif not _ITEM.match(self.next_line() or ""):
                break
            self.at += 1
        return True

    def paragraph(self, line: str) -> bool:
        lines = self.take(lambda x: bool(trim(x)) and not _OPENER.match(x))
        if lines and (text := self.safe(trim(" ".join(lines)))):
            self.add("para", text=text)
        return bool(lines)


def markdown_to_blocks(text: str | None) -> tuple[list[dict], dict]:
    reader = Reader(text or "")
    reader.read()
    names = {"escapedTags": "mdEscapedTags", "selfClosed": "mdSelfClosed", "escapedBraces": "mdEscapedBraces", "comments": "mdComments", "orphanClosers": "mdOrphanClosers"}
    report = reader.report | {names[k]: v for k, v in reader.stats.items()}
    if reader.meta:
        report["mdFrontmatter"] = list(reader.meta)
    report |= {"mdTitle": reader.meta.get("title", ""), "mdSlug": trim(reader.meta.get("slug", "")), "mdRaw": reader.raw}
    return reader.blocks, report
