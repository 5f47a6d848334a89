"""Column forms of the scalar text functions: built-in expressions only, so they stay in generated code."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HINTS, INDEX_NAMES, LANGUAGE_RULES, NO_ORDER, NOT_S, NUMBER_PREFIX, NUMBERING, PAGE_FRONTMATTER, PLAIN_ITEM, SPACES, STATUS_SUFFIX, STEP, S
from .vocab import CALLOUT_THEME, SMART_IN_CODE


def java(pattern: str) -> str:
    """A Python pattern in Java's spelling."""
    return pattern.replace("\\Z", "\\z")


def rx(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, java(pattern), by)


@functools.cache
def _accents() -> tuple[str, str]:
    """Characters that decompose to one character and marks, and that character."""
    rows = []
    for code in range(0xC0, 0x10000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        flat = [c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ"]
        if len(flat) == 1 and flat[0] != chr(code):
            rows.append((chr(code), flat[0]))
    return "".join(a for a, _ in rows), "".join(b for _, b in rows)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return trim(rx(text, f"{S}+", " "))


def deaccent(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u0300-\\u036f]", ""), *_accents())


def norm_key(text: Column) -> Column:
    key = rx(trim(F.lower(deaccent(text))), "[‐-―−]", "-")
    return trim(rx(rx(key, r"[:.;,]+\Z", ""), f"{S}+", " "))


def slugify(text: Column) -> Column:
    slug = F.btrim(rx(F.lower(deaccent(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "page").otherwise(slug)


def encode_link_target(url: Column) -> Column:
    out = rx(trim(F.coalesce(url, F.lit(""))), S, "%20")
    for char in "<>()":
        out = F.replace(out, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return out


def wrap_emphasis(piece: Column, marker: str) -> Column:
    return rx(piece, rf"(?s)^({S}*)({NOT_S}(?:.*{NOT_S})?)({S}*)\Z", rf"$1{marker}$2{marker}$3".replace("*", "\\*"))


def clean_heading(text: Column) -> Column:
    t = trim(rx(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), "\t", "  "))
    t = collapse(rx(t, STEP, "$1 $2 — "))
    return F.btrim(rx(t, NUMBERING, ""), F.lit(SPACES + "."))


def escape_heading(text: Column) -> Column:
    return rx(F.coalesce(text, F.lit("")), r"(?<!\\)([<>{}])", r"\\$1")


def desmarten(text: Column) -> Column:
    single = {k: v for k, v in SMART_IN_CODE.items() if len(v) == 1}
    gone = "".join(k for k, v in SMART_IN_CODE.items() if not v)
    out = F.translate(text, "".join(single) + gone, "".join(single.values()))
    for k, v in SMART_IN_CODE.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out



def infer_language(text: Column, heading: Column) -> Column:
    head = rx(text, f"^{S}+", "")
    first = trim(F.split(head, "\n", 2)[0])
    out = F.lit("")
    key = norm_key(heading)
    for word, lang in reversed(HINTS):
        out = F.when(key.contains(word), lang).otherwise(out)
    for what, pattern, lang in reversed(LANGUAGE_RULES):
        out = F.when((head if what == "head" else first).rlike(java(pattern)), lang).otherwise(out)
    return out


def label_stem(title: Column) -> Column:
    return norm_key(rx(title, STATUS_SUFFIX, ""))


def fence_for(text: Column) -> Column:
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?m)^ {0,3}(`{3,})"), F.lit(1))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r) + 1)), F.lit(3))))


def yaml_str(value: Column) -> Column:
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), trim(rx(text, "[\r\n]+", " ")), F.lit('"'))


def yaml_item(value: Column) -> Column:
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = value.rlike(java(PLAIN_ITEM[:-1] + r"\Z")) & (trim(value) == value)
    return F.when(plain, F.concat(F.lit("- "), value, F.lit("\n"))).otherwise(F.concat(F.lit('- "'), quoted, F.lit('"\n')))


def order_key(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, java(NUMBER_PREFIX), 1).try_cast("bigint"), F.lit(NO_ORDER))


def strip_number_prefix(name: Column) -> Column:
    return rx(name, NUMBER_PREFIX, "")


def is_index_name(stem: Column) -> Column:
    return F.lower(trim(strip_number_prefix(stem))).isin(*INDEX_NAMES)


def strip_page_frontmatter(text: Column) -> Column:
    return rx(text, "\\A" + PAGE_FRONTMATTER[1:], "")


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def title_fallback(filename: Column) -> Column:
    stem = rx(rx(filename, "^.*/", ""), r"\.[^.]+\Z", "")
    return F.when(stem == "pasted", "").otherwise(trim(rx(stem, "[-_]+", " ")))


def render_callout(emoji: Column, text: Column, style: str) -> Column:
    body = trim(text)
    if style == "plain":
        return body
    if style == "blockquote":
        return F.concat(F.lit("> "), emoji, F.lit(" "), F.replace(body, F.lit("\n"), F.lit("\n> ")))
    theme = F.lit("default")
    for glyph, name in CALLOUT_THEME.items():
        theme = F.when(emoji == glyph, name).otherwise(theme)
    return F.concat(F.lit('<Callout icon="'), emoji, F.lit('" theme="'), theme, F.lit('">\n'), body, F.lit("\n</Callout>"))
