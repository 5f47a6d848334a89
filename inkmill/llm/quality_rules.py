"""Line-first quality rules.

Every line that has a word is judged by itself: it fails if it does not end in closing
punctuation, is navigation (two or more words that are only separators), holds a boilerplate phrase, shouts
(over 60 % of at least ten ASCII letters are capitals), or has a symbol of ``#*$%&|<>`` in over 30 % of
its words. Failing lines are removed; a document that loses over half of its word characters is
rejected, as is one that fails the base rules (under 50 words, or over half of the words in
3-word windows that the text repeats).

Null and empty texts have no words, so they fail the base rules. Lines are separated by ``\\n`` only and lines without
a word are kept as they are. Rows that repeat are judged alike and all returned; an empty table gives no rows. Only doc_id, text and the columns
of carry are read, so other columns may have any names. There are no ties. Long texts are split into words in stretches; windows of three words are
compared by 64-bit hashes, so memory is about twelve times a text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WHITE, python_map
from .rolling import chunks
from .words import Words

SYMBOLS = b"#*$%&|<>"
CLOSERS = ".!?:;…\"'”’»)]。！？；：｡」』）】》।؟۔"
CLOSING = tuple(c.encode() for c in CLOSERS)
SEPARATORS = frozenset(c.encode() for c in ("|", ">", ">>", "»", "·", "•", "/", "-", "–"))
BOILERPLATE = (
    "accept cookies|cookie policy|enable javascript|all rights reserved|terms of use|terms of service|privacy policy|"
    "lorem ipsum|sign in to|log in to|subscribe to our|read more|click here|share this|back to top|skip to content"
)
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SHOUT_PERCENT, SHOUT_LETTERS, SYMBOL_PERCENT, LOSS_PERCENT = 60, 10, 30, 50

_CHUNK = 1 << 20
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PHRASE = re.compile(BOILERPLATE.encode(), re.IGNORECASE)
_SYMBOL = re.compile(b"[#*$%&|<>]")


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def _points(data: bytes) -> int:
    """Code points of data that are not white space."""
    data = data.translate(None, WHITE)
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def line_fails(line: bytes) -> bool:
    """line has a word."""
    if not line.rstrip(WHITE).endswith(CLOSING) or _PHRASE.search(line):
        return True
    upper = _count(line, _UPPER)
    if upper >= SHOUT_LETTERS and 100 * upper > SHOUT_PERCENT * (upper + _count(line, _LOWER)):
        return True
    words = line.split()
    if sum(w in SEPARATORS for w in words) >= 2:
        return True
    return bool(_SYMBOL.search(line)) and 100 * sum(_SYMBOL.search(w) is not None for w in words) > SYMBOL_PERCENT * len(words)


def repeat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in 3-word windows that the text has twice or more) of each text."""
    words = Words(texts, lower=False)
    n = np.diff(words.edges)
    repeated = np.zeros(len(texts), dtype=np.int64)
    for i, (first, h) in enumerate(words.shingles(3)):
        if n[i] < 4:
            continue
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            hit = np.zeros(n[i], dtype=bool)
            for twice in (order[1:][same], order[:-1][same]):
                at = first[twice] - first[0]
                for k in range(3):
                    hit[at + k] = True
            repeated[i] = hit.sum()
    return n, repeated


def judge(data: bytes, n: int, repeated: int) -> tuple[tuple, bytes]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars, base_failed, kept), cleaned text."""
    chars = _points(data)
    seen, left, dups, kept_chars = set(), [], 0, 0
    verdicts: dict[bytes, bool] = {}
    for line in data.split(b"\n"):
        if line.strip(WHITE):
            dups += line in seen
            seen.add(line)
            if (bad := verdicts.get(line)) is None:
                bad = verdicts[line] = line_fails(line)
            if bad:
                continue
            kept_chars += _points(line)
        left.append(line)
    base = n < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * n
    keep = not base and 100 * (chars - kept_chars) <= LOSS_PERCENT * chars
    return (n, chars, _count(data, SYMBOLS), dups, repeated, kept_chars, base, keep), b"\n".join(left)


def judged(texts: list[bytes]) -> list[tuple[tuple, bytes]]:
    out = []
    for lo, hi in chunks([len(t) for t in texts], _CHUNK):
        counts = repeat_words(texts[lo:hi])
        out += [judge(t, n, r) for t, n, r in zip(texts[lo:hi], *(c.tolist() for c in counts), strict=True)]
    return out


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, kept_chars long, base_failed boolean, kept boolean"


def _scan(with_text: bool):
    def scan(batch):
        found = judged([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
        types = [pa.int64()] * 6 + [pa.bool_()] * 2
        cols = [pa.array(c, t) for c, t in zip(zip(*(f[0] for f in found)), types)]  # noqa: B905
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        if with_text:
            cols.append(pa.array([f[1].decode("utf-8", "replace") for f in found]))
            names.append("clean_text")
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *cols], [*rest.schema.names, *names])

    return scan


def quality_rules(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, the counts and verdicts, and with_text the text of the lines left as clean_text."""
    rest = [docs.schema[c] for c in ("doc_id", *carry)]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return python_map(docs.select(*[f.name for f in rest], "text"), _scan(with_text), fields + _FIELDS + ", clean_text string" * with_text)
