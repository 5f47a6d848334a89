"""Exact dedup by content-defined chunk recipes.

A normalised text (white space removed) is cut where a rolling hash of its last
48 bytes meets a mask, so equal stretches are cut alike wherever they stand. A
chunk is identified by 128 bits of SHA-256 and its length. The chunk table counts the uses of
every identifier, and verifies it: the bytes of all chunks that share an identifier are compared, one copy a task being moved,
and the query fails if two differ. Chunks that are used once need no verification and aren't moved. Texts are
equal when their ordered lists of verified identifiers are equal, so documents are compared by 20 bytes a
kilobyte, and the texts themselves never move.

Null and empty texts both normalise to the empty recipe and form one group. Of the texts of a group the one with the most code points
stays, ties go to the smallest doc_id (null last). Repeated rows are separate members of their group; rows that agree in doc_id, text and length with the one
that stays are all marked as kept. An empty table gives no rows. Only doc_id and text are read, so other columns may have any names. Long texts are hashed in
stretches of STRETCH bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, attach, bitmap, in_bitmap, python_map, stash
from .rolling import A, U, mix

LEAST, MASK_BITS, MOST, GRAM = 512, 10, 8192, 48
STRETCH = 1 << 20


def _marks(data: bytes) -> np.ndarray:
    """Offsets after which the rolling hash allows a cut."""
    out = []
    for lo in range(0, len(data) - GRAM + 1, STRETCH):
        part = np.frombuffer(data, np.uint8, count=min(STRETCH + GRAM - 1, len(data) - lo), offset=lo)
        h = mix(A.windows(A.prefix(part), GRAM))
        out.append(np.flatnonzero(h & U((1 << MASK_BITS) - 1) == 0) + lo + GRAM)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def cuts(data: bytes) -> list[int]:
    """End offsets of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    out, last = [], 0
    for e in [*_marks(data).tolist(), n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == n and e > last:
            out.append(e)
            last = e
    return out


def chunks_of(data: bytes) -> list[tuple[bytes, bytes]]:
    """(identifier, chunk) in order."""
    ends = cuts(data)
    parts = [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]
    return [(hashlib.sha256(p).digest()[:16] + len(p).to_bytes(4, "big"), p) for p in parts]


def _raw(text) -> bytes:
    buffer = text.as_buffer() if text.is_valid else None
    return bytes(buffer) if buffer is not None else b""


def _points(raw: bytes) -> int:
    """Code points of UTF-8."""
    if raw.isascii():
        return len(raw)
    data = np.frombuffer(raw, np.uint8)
    return sum(int(np.count_nonzero(data[lo : lo + STRETCH] & 0xC0 != 0x80)) for lo in range(0, len(data), STRETCH))


def _recipes(batch: pa.RecordBatch):
    points, shas, lists = [], [], []
    for text in batch.column(1):
        raw = _raw(text)
        data = raw.translate(None, WHITE)
        points.append(_points(raw))
        shas.append(hashlib.sha256(data).hexdigest())
        lists.append([i for i, _ in chunks_of(data)])
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64()), pa.array(shas), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_points", "text_sha256", "recipe"])


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, text_sha256, recipe) per row."""
    return python_map(docs.select("doc_id", "text"), _recipes, "doc_id long, n_points long, text_sha256 string, recipe array<binary>")


def _number(chunk_id: str) -> Column:
    """56 bits of an identifier, as bitmap takes them."""
    return F.conv(F.hex(F.substring(chunk_id, 1, 7)), 16, 10).cast("long")


def _shared(words: np.ndarray):
    """The chunks of a batch that are in a bitmap, each once."""

    def scan(batch):
        found = dict.fromkeys(c for text in batch.column(0) for c in chunks_of(_raw(text).translate(None, WHITE)))
        ids = [i for i, _ in found]
        ok = in_bitmap(words, np.array([int.from_bytes(i[:7], "big") for i in ids], dtype=np.int64)) if ids else np.zeros(0, dtype=bool)
        some = [c for c, yes in zip(found, ok.tolist(), strict=True) if yes]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in some], pa.binary()) for k in (0, 1)], ["chunk_id", "data"])

    return scan


def verified(data: DataFrame) -> DataFrame:
    """(chunk_id, n_bytes) of (chunk_id, data); it fails if data of one identifier differ."""
    seen = data.groupBy("chunk_id").agg(F.min("data").alias("lo"), F.max("data").alias("hi"))
    bad = F.raise_error(F.concat(F.lit("different chunks have the identifier "), F.hex("chunk_id")))
    return seen.select("chunk_id", F.when(F.col("lo") == F.col("hi"), F.octet_length("lo").cast("long")).otherwise(bad).alias("n_bytes"))


def chunk_table(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Every distinct chunk (chunk_id, n_uses, n_bytes), verified. rows: the recipes of docs, where they are at hand."""
    rows = recipes(docs) if rows is None else rows
    uses = stash(rows.select(F.explode("recipe").alias("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_uses")), "chunk-uses")
    words = bitmap(uses.where("n_uses > 1").select(_number("chunk_id").alias("h")), "h")
    seen = verified(python_map(docs.select("text"), _shared(words), "chunk_id binary, data binary"))
    size = F.conv(F.hex(F.substring("chunk_id", 17, 4)), 16, 10).cast("long")
    return stash(uses.join(seen, "chunk_id", "left").select("chunk_id", "n_uses", F.coalesce("n_bytes", size).alias("n_bytes")), "chunk-table")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    rows = stash(recipes(docs), "recipes")
    chunk_table(docs, rows)
    best = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id")
    groups = rows.groupBy("recipe").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = stash(groups.select("recipe", F.col("best.doc_id").alias("keep_id"), (-F.col("best.p")).alias("most"), "group_size"), "recipe-groups")
    out = attach(rows, groups, ["recipe"], "group_size", rows.count())
    kept = F.equal_null("doc_id", "keep_id") & (F.col("n_points") == F.col("most"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_points")
