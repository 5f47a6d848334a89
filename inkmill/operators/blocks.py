"""The block table: one row per block, in the order of pos."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "pos int, kind string, level int, text string, ordered boolean, lang string, emoji string, rows array<array<string>>, images array<string>, exts array<string>"
COLUMNS = tuple(f.split()[0] for f in FIELDS.split(", "))
BLOCKS = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FIELDS.split(', '))}>>"


#: The kind of a row that stands before the blocks of a document and has what belongs to it as a whole; passes let it through.
DOC = "doc"
MEDIA = "array<struct<rid: string, data: binary>>"
WHOLE = f"struct<filename: string, report: string, media: {MEDIA}, error: string>"


def records(blocks: Iterable[dict]) -> list[dict]:
    """Reader blocks with all fields, numbered."""
    return [{**dict.fromkeys(COLUMNS), **b, "pos": i} for i, b in enumerate(blocks)]


def document_rows(read: DataFrame) -> DataFrame:
    """One row per block, and before them one of kind DOC per document, also of those that failed or have no block: pos, kind, ..., whole."""
    whole = F.struct("filename", "report", "media", "error").cast(WHOLE)
    types = {f.split()[0]: f.split(" ", 1)[1] for f in FIELDS.split(", ")}
    first = {"pos": F.lit(-1), "kind": F.lit(DOC)}
    head = F.struct(*[first.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()], whole.alias("whole"))
    rest = F.transform(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: F.struct(*[b[c].alias(c) for c in COLUMNS], F.lit(None).cast(WHOLE).alias("whole")))
    rows = read.select("doc_id", F.explode(F.concat(F.array(head), rest)).alias("b"))
    return rows.select("doc_id", *[F.col(f"b.{c}").alias(c) for c in (*COLUMNS, "whole")])
