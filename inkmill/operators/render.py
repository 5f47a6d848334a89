"""Rendering (R1 to R6): a block table to page bodies by ordered aggregation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.text import S
from .blocks import DOC
from .passes import last_heading


def pipe_table(rows: Column) -> Column:
    """Rows padded to the widest, a bold header cell unbolded, at least one body row."""
    width = F.array_max(F.transform(rows, F.size))

    def padded(row: Column) -> Column:
        return F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))

    def filled(cell: Column) -> Column:
        return F.when(C.trim(cell) == "", " ").otherwise(C.trim(cell))

    def header(cell: Column) -> Column:
        inner = F.regexp_extract(C.trim(cell), r"(?s)^\*\*(.+)\*\*\z", 1)
        return F.when((inner != "") & ~inner.contains("**"), inner).otherwise(filled(cell))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    empty = F.array(F.array_repeat(F.lit(""), width))
    body = F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(empty)
    lines = F.concat(
        F.array(line(F.transform(padded(rows[0]), header)), line(F.array_repeat(F.lit("---"), width))),
        F.transform(body, lambda r: line(F.transform(padded(r), filled))),
    )
    return F.array_join(lines, "\n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _indented(kinds: pd.Series, levels: pd.Series, ordered: pd.Series, texts: pd.Series) -> pd.Series:
    """R2: texts of a document with list items indented to the content column of their parents."""

    def one(kinds, levels, ordered, texts):
        out, columns = [], [0]
        for kind, level, number, text in zip(kinds, levels, ordered, texts, strict=True):
            if kind != "list":
                columns = [0]
                out.append(text)
                continue
            depth = max(0, min(0 if level is None or level != level else int(level), len(columns) - 1))
            marker = "1. " if number else "- "
            out.append(" " * columns[depth] + marker + text)
            columns = [*columns[: depth + 1], columns[depth] + len(marker)]
        return out

    return pd.Series([None if row[0] is None else one(*row) for row in zip(kinds, levels, ordered, texts, strict=True)])


def block_text(callout_style: str = "component") -> Column:
    """The text of a block, list items without marker; null for what isn't rendered."""
    text, kind = F.coalesce("text", F.lit("")), F.col("kind")
    fence = C.fence_for(text)
    lang = F.coalesce("lang", C.infer_language(text, F.col("last_heading")))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), C.escape_heading(text)))
        .when(kind == "para", F.when(C.trim(text) != "", text))
        .when(kind == "list", C.rx(text, f"{S}*\n{S}*", "<br />"))
        .when(kind == "callout", C.render_callout(F.col("emoji"), text, callout_style))
        .when(kind == "code", F.concat(fence, lang, F.lit("\n"), text, F.lit("\n"), fence))
        .when(kind == "table", F.when(F.size("rows") > 0, pipe_table(F.col("rows"))).otherwise(""))
        .when(kind == "mdxtable", text)
    )


def numbered_images(blocks: DataFrame, folder: str) -> DataFrame:
    """Adds urls, those of a block's images or null where the package has no such part. Images are numbered in the order a document
    first refers to them, missing ones included."""
    doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = blocks.withColumn("_order", F.array_distinct(F.flatten(F.collect_list("images").over(doc)))).withColumn("_file", F.first("whole.filename", ignorenulls=True).over(doc))
    stem = C.slugify(C.rx(C.rx(F.col("_file"), "^.*/", ""), r"\.[^.]+\Z", ""))
    url = lambda rid, i: F.concat(F.lit(f"{folder}/"), stem, F.lit("-"), F.format_string("%02d", F.array_position("_order", rid)), F.get("exts", i))
    return rows.withColumn("urls", F.when(F.size("images") > 0, F.transform("images", url))).drop("_order", "_file")


def with_own_images(blocks: DataFrame) -> DataFrame:
    """Appends urls to the texts of paragraphs."""
    shown = F.transform(F.filter("urls", lambda u: u.isNotNull()), lambda u: F.concat(F.lit("![]("), u, F.lit(")")))
    lines = F.concat(F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.array("text")), shown)
    return blocks.withColumn("text", F.when((F.col("kind") == "para") & (F.size(shown) > 0), F.array_join(lines, "\n")).otherwise(F.col("text")))


def with_images(blocks: DataFrame, urls: DataFrame) -> DataFrame:
    """Appends the images of paragraphs, urls: (doc_id, rid, url)."""
    refs = blocks.where("kind = 'para' and size(images) > 0").select("doc_id", "pos", F.posexplode("images").alias("nth", "rid"))
    found = refs.join(urls, ["doc_id", "rid"]).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("![]("), "url", F.lit(")")).alias("md")))).alias("_md"))
    out = blocks.join(found, ["doc_id", "pos"], "left")
    lines = F.concat(F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.array("text")), F.transform("_md", lambda m: m["md"]))
    return out.withColumn("text", F.when(F.col("_md").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text"))).drop("_md")


def render(blocks: DataFrame, callout_style: str = "component", keys: tuple[str, ...] = ("doc_id",), more: tuple[Column, ...] = ()) -> DataFrame:
    """(keys, body), and more aggregates. The rows of a key are gathered once, in the order of pos; a document is the unit. A key of
    blanks alone has an empty page."""
    rows = last_heading(blocks, keys).withColumn("_text", block_text(callout_style))
    # a list item is reset by a block that renders to nothing, so such blocks stay until indentation is known
    shown = F.when(~F.col("kind").isin("blank", DOC), F.struct("pos", "kind", "level", "ordered", F.col("_text").alias("text")))
    docs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(shown)).alias("p"), *more)
    cols = [F.col(f"p.{c}") for c in ("kind", "level", "ordered", "text")]
    listed = F.array_contains(cols[0], "list")  # only documents with lists go through Python
    docs = docs.withColumn("texts", F.coalesce(_indented(*[F.when(listed, c) for c in cols]), cols[3]))
    body = F.array_join(F.filter("texts", lambda t: t.isNotNull()), "\n\n")
    body = C.rx(body, "\n{3,}", "\n\n")
    body = C.rx(body, rf"(?m)^({S}*(?:-|1\.) .*)\n\n(?={S}*(?:-|1\.) )", "$1\n")
    return docs.withColumn("body", F.concat(C.trim(body), F.lit("\n"))).drop("p", "texts")


def frontmatter(title: Column, hidden: bool, carried: Column | None = None) -> Column:
    """B12"""
    lines = [F.array(F.lit("---"), F.concat(F.lit("title: "), C.yaml_str(title)))]
    if hidden:
        lines.append(F.array(F.lit("hidden: true")))
    if carried is not None:
        lines.append(F.coalesce(carried, F.array().cast("array<string>")))
    return F.concat(F.array_join(F.concat(*lines, F.array(F.lit("---"))), "\n"), F.lit("\n\n"))
