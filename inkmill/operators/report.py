"""Reports (K7, M17) as aggregates over the block table, and checks of rendered pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.mdx_table import clean_tables
from .blocks import DOC, document_rows
from .passes import convert_callouts, demote_labels, mark_cover, mark_sections, merge_code
from .render import numbered_images

SHOWN = 6


def roll_up(blocks: DataFrame) -> DataFrame:
    """Counters of each document."""
    return blocks.groupBy("doc_id").agg(
        F.count(F.when(F.col("kind") == "code", 1)).alias("code_blocks"),
        F.count_distinct(F.when(F.col("kind") == "heading", F.col("level"))).alias("levels"),
        F.max(F.length("text").cast("long")).alias("longest"),
        F.count(F.lit(1)).alias("blocks"),
    )


def first_labels(labels: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first distinct labels of each document, in its order."""
    first = labels.groupBy("doc_id", "text").agg(F.min("pos").alias("first"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))).where(F.col("n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("n", "text")))
    return ranked.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("labels"), F.count(F.lit(1)).alias("n_labels"))


#: Counters of members that an archive's report sums.
ARCHIVE_METRICS = ("codeBlocks", "callouts", "images", "autocorrectFixes", "mdEscapedTags", "pdfTables")


def long_form(read: DataFrame) -> DataFrame:
    """(doc_id, metric, value) of the readers' reports; lists are joined by commas."""
    pairs = F.explode(F.from_json("report", "map<string,string>")).alias("metric", "value")
    rows = read.where("report is not null").select("doc_id", pairs).where("value is not null and value <> '' and metric not in ('mdRaw', 'mdTitle', 'mdSlug', 'docxTitle')")
    listed = F.from_json("value", "array<string>")
    return rows.withColumn("value", F.when(F.col("value").startswith("["), F.coalesce(F.array_join(listed, ", "), "value")).otherwise(F.col("value")))


def reports(read: DataFrame, options) -> DataFrame:
    """K7: (doc_id, metric, value) of documents as read: the readers' counters, and what each pass did. read is best a written table,
    as every counter is an aggregate of its own over the block rows."""
    rows = document_rows(read.where("error is null"))
    out = long_form(read)

    def add(frame: DataFrame, metric: str, value: Column) -> None:
        nonlocal out
        one = frame.groupBy("doc_id").agg(value.cast("string").alias("value")).where("value is not null and value not in ('', '0')")
        out = out.unionByName(one.select("doc_id", F.lit(metric).alias("metric"), "value"))

    def listed(condition: Column, text: Column, joint: str = ", ") -> Column:
        found = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", text.alias("t")))))
        return F.array_join(F.transform(found, lambda x: x["t"]), joint)

    title = C.clean_heading(F.col("text"))
    heading = F.col("kind") == "heading"
    add(rows, "blocksIn", F.count(F.when(F.col("kind") != DOC, 1)))
    add(rows, "tocLines", F.count(F.when(F.col("kind") == "toc", 1)))
    marked = mark_sections(rows.where("kind <> 'toc'"), options.drop_sections)
    add(marked, "droppedSections", listed(F.col("_opens"), title))
    out_of = marked.where("not _in").drop("_in", "_opens")
    if not options.keep_cover:
        covered = mark_cover(out_of)
        shown = F.col("_cover") & F.col("kind").isin("para", "list") & (C.trim(F.coalesce("text", F.lit(""))) != "")
        add(covered, "coverLines", listed(shown, C.trim(F.col("text")), "\n"))
        out_of = covered.where("not _cover").drop("_cover")
    merged = merge_code(out_of, fixes=True)
    add(merged, "codeBlocks", F.count(F.when(F.col("kind") == "code", 1)))
    add(merged, "autocorrectFixes", F.sum("_fixed"))
    rest = merged.drop("_fixed")
    if not options.no_callouts:
        called = convert_callouts(rest.withColumn("_was", F.col("kind")))
        add(called, "callouts", F.count(F.when((F.col("kind") == "callout") & (F.col("_was") == "para"), 1)))
        rest = called.drop("_was")
    add(rest, "emptyHeadings", F.count(F.when(heading & (title == ""), 1)))
    demoted = demote_labels(rest.withColumns({"_was": F.col("kind"), "_head": F.when(heading, title)}), options.labels, options.label_style)
    add(demoted, "demoted", listed((F.col("_was") == "heading") & (F.col("kind") == "para"), F.col("_head")))
    used = F.array_sort(F.collect_set(F.when(heading, F.col("level"))))
    top, most = options.top_level, options.max_level
    to = lambda i: F.least(F.lit(6), F.lit(most), F.lit(top) + i)
    add(demoted, "headingMap", F.array_join(F.transform(used, lambda level, i: F.concat(F.lit("h"), level, F.lit("→h"), to(i))), ", "))
    flat = F.filter(used, lambda level, i: to(i) == min(6, most))
    add(demoted, "collapsedLevels", F.when(F.size(flat) > 1, F.array_join(F.transform(flat, lambda x: F.concat(F.lit("h"), x)), ", ")))
    shown = numbered_images(demoted.drop("_was", "_head"), options.image_dir).where("size(images) > 0").select("doc_id", F.explode(F.arrays_zip(F.col("images").alias("rid"), F.col("urls").alias("url"))).alias("i")).distinct()
    add(shown, "images", F.count("i.url"))
    add(shown, "missingImages", F.array_join(F.array_sort(F.collect_set(F.when(F.col("i.url").isNull(), F.col("i.rid")))), ", "))
    return out


_CODE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n[\s\S]*?^ {0,3}\1[^\n]*$|`+[^`\n]*`+", re.MULTILINE)
_HAZARD = re.compile(r"(?<!\\)\{(?!/\*)|(?<!\\)<(?!/?[A-Za-z][^<>]*>)(?!https?:)[A-Za-z/!]|(?<!\\)<(?=[A-Z_]+>)|<!--")


@F.pandas_udf(T.IntegerType())
def hazards(pages: pd.Series) -> pd.Series:
    """What would stop an MDX build: bare braces, placeholder tags and HTML comments outside code and frontmatter."""
    return pages.map(lambda page: 0 if page is None else len(_HAZARD.findall(_CODE.sub("", re.sub(r"\A---\n[\s\S]*?\n---\n", "", page)))))


@F.pandas_udf(T.StringType())
def cleaned_tables(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: clean_tables(text)[0])
