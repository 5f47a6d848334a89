"""Conversion of documents to pages: readers per document, everything above blocks relational."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.vocab import OWNED_KEYS
from ..operators.blocks import BLOCKS, COLUMNS, DOC, MEDIA, document_rows, records
from ..operators.names import free_slugs
from ..operators.passes import apply_passes, split_several
from ..operators.render import frontmatter, numbered_images, render, with_images, with_own_images
from ..options import Options
from ..sources.docx import docx_document
from ..sources.formats import accepted, advice, format_of
from ..sources.html import html_to_blocks
from ..sources.markdown import markdown_to_blocks
from ..sources.pdf import pdf_to_blocks


def _read(fmt: str, content, keep_cover: bool = False) -> tuple[list[dict], dict, list[tuple[str, bytes]]]:
    """(blocks, report, parts that blocks refer to)"""
    data = b"" if content is None else bytes(content) if not isinstance(content, str) else content
    if fmt == "docx":
        return docx_document(data)
    if fmt == "pdf":
        return *pdf_to_blocks(data, keep_cover), []
    text = data if isinstance(data, str) else data.decode("utf-8", "replace").removeprefix("\ufeff")
    blocks, report = (html_to_blocks if fmt == "html" else markdown_to_blocks)(text)
    if not blocks:
        raise ValueError("no content found in this file")
    return blocks, report, []


def spread(files: DataFrame) -> DataFrame:
    """Deals few input partitions to all cores, as parsing (and generating) costs far more than moving; many are left as they are. Streams are, too."""
    if files.isStreaming:
        return files
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def read_documents(files: DataFrame, keep_cover: bool = False) -> DataFrame:
    """(doc_id, filename, fmt, content) to (doc_id, filename, blocks, report, media, error); a failed document is a row with its error.

    content may be text or bytes; rows are whole documents, so batches are kept small by the caller's
    spark.sql.execution.arrow.maxRecordsPerBatch. media has the image parts that blocks of a Word document refer to.
    """

    def scan(batches):
        for batch in batches:
            rows = []
            for doc_id, filename, fmt, content in batch.itertuples(index=False):
                try:
                    blocks, report, media = _read(fmt, content, keep_cover)
                    rows.append((doc_id, filename, records(blocks), json.dumps(report, ensure_ascii=False), [{"rid": r, "data": d} for r, d in media] or None, None))
                except Exception as failure:  # noqa: BLE001  one bad document must not end the job
                    rows.append((doc_id, filename, None, None, None, str(failure) or type(failure).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "blocks", "report", "media", "error"])

    files = spread(files.select("doc_id", "filename", "fmt", "content"))
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, filename string, blocks {BLOCKS}, report string, media {MEDIA}, error string"
    return files.mapInPandas(scan, schema)


def block_rows(read: DataFrame) -> DataFrame:
    """One row per block."""
    return read.where("error is null").select("doc_id", F.explode("blocks").alias("b")).select("doc_id", *[F.col(f"b.{c}").alias(c) for c in COLUMNS])


@F.pandas_udf(T.ArrayType(T.StringType()))
def carried_lines(raw: pd.Series) -> pd.Series:
    """Frontmatter lines of keys that conversion doesn't set, with what is nested in them."""
    import re

    from ..functions.text import SPACES, trim

    def one(text):
        out, dropping = [], False
        for line in (text or "").split("\n"):
            if key := re.match(r"([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*:", line):
                dropping = key[1].lower() in OWNED_KEYS
            elif not (line[:1] in SPACES and trim(line)):
                dropping = False
            if trim(line) and not dropping:
                out.append(line.rstrip(SPACES))
        return out

    return raw.map(one)


def _of_report(key: str) -> Column:
    return F.nullif(F.get_json_object("whole.report", f"$.{key}"), F.lit(""))


def convert(files: DataFrame, options: Options | None = None, image_urls: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, path, title, text, error, data): pages of documents (doc_id, filename, fmt, content), order lists of those that are
    split (section -1), and the images of Word documents as rows with data, section -1 and no text.

    image_urls: (doc_id, rid, url) of images that paragraphs refer to, where they are published elsewhere; no image rows then.
    """
    options = options or Options()
    return pages_of(read_documents(files, options.keep_cover), options, image_urls).drop("report")


def convert_files(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The same for files (path, filename, length, content) of any format, with the path as doc_id; names that aren't taken get an error row.
    Archives go to ``convert_archives``."""
    options = options or Options()
    found = format_of(accepted(files, options.force_markdown), options.force_markdown).where("fmt <> 'archive'")
    pages = convert(found.select(F.col("path").alias("doc_id"), "filename", "fmt", "content"), options)
    refused = advice(files, options.force_markdown).select(F.col("path").alias("doc_id"), F.lit(0).alias("section"), "error")
    return pages.unionByName(refused, allowMissingColumns=True)


_OUT = "section int, path string, title string, text string, error string, data binary"


def pages_of(read: DataFrame, options: Options, image_urls: DataFrame | None = None) -> DataFrame:
    """What ``convert`` returns, with the reader's report of each document on its first row.

    What belongs to a document as a whole travels as a row before its blocks, so documents are read in one pass, however many results they
    have; rows are dealt by doc_id before the passes, and again after the Python step that cleans code and, when split, after that which indents lists.
    """
    rows = apply_passes(document_rows(read), options)
    rows = with_own_images(numbered_images(rows, options.image_dir)) if image_urls is None else with_images(rows, image_urls).withColumn("urls", F.lit(None).cast("array<string>"))
    if options.split:
        rows = split_several(rows, min(6, options.top_level + options.split - 1))
    else:
        rows = rows.withColumns({"section": F.lit(0), "section_title": F.lit(None).cast("string")})
    more = (
        F.first("whole", ignorenulls=True).alias("whole"), F.max("section_title").alias("section_title"), F.count(F.when(F.col("kind") != DOC, 1)).alias("n"),
        F.flatten(F.collect_list(F.when(F.size("urls") > 0, F.arrays_zip(F.col("images").alias("rid"), F.col("urls").alias("url"))))).alias("shown"),
    )
    parts = render(rows.withColumn("section", F.col("section").cast("int")), options.callout_style, ("doc_id", "section"), more)
    one = F.struct("section", "section_title", "body", "n")
    if options.split:
        docs = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("parts"), F.first("whole", ignorenulls=True).alias("whole"), F.flatten(F.collect_list("shown")).alias("shown"))
    else:
        docs = parts.select("doc_id", F.array(one).alias("parts"), "whole", "shown")
    some = F.filter("parts", lambda p: (p["n"] > 0) | p["section_title"].isNotNull())
    docs = docs.withColumn("parts", F.when(F.size(some) > 0, some).otherwise(F.slice("parts", 1, 1)))
    found = F.coalesce(*[_of_report(k) for k in ("mdTitle", "htmlTitle", "docxTitle")], C.title_fallback(F.col("whole.filename")))
    docs = docs.withColumn("title", F.lit(options.title) if options.title else found)
    docs = docs.withColumn("titles", F.transform("parts", lambda p: F.coalesce(p["section_title"], F.col("title"))))
    prefix = f"{options.category}/" if options.category else ""
    none, no_data = F.lit(None).cast("string"), F.lit(None).cast("binary")

    def out(section, path, title, text, error, data) -> Column:
        return F.struct(*[v.alias(f.split()[0]) for v, f in zip((section, path, title, text, error, data), _OUT.split(", "), strict=True)])

    if options.split:
        docs = docs.withColumn("slugs", free_slugs(F.transform("titles", C.slugify))).withColumn("carried", F.lit(None).cast("array<string>"))
    else:
        stem = C.rx(C.rx(F.col("whole.filename"), "^.*/", ""), r"\.[^.]+\Z", "")
        docs = docs.withColumn("slugs", F.array(F.coalesce(_of_report("mdSlug"), C.slugify(stem)))).withColumn("carried", carried_lines(_of_report("mdRaw")))

    def page(part: Column, i: Column) -> Column:
        title = F.get("titles", i)
        head = F.lit("") if options.no_frontmatter else frontmatter(title, options.hidden, F.col("carried"))
        return out(part["section"], F.concat(F.lit(prefix), F.get("slugs", i), F.lit(".md")), title, F.concat(head, part["body"]), none, no_data)

    rows = [F.transform("parts", page)]
    if options.split:
        listed = F.array_join(F.transform("slugs", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
        rows.append(F.array(out(F.lit(-1), F.lit(f"{prefix}_order.yaml"), none, listed, none, no_data)))
    if image_urls is None:
        media = F.map_from_entries(F.coalesce("whole.media", F.array().cast(MEDIA)))
        used = F.filter(F.array_distinct("shown"), lambda x: x["url"].isNotNull())
        image = F.transform(used, lambda x: out(F.lit(-1), F.concat(F.lit(prefix), x["url"]), none, none, none, F.try_element_at(media, x["rid"])))
        rows.append(F.when(F.size("shown") > 0, image).otherwise(F.array().cast(f"array<struct<{_OUT.replace(' ', ': ')}>>".replace(",: ", ", "))))
    failed = F.array(out(F.lit(0), none, none, none, F.col("whole.error"), no_data))
    docs = docs.select("doc_id", F.col("whole.report").alias("report"), F.posexplode(F.when(F.col("whole.error").isNotNull(), failed).otherwise(F.concat(*rows))).alias("_at", "o"))
    return docs.select("doc_id", *[F.col(f"o.{f.split()[0]}") for f in _OUT.split(", ")], F.when(F.col("_at") == 0, F.col("report")).alias("report"))
