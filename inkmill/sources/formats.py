"""Format detection and archive members (S1 to S6, S10 to S13) over (path, content) rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACES

DOC_MEMBER = r"(?i)\.(docx|pdf|md|markdown|mdx|txt|html?|xhtml)$"
SPEC_MEMBER = r"(?i)\.(ya?ml|json)$"
REFUSED = r"(?i)\.(doc|docm|rtf|odt|pages)$"
ACCEPTED_NAME = r"(?i)\.(docx|pdf|html?|xhtml|md|markdown|mdx|txt|zip)$"
MARKDOWN_NAME = r"(?i)\.(md|markdown|mdx|txt)$"


def read_folder(spark, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, length, content) of files, of which Spark reads the bytes."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def _head(content: Column, n: int) -> Column:
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def looks_html(name: Column, content: Column) -> Column:
    """S3"""
    head = F.lower(F.btrim(_head(content, 512), F.lit(" \t\r\n\xef\xbb\xbf")))
    return name.rlike(r"(?i)\.(html?|xhtml)$") | head.rlike(r"^(<!doctype html|<html[\s>]|<\?xml[^>]*>\s*<!doctype html)")


def looks_markdown(name: Column, content: Column) -> Column:
    """By name, or any bytes that are no zip, PDF, old Word or binary file."""
    head = _head(content, 512)
    magic = F.hex(F.substring(content, 1, 2))
    binary = magic.isin("504B", "D0CF") | head.contains("%PDF-") | head.contains("\x00")
    return name.rlike(r"(?i)\.(md|markdown|mdx|txt)$") | ~binary


def looks_pdf(content: Column) -> Column:
    """S5"""
    return _head(content, 1024).contains("%PDF-")


def _members_of(content: bytes | None) -> list[tuple[str, bytes]] | None:
    """Stored and deflated members; a name that repeats has its last content. None for what is no zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            found = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)}
    except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError, RuntimeError):
        return None
    return sorted(found.items())


@F.pandas_udf(T.BooleanType())
def _is_archive(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "word/document.xml" not in z.namelist()
        except (zipfile.BadZipFile, OSError):
            return False

    return content.map(one)


def format_of(files: DataFrame, force_markdown: bool = False) -> DataFrame:
    """Adds fmt: archive, html, markdown, pdf or docx. Only zips are looked into."""
    name, content = F.col("filename"), F.col("content")
    zipped = (F.hex(F.substring(content, 1, 2)) == "504B") & ~name.rlike(r"(?i)\.docx$")
    fmt = (
        F.when(zipped & F.coalesce(_is_archive(F.when(zipped, content).otherwise(F.lit(b""))), F.lit(False)), "archive")
        .when(looks_html(name, content), "html")
        .when(F.lit(force_markdown) | looks_markdown(name, content), "markdown")
        .when(looks_pdf(content), "pdf")
        .otherwise("docx")
    )
    return files.withColumn("fmt", fmt)


def members(archives: DataFrame) -> DataFrame:
    """(archive, name, content) of archives (path, content), one row per member."""

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for name, data in _members_of(content) or ():
                    yield pd.DataFrame({"archive": [path], "name": [name], "content": [data]})

    return archives.select("path", "content").mapInPandas(scan, "archive string, name string, content binary")


def classified(rows: DataFrame) -> DataFrame:
    """Adds base and role: doc, spec, or null for noise."""
    base = F.element_at(F.split("name", "/"), -1)
    noise = (base == "") | base.startswith(".") | F.col("name").startswith("__MACOSX/")
    spec = base.rlike(SPEC_MEMBER) & ~base.rlike(DOC_MEMBER)
    smells = _head(F.col("content"), 400).rlike("(?i)openapi|swagger")
    return rows.withColumn("base", base).withColumn("role", F.when(~noise, F.when(spec, F.when(smells, "spec")).when(base.rlike(DOC_MEMBER), "doc")))


def accepted(files: DataFrame, markdown_mode: bool = False) -> DataFrame:
    """Files whose names are taken, one of each name and length (the smallest path)."""
    allowed = MARKDOWN_NAME if markdown_mode else ACCEPTED_NAME
    nth = F.row_number().over(Window.partitionBy("filename", "length").orderBy("path"))
    return files.where(F.col("filename").rlike(allowed)).withColumn("_n", nth).where("_n = 1").drop("_n")


def advice(files: DataFrame, markdown_mode: bool = False) -> DataFrame:
    """Files whose names aren't taken, with an error that says what to do."""
    allowed = MARKDOWN_NAME if markdown_mode else ACCEPTED_NAME
    ext = F.lower(F.regexp_extract("filename", REFUSED, 1))
    say = F.when(ext == "pages", "Pages files can't be read: export this one as .docx").when(ext != "", F.concat(F.lit("."), ext, F.lit(" files can't be read: save this one as .docx"))).otherwise("this is no document of a known format")
    return files.where(~F.col("filename").rlike(allowed)).withColumn("error", say)


def pasted_texts(texts: DataFrame) -> DataFrame:
    """Pasted texts (path, text) as files; the file's name says that it has no title of its own."""
    trimmed = F.btrim("text", F.lit(SPACES))
    return texts.select("path", F.lit("pasted.md").alias("filename"), F.octet_length(trimmed).cast("long").alias("length"), F.encode(trimmed, "UTF-8").alias("content"))


def pasted(spark, text: str) -> DataFrame:
    """One pasted text as a file."""
    return pasted_texts(spark.createDataFrame([("pasted.md", text)], "path string, text string"))
