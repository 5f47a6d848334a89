"""Archives of documents (G12): every member converted, then laid out, for any number of archives at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.kept import kept
from ..operators.layout import Placement, specifications
from ..operators.report import ARCHIVE_METRICS, reports
from ..options import Options
from ..sources.formats import classified, format_of, members
from .convert import pages_of, read_documents

#: Between an archive and the name of a member; neither can hold it.
SEP = "\x00"


class Converted:
    """The members of archives (path, content), read once: ``found`` their classes, ``read`` their blocks, ``pages`` what became of them."""

    def __init__(self, archives: DataFrame, options: Options | None = None):
        options = options or Options()
        self.archives = archives.select(F.col("path").alias("archive"))
        self.category = options.category.strip() or "Documentation"
        # what is set for a run as a whole is not a member's: its title, its folder, splitting, leaving frontmatter out
        self.options = replace(options, category="", split=0, no_frontmatter=False, title="")
        self.found = kept(classified(members(archives)).where("role is not null"), "archive-members")
        files = self.found.where("role = 'doc'").select(F.concat("archive", F.lit(SEP), "name").alias("doc_id"), F.col("base").alias("filename"), "content")
        self.read = kept(read_documents(format_of(files).where("fmt <> 'archive'"), options.keep_cover), "archive-blocks")
        key = F.split("doc_id", SEP)
        self.pages = kept(pages_of(self.read, self.options).withColumns({"archive": key[0], "name": key[1]}), "archive-pages")
        self.docs = self._docs()
        self.placement = Placement(self.docs, self.category)

    def _docs(self) -> DataFrame:
        """(archive, src_path, slug, body): a page keeps the slug it declares."""
        stem = C.rx(F.element_at(F.split("name", "/"), -1), r"\.[^.]+\Z", "")
        declared = F.nullif(F.get_json_object("report", "$.mdSlug"), F.lit(""))
        rows = self.pages.where("text is not null")
        return rows.select("archive", F.col("name").alias("src_path"), F.coalesce(declared, C.slugify(C.strip_number_prefix(stem))).alias("slug"), F.col("text").alias("body"))

    def files(self) -> DataFrame:
        """(archive, path, text, data, error): files of the folder; members that fail, by name, and archives without a document have an error."""
        out = self.placement.files(self.docs.select("archive", "src_path", "body")).withColumn("data", F.lit(None).cast("binary"))
        images = self.pages.where("data is not null").select("archive", F.col("name").alias("src_path"), "path", "data")
        none = F.lit(None).cast("string")
        for more in (self.placement.assets(images), specifications(self.found.where("role = 'spec'").select("archive", "name", "content"))):
            out = out.unionByName(more.select("archive", "path", none.alias("text"), "data"))
        out = out.withColumn("error", none)
        full = self.docs.select("archive").distinct()
        out = out.join(full, "archive", "left_semi")  # nothing comes of an archive without documents, specifications included
        empty = self.archives.distinct().join(full, "archive", "left_anti").withColumns({"path": none, "error": F.lit("this archive has no document that can be read")})
        failed = self.pages.where("error is not null").select("archive", F.col("name").alias("path"), "error")
        bad = empty.unionByName(failed).withColumns({"text": none, "data": F.lit(None).cast("binary")})
        return out.unionByName(bad.select(*out.columns))

    def report(self) -> DataFrame:
        """(archive, metric, value): the layout's counts, the members' counters that are summed, and warnings."""
        of_members = reports(self.read, self.options).where(F.col("metric").isin(*ARCHIVE_METRICS))
        sums = of_members.groupBy(F.split("doc_id", SEP)[0].alias("archive"), "metric").agg(F.sum(F.col("value").try_cast("long")).alias("n"))
        loose = self.docs.where(~F.col("src_path").contains("/")).groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
        counts = self.placement.summary().select("archive", "metric", F.col("value").cast("string").alias("value"))
        parts = (
            sums.select("archive", "metric", F.col("n").cast("string").alias("value")),
            self.found.where("role = 'spec'").groupBy("archive").agg(F.count(F.lit(1)).cast("string").alias("value")).select("archive", F.lit("specs").alias("metric"), "value"),
            self.placement.warnings().select("archive", F.lit("warning").alias("metric"), F.col("warning").alias("value")),
            self.pages.where("error is not null").select("archive", F.lit("failed").alias("metric"), F.concat("name", F.lit(": "), "error").alias("value")),
            loose.select("archive", F.lit("note").alias("metric"), F.concat("n", F.lit(f' loose documents are in the category "{self.category}"')).alias("value")),
        )
        for part in parts:
            counts = counts.unionByName(part)
        return counts


def convert_archives(archives: DataFrame, options: Options | None = None) -> DataFrame:
    """(archive, path, text, data, error) of archives (path, content)."""
    return Converted(archives, options).files()


def archive_reports(archives: DataFrame, options: Options | None = None) -> DataFrame:
    """(archive, metric, value) of archives (path, content)."""
    return Converted(archives, options).report()


def member_errors(archives: DataFrame) -> DataFrame:
    """(archive, name, error) of members that can't be converted."""
    return Converted(archives).pages.where("error is not null").select("archive", "name", "error")
