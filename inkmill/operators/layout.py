"""Layout (G1 to G12): pages with source paths to the files of a synced documentation folder, for any number of archives at once.

Folders are arrays of names instead of pointers, and depth is bounded by three page levels, so there is no recursion. Where a page goes is
worked out from paths and slugs alone, which are written once; bodies are joined to their paths at the end. No folder is gathered for its
names (see ``free_names``); only an order list, being one text, holds all children of a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .kept import kept
from .names import free_names

DEEPEST = 3
NO_ORDER = 2**53 - 1


def collated(name: Column) -> Column:
    return F.collate(name, "UNICODE")


def _up(depth) -> Column:
    return F.slice("folder", 1, depth)


def tree(docs: DataFrame, default_category: str = "Documentation") -> DataFrame:
    """(archive, src_path, slug) with folder (names without number prefixes), stem, ord and is_index: whether it is its folder's own
    page, which of several such names is the first."""
    parts = F.filter(F.split("src_path", "/"), lambda p: p != "")
    raw = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    raw = F.when(F.size(raw) == 0, F.array(F.lit(default_category))).otherwise(F.transform(raw, C.strip_number_prefix))
    file = F.element_at(parts, -1)
    rows = docs.withColumns({"folder": raw, "stem": C.rx(file, r"\.[^.]+\Z", ""), "ord": C.order_key(file)})
    named = C.is_index_name(F.col("stem")) & (F.size("folder") >= 2)
    rivals = Window.partitionBy("archive", "folder", F.when(~named, F.col("src_path"))).orderBy("src_path")
    return rows.withColumn("is_index", named & (F.row_number().over(rivals) == 1))


class Placement:
    """Where everything goes: ``pages`` (archive, src_path, path, base, turn), ``folders`` (archive, folder, path, first), ``kids`` (archive,
    parent, kind, key, wanted, slug, ord) and ``rows``, the tree. docs: (src_path, slug) and, for several at once, archive."""

    def __init__(self, docs: DataFrame, default_category: str = "Documentation"):
        if "archive" not in docs.columns:
            docs = docs.withColumn("archive", F.lit(""))
        self.rows = kept(tree(docs.select("archive", "src_path", "slug"), default_category), "layout-rows")
        tops = F.transform(F.sequence(F.lit(1), F.size("folder")), lambda i: F.slice("folder", 1, i))
        folders = self.rows.select("archive", F.explode(tops).alias("folder"), "src_path").groupBy("archive", "folder").agg(F.min("src_path").alias("first"))
        self.kids = kept(self._kids(folders), "layout-kids")
        self.folders = kept(self._paths(folders), "layout-folders")
        self.pages = self._pages()

    def _kids(self, folders: DataFrame) -> DataFrame:
        """Children of each folder, with free slugs."""
        pages = self.rows.where("not is_index").where(F.size("folder") <= DEEPEST).select("archive", F.col("folder").alias("parent"), F.lit("page").alias("kind"), F.col("src_path").alias("key"), "ord", "slug")
        name = F.element_at("folder", -1)
        subs = folders.where(F.size("folder").between(2, DEEPEST + 1)).select(
            "archive", _up(F.size("folder") - 1).alias("parent"), F.lit("folder").alias("kind"), F.array_join("folder", "/").alias("key"), C.order_key(name).alias("ord"), C.slugify(C.strip_number_prefix(name)).alias("slug"),
        )
        all_kids = pages.unionByName(subs).withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), F.lit("page"))).withColumn("wanted", F.col("slug"))
        return free_names(all_kids, ["archive", "parent"], kid_order(), "slug")

    def _paths(self, folders: DataFrame) -> DataFrame:
        """Paths of folders, level by level: a category is itself, a folder its parent's path and its slug."""
        own = self.kids.where("kind = 'folder'").select("archive", "parent", "key", "slug")
        named = folders.withColumn("key", F.array_join("folder", "/"))
        level = named.where("size(folder) = 1").select("archive", "folder", "first", F.concat(F.lit("docs/"), F.col("folder")[0]).alias("path"))
        paths = level
        for depth in range(2, DEEPEST + 1):
            below = named.where(F.size("folder") == depth).withColumn("parent", _up(depth - 1)).join(own, ["archive", "parent", "key"])
            above = level.select("archive", F.col("folder").alias("parent"), F.col("path").alias("base"))
            level = below.join(above, ["archive", "parent"]).select("archive", "folder", "first", F.concat("base", F.lit("/"), "slug").alias("path"))
            paths = paths.unionByName(level)
        return paths

    def _pages(self) -> DataFrame:
        """The path of each document; turn orders those of one base as they are written: a folder's own page, then its children in
        order, and in a folder that is flattened pages before folders."""
        deep = F.size("folder") > DEEPEST
        key = F.when(deep, F.array_join(_up(DEEPEST + 1), "/")).when(~F.col("is_index"), F.col("src_path"))
        rows = self.rows.withColumns({"parent": _up(DEEPEST), "key": key, "kind": F.when(deep, "folder").otherwise("page")})
        bases = self.folders.select("archive", F.col("folder").alias("parent"), F.col("path").alias("base"))
        own = self.kids.select("archive", "parent", "kind", "key", F.col("slug").alias("own"), F.struct(*kid_order()).alias("place"))
        at = rows.join(bases, ["archive", "parent"]).join(own, ["archive", "parent", "kind", "key"], "left")
        # folders deeper than three levels are flattened into the last folder: slugs joined by dashes
        rest = F.transform(F.slice("folder", DEEPEST + 2, F.greatest(F.size("folder") - DEEPEST - 1, F.lit(0))), lambda p: C.slugify(C.strip_number_prefix(p)))
        tail = F.when(F.col("is_index"), F.array().cast("array<string>")).otherwise(F.array(F.col("slug")))
        name = F.when(deep, F.array_join(F.concat(F.array("own"), rest, tail), "-")).when(F.col("is_index"), F.lit("index")).otherwise(F.col("own"))
        return at.select("archive", "src_path", "folder", "is_index", F.concat("base", F.lit("/"), name, F.lit(".md")).alias("path"), "base", "place")

    def order_lists(self) -> DataFrame:
        """(archive, path, text) of the order lists of folders, and of the categories."""
        entry = F.struct(*kid_order(), F.col("slug").alias("shown"))
        lists = self.kids.groupBy("archive", "parent").agg(F.array_sort(F.collect_list(entry)).alias("o"))
        at = self.folders.select("archive", F.col("folder").alias("parent"), F.col("path").alias("base"))
        of_folders = lists.join(at, ["archive", "parent"]).select("archive", F.concat("base", F.lit("/_order.yaml")).alias("path"), F.array_join(F.transform("o", lambda x: C.yaml_item(x["shown"])), "").alias("text"))
        top = self.folders.where("size(folder) = 1").groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("first", F.col("folder")[0].alias("name")))).alias("o"))
        return of_folders.unionByName(top.select("archive", F.lit("docs/_order.yaml").alias("path"), F.array_join(F.transform("o", lambda x: C.yaml_item(x["name"])), "").alias("text")))

    def stubs(self) -> DataFrame:
        """(archive, path, text) of the pages of folders that have none of their own."""
        own = self.rows.where("is_index").select("archive", "folder")
        name = F.element_at("folder", -1)
        text = F.concat(F.lit('---\ntitle: "'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"\nhidden: true\n---\n'))
        return self.folders.where("size(folder) > 1").join(own, ["archive", "folder"], "left_anti").select("archive", F.concat("path", F.lit("/index.md")).alias("path"), text.alias("text"))

    def files(self, bodies: DataFrame) -> DataFrame:
        """(archive, path, text) of pages, pages of folders and order lists; bodies: (archive, src_path, body)."""
        pages = self.pages.join(bodies, ["archive", "src_path"]).select("archive", "path", F.col("body").alias("text"))
        return pages.unionByName(self.stubs()).unionByName(self.order_lists())

    def assets(self, files: DataFrame) -> DataFrame:
        """(archive, path, data) of files (archive, src_path, path, data) of the documents, beside their pages; of equal paths the one of the page
        that is written first stays."""
        # inside flattened folders: the first documents of the folders on the way down
        deep = F.size("folder") > DEEPEST
        up = F.explode(F.transform(F.sequence(F.lit(DEEPEST + 1), F.size("folder")), lambda i: F.struct(i.alias("depth"), F.slice("folder", 1, i).alias("folder"))))
        tops = self.rows.select("archive", F.explode(F.transform(F.sequence(F.lit(1), F.size("folder")), lambda i: F.slice("folder", 1, i))).alias("folder"), "src_path")
        firsts = tops.where(F.size("folder") > DEEPEST).groupBy("archive", "folder").agg(F.min("src_path").alias("first"))
        steps = self.rows.where(deep).select("archive", "src_path", up.alias("u")).select("archive", "src_path", "u.depth", "u.folder").join(firsts, ["archive", "folder"])
        down = steps.groupBy("archive", "src_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "first"))), lambda x: x["first"]).alias("down"))
        own_page = F.col("is_index") & (F.size("folder") <= DEEPEST)
        turn = F.struct((~own_page).alias("own"), "place", F.coalesce("down", F.array().cast("array<string>")).alias("down"), "is_index", "src_path")
        placed = self.pages.join(down, ["archive", "src_path"], "left").select("archive", "src_path", "base", turn.alias("turn"))
        placed = placed.join(files, ["archive", "src_path"]).withColumn("path", F.concat("base", F.lit("/"), "path"))
        nth = F.row_number().over(Window.partitionBy("archive", "path").orderBy("turn"))
        return placed.withColumn("_n", nth).where("_n = 1").select("archive", "path", "data")

    def warnings(self) -> DataFrame:
        """(archive, warning): slugs that were taken, and folders that were flattened."""
        clash = self.kids.where("slug <> wanted")
        folder = F.array_join("parent", "/")
        taken = clash.select("archive", F.concat(F.lit('"'), "wanted", F.lit('" is taken in "'), folder, F.lit('": the later one is "'), "slug", F.lit('"')).alias("warning"))
        deep = self.kids.where("kind = 'folder'").where(F.size("parent") >= DEEPEST)
        flat = deep.select("archive", F.concat(F.lit('"'), "key", F.lit(f'" is deeper than {DEEPEST} page levels: its pages are in "'), folder, F.lit('"')).alias("warning"))
        return taken.unionByName(flat)

    def summary(self) -> DataFrame:
        """(archive, metric, value): categories, pages, parents, stubs."""
        groups = (
            ("categories", self.folders.where("size(folder) = 1")), ("pages", self.rows.where((~F.col("is_index")) | (F.size("folder") > DEEPEST))),
            ("parents", self.folders.where("size(folder) > 1")), ("stubs", self.stubs()),
        )
        out = None
        for metric, rows in groups:
            one = rows.groupBy("archive").agg(F.count(F.lit(1)).alias("value")).select("archive", F.lit(metric).alias("metric"), "value")
            out = one if out is None else out.unionByName(one)
        return out


def kid_order() -> list[Column]:
    """Numbers first, then the wanted slug, in the order of a dictionary; of one slug pages come before folders."""
    return [F.col("ord"), collated(F.col("wanted")).alias("name"), (F.col("kind") == "folder").alias("is_folder"), F.col("key").alias("id")]


def layout(docs: DataFrame, default_category: str = "Documentation") -> DataFrame:
    """(path, text), with archive first where docs have one, of (src_path, slug, body)."""
    several = "archive" in docs.columns
    docs = docs if several else docs.withColumn("archive", F.lit(""))
    out = Placement(docs, default_category).files(docs.select("archive", "src_path", "body"))
    return out if several else out.drop("archive")


def assets(docs: DataFrame, files: DataFrame, default_category: str = "Documentation") -> DataFrame:
    """(path, data) of files (src_path, path, data) beside the pages of docs."""
    return Placement(docs, default_category).assets(files.withColumn("archive", F.lit(""))).drop("archive")


def specifications(specs: DataFrame) -> DataFrame:
    """(path, data), with archive first where specs have one, of specifications (name, content), and their order list."""
    several = "archive" in specs.columns
    specs = specs if several else specs.withColumn("archive", F.lit(""))
    base = F.element_at(F.split("name", "/"), -1)
    files = specs.select("archive", F.concat(F.lit("reference/"), base).alias("path"), F.col("content").alias("data"))
    order = specs.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("name", C.yaml_item(C.rx(base, r"(?i)\.(ya?ml|json)\Z", "")).alias("item")))).alias("o"))
    listed = order.select("archive", F.lit("reference/_order.yaml").alias("path"), F.encode(F.array_join(F.transform("o", lambda x: x["item"]), ""), "UTF-8").alias("data"))
    out = files.unionByName(listed)
    return out if several else out.drop("archive")
