"""Line dedup by site-relative frequency. DataFrame functions only.

Pages are grouped by host. A line's frequency is the number of the host's pages that have it over the
host's pages; lines above ratio are boilerplate there and dropped from its pages. The one exception is explicit and off by default: hosts of
under least_pages pages are left alone (on a host of one page every line is on all pages).
Lines are the visible text of the HTML between block tags, trimmed, without empty ones.

Counts are aggregated before the shuffle, over 128-bit digests of lines. A host has at most its mean number of lines per page / ratio
boilerplate lines, whatever its pages, so one array per host is joined back; hosts with a large share of pages are
dealt over salts. Null or empty HTML has no lines; pages without a host are left alone. Rows that repeat a page_id count as one page, so do
those of a host without page_id, and all rows are returned; an empty table gives no rows. A frequency equal to the ratio does not exceed it. Only page_id, url
and html are read, so other columns may have any names. Long pages are one string in the JVM, with some copies of it while tags are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stash
from .url_filters import host_of

RATIO = 0.3
BLOCKS = "p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|br|table|tr|td|th|title|head|body|html|main|aside|blockquote|pre|hr|dd|dt|dl|form"


def lines_of(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, by in ((r"(?is)<script\b.*?</script\s*>", ""), (r"(?is)<style\b.*?</style\s*>", ""), (r"(?s)<!--.*?-->", ""), (rf"(?i)</?({BLOCKS})\b[^>]*>", "\n"), ("<[^>]*>", "")):
        text = F.regexp_replace(text, pattern, by)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^[ \\t\\x0B-\\r]+|[ \\t\\x0B-\\r]+$", "")), lambda x: x != "")


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def line_dedup(pages: DataFrame, ratio: float = RATIO, least_pages: int = 1) -> DataFrame:
    """One row per row of pages: page_id, host, n_lines, n_dropped, clean_text."""
    rows = stash(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    single = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    named = rows.where("host <> ''").select("host", "page_id", F.array_distinct(F.transform("lines", _digest)).alias("ds"))
    each = named if single else named.select("host", "page_id", F.explode_outer("ds").alias("d")).distinct().groupBy("host", "page_id").agg(F.collect_list("d").alias("ds"))
    hosts = each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = each.select("host", F.explode_outer("ds").alias("d")).where("d is not null").groupBy("host", "d").agg(F.count(F.lit(1)).alias("k"))  # outer: else the digests are made twice
    counts = stash(counts.where(F.col("k") > ratio * least_pages), "line-counts")  # any host that is cleaned has that many pages
    sizes = counts.groupBy("host").agg(F.count(F.lit(1)).alias("_lines"))
    often = attach(counts, hosts.join(sizes, "host"), ["host"], "_lines", counts.count()).where((F.col("pages") >= least_pages) & (F.col("k") > ratio * F.col("pages")))
    sites = stash(often.groupBy("host").agg(F.collect_list("d").alias("drop"), F.max("pages").alias("pages")), "line-sites")
    out = attach(rows, sites, ["host"], "pages", rows.count(), "left")
    bad = F.filter("lines", lambda x: F.array_contains(F.coalesce("drop", F.array().cast("array<binary>")), _digest(x)))
    good = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("drop", F.array().cast("array<binary>")), _digest(x)))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size(bad).cast("long").alias("n_dropped"), F.array_join(good, "\n").alias("clean_text"))
