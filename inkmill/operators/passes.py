"""Block passes (B1 to B12) as relational transforms of a block table keyed by doc_id.

All windows partition by doc_id, so one exchange serves the whole chain.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.text import desmarten, detect_callout, unwrap_code
from ..functions.vocab import DROP_SECTIONS, LABEL_HEADINGS
from .blocks import DOC

#: The deepest level that a reader gives: outline levels of Word go to 9 and are counted from 0.
LEVELS = 10


def _doc():
    return Window.partitionBy("doc_id")


def _upto(last: int = 0):
    """Rows of the document up to this one (or up to the one before it, with -1)."""
    return _doc().orderBy("pos").rowsBetween(Window.unboundedPreceding, last)


def _heading() -> Column:
    return F.col("kind") == "heading"


def mark_sections(blocks: DataFrame, sections: tuple[str, ...] = DROP_SECTIONS) -> DataFrame:
    """Adds _in, whether a row is in a named section (up to the next heading of its level or above), and _opens, whether it begins one.

    A block is in a dropped section if, for a level l, the last heading of level l or above (a smaller number) before or at it is
    a named one of level l: a running last value per level, instead of a range join. Readers give levels up to LEVELS.
    """
    named = _heading() & C.norm_key(C.clean_heading(F.col("text"))).isin(*sections) if sections else F.lit(False)
    rows = blocks.withColumn("_named", named)
    inside = opens = F.lit(False)
    for level in range(1, LEVELS + 1):
        own = (F.col("level") == level) & F.col("_named")
        opens = opens | own & ~inside
        mark = F.when(_heading() & (F.col("level") <= level), own)
        inside = inside | F.coalesce(F.last(mark, ignorenulls=True).over(_upto()), F.lit(False))
    return rows.withColumns({"_in": inside, "_opens": F.coalesce(opens, F.lit(False))}).drop("_named")


def drop_toc_and_sections(blocks: DataFrame, sections: tuple[str, ...] = DROP_SECTIONS) -> DataFrame:
    """B2: drops toc rows, and named sections with all they hold."""
    rows = blocks.where("kind <> 'toc'")
    return mark_sections(rows, sections).where("not _in").drop("_in", "_opens") if sections else rows


def mark_cover(blocks: DataFrame) -> DataFrame:
    """Adds _cover, whether a row stands before the first heading with a title."""
    first = F.min(F.when(_heading() & (C.clean_heading(F.col("text")) != ""), F.col("pos"))).over(_doc())
    return blocks.withColumn("_cover", F.coalesce((F.col("pos") < first) & (F.col("kind") != DOC), F.lit(False)))


def drop_cover(blocks: DataFrame) -> DataFrame:
    """Drops what comes before the first heading with a title."""
    return mark_cover(blocks).where("not _cover").drop("_cover")


_CODE = T.StructType([T.StructField("text", T.StringType()), T.StructField("fixed", T.IntegerType())])


@F.pandas_udf(_CODE)
def _clean_code(parts: pd.Series) -> pd.DataFrame:
    found = [(None, None) if text is None else desmarten(unwrap_code(text.split("\n"))) for text in parts]
    return pd.DataFrame(found, columns=["text", "fixed"], dtype=object)


def merge_code(blocks: DataFrame, fixes: bool = False) -> DataFrame:
    """A run of code and blanks from a code on becomes one code block; blanks at its end vanish. With fixes, _fixed has the
    typographic characters that were replaced in it."""
    soft = F.col("kind").isin("code", "blank")
    prev = F.lag("kind").over(_doc().orderBy("pos"))
    start = ~soft | F.coalesce(~prev.isin("code", "blank"), F.lit(True))
    rows = blocks.withColumn("_run", F.sum(start.cast("int")).over(_upto()))
    run = Window.partitionBy("doc_id", "_run")
    code_pos = F.when(F.col("kind") == "code", F.col("pos"))
    rows = rows.withColumn("_first", F.min(code_pos).over(run)).withColumn("_last", F.max(code_pos).over(run))
    part = F.when(F.col("kind").isin("code", "blank") & F.col("pos").between(F.col("_first"), F.col("_last")), F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))
    lines = F.array_sort(F.collect_list(part).over(run))  # a run is part of a document
    head = F.coalesce(F.col("pos") == F.col("_first"), F.lit(False))
    rows = rows.withColumn("_head", head).withColumn("_code", F.when(head, F.array_join(F.transform(lines, lambda x: x["text"]), "\n")))
    rows = rows.where(~F.col("kind").isin("code", "blank") | F.col("_head") | (F.col("kind") == "blank") & (F.col("_first").isNull() | (F.col("pos") < F.col("_first"))))
    rows = rows.withColumn("_clean", _clean_code("_code")).withColumn("text", F.coalesce("_clean.text", "text"))
    if fixes:
        rows = rows.withColumn("_fixed", F.col("_clean.fixed"))
    keep = ~F.col("_head")
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in ("lang", "images") if c in rows.columns}).drop("_run", "_first", "_last", "_head", "_code", "_clean")


_HIT = T.StructType([T.StructField("emoji", T.StringType()), T.StructField("rest", T.StringType())])


@F.pandas_udf(_HIT)
def callout_of(texts: pd.Series) -> pd.DataFrame:
    """As one expression it would nest some twenty patterns in each other, which the planner pays for."""
    return pd.DataFrame([(text and detect_callout(text)) or (None, None) for text in texts], columns=["emoji", "rest"], dtype=object)


def with_hits(blocks: DataFrame) -> DataFrame:
    """Adds _hit, what ``callout_of`` says of paragraphs. No pass before B5 changes them, so it is worked out before the rows are dealt: Python steps
    lose the dealing."""
    return blocks.withColumn("_hit", callout_of(F.when(F.col("kind") == "para", F.col("text"))))


def convert_callouts(blocks: DataFrame) -> DataFrame:
    """B5"""
    rows = blocks if "_hit" in blocks.columns else with_hits(blocks)
    yes = F.coalesce(F.col("_hit.rest") != "", F.lit(False))
    return rows.withColumns({
        "kind": F.when(yes, "callout").otherwise(F.col("kind")), "emoji": F.when(yes, F.col("_hit.emoji")).otherwise(F.col("emoji")),
        "text": F.when(yes, F.col("_hit.rest")).otherwise(F.col("text")), "images": F.when(~yes, F.col("images")),
    }).drop("_hit")


def demote_labels(blocks: DataFrame, labels: tuple[str, ...] = LABEL_HEADINGS, style: str = "bold") -> DataFrame:
    """Headings that are labels become paragraphs; titles are cleaned, headings without one go."""
    title = C.clean_heading(F.col("text"))
    rows = blocks.withColumn("_title", F.when(_heading(), title)).where(F.col("_title").isNull() | (F.col("_title") != ""))
    named = C.norm_key(F.col("_title")).isin(*labels) | C.label_stem(F.col("_title")).isin(*labels) if labels else F.lit(False)
    label = F.coalesce(named, F.lit(False))
    mark = "" if style == "plain" else "**"
    safe = F.concat(F.lit(mark), C.escape_heading(F.col("_title")), F.lit(mark))
    return rows.withColumns({
        "kind": F.when(label, "para").otherwise(F.col("kind")), "level": F.when(~label, F.col("level")),
        "text": F.when(label, safe).otherwise(F.coalesce("_title", "text")),
    }).drop("_title")


def remap_levels(blocks: DataFrame, top: int = 2, most: int = 3) -> DataFrame:
    """The levels a document uses (LEVELS at most) become consecutive from top on."""
    used = F.array_sort(F.collect_set(F.when(_heading(), F.col("level"))).over(_doc()))
    rank = F.array_position("_used", F.col("level")).cast("int")
    level = F.when(_heading(), F.least(F.lit(6), F.lit(most), F.lit(top - 1) + rank)).otherwise(F.col("level"))
    return blocks.withColumn("_used", used).withColumn("level", level).drop("_used")


def apply_passes(blocks: DataFrame, options) -> DataFrame:
    """B1"""
    out = drop_toc_and_sections(blocks if options.no_callouts else with_hits(blocks), options.drop_sections)
    if not options.keep_cover:
        out = drop_cover(out)
    out = merge_code(out)
    if not options.no_callouts:
        out = convert_callouts(out)
    return remap_levels(demote_labels(out, options.labels, options.label_style), options.top_level, options.max_level)


def split_sections(blocks: DataFrame, level: int) -> DataFrame:
    """Adds section and section_title; a heading of the level opens one and goes, empty untitled ones go. The row of kind DOC stays, in
    section 0."""
    opens = _heading() & (F.col("level") == level)
    rows = blocks.withColumn("section", F.sum(F.when(opens, 1).otherwise(0)).over(_upto())).withColumn("section_title", F.last(F.when(opens, F.col("text")), ignorenulls=True).over(_upto()))
    part, own = Window.partitionBy("doc_id", "section"), F.col("kind") != DOC
    full = F.max((own & ~opens & (F.col("kind") != "blank")).cast("int")).over(part) == 1
    rows = rows.withColumn("_full", full).withColumn("_opens", opens)
    # a titled section without blocks keeps its heading row as a blank, so that it stays a section
    rows = rows.withColumn("_alone", F.count(F.when(own, 1)).over(part) == 1)
    rows = rows.where(~own | (F.col("_full") | F.col("section_title").isNotNull()) & (~F.col("_opens") | F.col("_alone")))
    return rows.withColumn("kind", F.when(F.col("_opens"), "blank").otherwise(F.col("kind"))).drop("_full", "_opens", "_alone")


def split_several(blocks: DataFrame, level: int) -> DataFrame:
    """The same for documents of two sections or more; others stay whole, as section 0 without title."""
    opens = _heading() & (F.col("level") == level)
    own = F.col("kind") != DOC
    rows = blocks.withColumn("_open", F.coalesce(opens, F.lit(False)))
    rows = rows.withColumn("section", F.sum(F.col("_open").cast("int")).over(_upto()))
    title = F.last(F.when(F.col("_open"), F.col("text")), ignorenulls=True).over(_upto())
    # untitled blocks count as a section if one of them is more than a blank
    lead = F.max((own & (F.col("section") == 0) & (F.col("kind") != "blank")).cast("int")).over(_doc())
    rows = rows.withColumn("section_title", title).withColumn("_lead", F.coalesce(lead, F.lit(0)))
    rows = rows.withColumn("_several", F.sum(F.col("_open").cast("int")).over(_doc()) + F.col("_lead") > 1)
    gone = F.col("_several") & (F.col("section") == 0) & (F.col("_lead") == 0) & own
    rows = rows.where(~gone).withColumns({
        "kind": F.when(F.col("_several") & F.col("_open"), "blank").otherwise(F.col("kind")),
        "section_title": F.when(F.col("_several"), F.col("section_title")),
        "section": F.when(F.col("_several"), F.col("section")).otherwise(0),
    })
    return rows.drop("_open", "_lead", "_several")


def last_heading(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The title of the heading before each block, of its section or document."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("last_heading", F.last(F.when(_heading(), F.col("text")), ignorenulls=True).over(before))
