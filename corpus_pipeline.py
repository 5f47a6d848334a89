"""Corpus preparation: STAGES applied in order to documents.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one
packed pieces. Stages that change a text also bring n_chars up to date. Other columns travel
in one struct, so their names can't clash with those of an operator; they may have any type.

Null and empty texts fail the base rules, so they go in the first stage; empty tables stay empty. Rows that agree in all columns are one
document from exact dedup on; rows of one doc_id with different texts are documents of their own there, and one document in near-dedup.
Rows without doc_id are compared in exact dedup and stay apart in near-dedup. Ties go to the longest text, then the smallest doc_id. Very long texts
are handled in stretches by the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import stash, table
from inkmill.llm.exact_dedup import exact_dedup
from inkmill.llm.near_dedup import near_dups
from inkmill.llm.packing import pack
from inkmill.llm.quality_rules import quality_rules
from inkmill.llm.suffix_dedup import remove_repeats


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def _with_text(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs, with the text of the column text."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _only(docs: DataFrame, verdicts: DataFrame, **keys: Column) -> DataFrame:
    """Rows of docs whose doc_id (and values of keys, columns of verdicts) are kept; of rows that agree in all columns, one."""
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        docs = docs.withColumn("_all", F.sha2(F.to_json(F.struct(*docs.columns)), 256)).dropDuplicates(["_all"]).drop("_all")
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_id"), *[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.equal_null("doc_id", "_id")
    for k, value in keys.items():
        same &= value == F.col(f"_{k}")
    return docs.join(kept, same, "left_semi")


def rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and rejected documents."""
    found = quality_rules(_carried(docs), with_text=True, carry=("_row",)).where("kept")
    return _with_text(found, docs, "clean_text")


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, exact_dedup(docs), n_points=F.length(F.coalesce("text", F.lit(""))))


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, near_dups(docs))


def repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand anywhere else go; a document may end up empty."""
    return _with_text(remove_repeats(_carried(docs), with_text=True, carry=("_row",)), docs, "kept_text")


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", rules),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packing),
]

#: DuckDB has neither the near-dedup nor the tokenizer; tests/llm/test_pipeline.py holds every stage and the result against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
