"""Sinks (K1, K2, K4): zips of output files, written by executors.

A zip is one row, so it and its files must fit the memory of a task (and two GB); by is to name shares of that size.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import free_names


def zip_bytes(files: list[tuple[str, bytes]]) -> bytes:
    """K1: stored entries with one constant date, so equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, data in files:
            z.writestr(zipfile.ZipInfo(path, date_time=(1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def zips(files: DataFrame, by: str = "archive") -> DataFrame:
    """(by, content): one zip for each value of by from rows (by, path, text or data). A zip is made in one task, so by names one archive's share."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("path", kind="stable")
        rows = [(p, t.encode() if isinstance(t, str) else bytes(d)) for p, t, d in zip(group["path"], group["text"], group["data"], strict=True)]
        return pd.DataFrame({by: [group[by].iloc[0]], "content": [zip_bytes(rows)]})

    return files.select(by, "path", "text", "data").groupBy(by).applyInPandas(one, f"{by} {files.schema[by].dataType.simpleString()}, content binary")


def published_paths(files: DataFrame) -> DataFrame:
    """K4: paths outside docs/ and reference/ go under docs/."""
    return files.withColumn("path", F.when(F.col("path").rlike("^(docs|reference)/"), F.col("path")).otherwise(F.concat(F.lit("docs/"), "path")))


def free_paths(files: DataFrame, by: str = "batch", order: str = "pos") -> DataFrame:
    """K2: paths that repeat within a batch get -2, -3, ... before their extension."""
    ext = F.regexp_extract("path", r"\.[^./]*$", 0)
    rows = files.withColumns({"_ext": ext, "_stem": F.col("path").substr(F.lit(1), F.length("path") - F.length(ext))})
    named = free_names(rows, [by, "_ext"], [F.col(order)], "_stem", fold=False)
    return named.withColumn("path", F.concat("_stem", "_ext")).select(*files.columns)
