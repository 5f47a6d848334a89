"""First free names (B10, G4): of equal names in order the first stays, later ones get -2, -3, ... where that is free."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import kept


def first_free(names: list[str], fold: bool = False) -> list[str]:
    used: set[str] = set()
    counters: dict[str, int] = {}
    out = []
    for name in names:
        free = name
        low = name.lower() if fold else name
        n = counters.get(low, 2)
        while (free.lower() if fold else free) in used:
            free, n = f"{name}-{n}", n + 1
        counters[low] = n
        used.add(free.lower() if fold else free)
        out.append(free)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def free_slugs(wanted: pd.Series) -> pd.Series:
    """The free names of the ordered list of one document."""
    return wanted.map(lambda names: None if names is None else first_free(list(names)))


def free_names(rows: DataFrame, within: list[str], order: list[Column], name: str, fold: bool = True) -> DataFrame:
    """rows with name made free among the rows that agree in within, in the given order.

    Names can only meet if they agree but for numbers at their ends, so folders aren't gathered: a name that isn't repeated among such
    relatives stays, a name repeated among relatives that are all equal is numbered by its rank, and only relatives that are partly
    equal (page, page, page-2) go through Python, as one group.
    """
    same = F.lower(name) if fold else F.col(name)
    root = F.regexp_replace(same, "(-[0-9]+)+$", "")
    keyed = rows.withColumns({"_same": same, "_root": root})
    relatives = Window.partitionBy(*within, "_root")
    equal = Window.partitionBy(*within, "_root", "_same")
    keyed = keyed.withColumn("_n", F.count(F.lit(1)).over(equal)).withColumn("_nth", F.row_number().over(equal.orderBy(*order)))
    mixed = (F.max("_n").over(relatives) > 1) & (F.min("_same").over(relatives) != F.max("_same").over(relatives))
    keyed = kept(keyed.withColumn("_mixed", mixed), "names")
    numbered = F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), "_nth"))
    extra = ["_same", "_root", "_n", "_nth", "_mixed"]
    out = keyed.where("not _mixed").withColumn(name, numbered).drop(*extra)
    clash = keyed.where("_mixed")
    if clash.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy(*within, "_root").orderBy(*order))
    clash = clash.withColumn("_nth", place)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_nth", kind="stable")
        return group.assign(**{name: first_free(group[name].tolist(), fold)})

    return out.unionByName(clash.groupBy(*within, "_root").applyInPandas(settle, clash.schema).drop(*extra))
