"""Shared pieces of the training-data operators: tables, written intermediates,
skew-safe joins, connected components and bounded membership bitmaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kept import kept as stash

#: White space of the byte-level contracts: space and tab to carriage return.
WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a function gets at once: a few MB of texts, so its copies of them stay small.
SLICE = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def python_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a generator function of one batch. A session that makes larger batches is set to SLICE rows, as the JVM and Python hold
    whole batches besides."""
    if int(df.sparkSession.conf.get(_BATCH)) > SLICE:
        df.sparkSession.conf.set(_BATCH, SLICE)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                yield from fn(batch.slice(lo, SLICE))

    return df.mapInArrow(run, schema)


#: At least so many equal shares of the rows of a keyed join; a key with more than one share is dealt to several tasks.
SHARES = 200


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with one row per group, where a group may hold a third of
    all rows. A share is total / max(SHARES, shuffle partitions) rows. A key with size over one share gets as many salts as
    it has shares: its rows are dealt over them by a hash of their other columns, its group row is repeated for each.
    Only (hash of the key, salts) of such keys is broadcast, as one map of a subquery: 16 bytes each, fewer than there are shares; group rows
    may be wide, as they only go through the shuffle."""
    shares = max(SHARES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed, rest = F.xxhash64(*keys), [c for c in rows.columns if c not in keys]
    hot = groups.where(F.col(size) * shares > total).groupBy(hashed.alias("_hot")).agg(F.ceil(F.sum(size) * shares / F.lit(total or 1)).cast("int").alias("_salts"))
    hot = hot.agg(F.map_from_entries(F.collect_list(F.struct("_hot", "_salts")))).scalar()
    salts = F.coalesce(F.try_element_at(hot, hashed), F.lit(1))
    salt = F.when(salts > 1, F.pmod(F.xxhash64(*rest), salts)).otherwise(0).cast("int") if rest else F.lit(0)
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


# --- bounded membership bitmap -------------------------------------------------

BITS = 24


def bitmap(df: DataFrame, hashed: str) -> np.ndarray:
    """A bitmap of 2**BITS bits (2 MB, whatever the input) of hashed, a long column of
    uniform hashes. Absence is certain, presence is not: it only saves shuffling rows that
    a join would drop anyway, and when it fills up nothing but that saving is lost."""
    bit = F.expr(f"{hashed} & {(1 << BITS) - 1}L")
    words = df.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({hashed} & 63L as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def in_bitmap(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    bit = hashed & ((1 << BITS) - 1)
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


# --- connected components ------------------------------------------------------


def _renamed(rows: DataFrame, key: str, names: DataFrame, out: str) -> DataFrame:
    """rows with out, what names (node, up) has for key (null where it has nothing). A node may stand in any share of the rows."""
    sizes = rows.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("_size"))
    groups = names.join(sizes, "node").select(F.col("node").alias(key), F.col("up").alias(out), "_size")
    return attach(rows, groups, [key], "_size", rows.count(), "left").drop("_size")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of an undirected graph whose ids (columns a, b) have an order.

    Returns one row (node, root) per node that has an edge to another node; root is the smallest
    node of its component. Each round hooks every root to its smallest neighbour,
    collapses the hooking forest by pointer jumping, and contracts the edges, so
    the number of live roots at least halves. All steps are aggregations with map-side combine and salted joins, so a
    hub is no single task; only counts reach the driver. Null ends and loops are no edges.
    """
    live = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    names = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        hook = stash(hook, f"{label}-hook")
        while True:
            jump = _renamed(hook, "up", hook.where("node <> up"), "next").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
            jump = stash(jump, f"{label}-jump")
            moved = not jump.where("moved").isEmpty()
            hook = jump.select("node", "up")
            if not moved:
                break
        if names is None:
            names = hook
        else:
            names = stash(_renamed(names, "up", hook, "next").select("node", F.coalesce("next", "up").alias("up")), f"{label}-names")
        ends = _renamed(_renamed(live, "a", hook, "ra"), "b", hook, "rb")
        live = stash(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{label}-edges")
    if names is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names.select("node", F.col("up").alias("root"))
