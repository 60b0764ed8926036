"""Shared pieces of the corpus operators: inputs, written tables, label splits, components."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.session import staged
from scrubjay.sources.rowid import has_metadata


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table written once to shared storage and read back; a lost executor only costs a re-read."""
    return staged(df, f"llm-{tag}")


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once with a number for every row, ``__row``: unique, in no stated order, and the same in every later read."""
    return written(df.withColumn("__row", F.monotonically_increasing_id()), tag)


def row_key(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with a key for every row, ``__row``, the same in every later read.

    A row of a Parquet read is known by its file and its index there, so nothing
    is written; other frames are numbered and written once."""
    if not has_metadata(df, "row_index"):
        return numbered(df, tag)
    return df.withColumn("__row", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def in_share(key: Column, wanted: int, total: Column | int) -> Column:
    """Holds for about four times ``wanted`` of ``total`` rows, chosen by an md5 text: what a top-``wanted``
    by that text then sorts does not grow with the number of tasks."""
    total = F.greatest(F.lit(16), total if isinstance(total, Column) else F.lit(total)).cast("double")
    share = F.least(F.lit(1.0), (4 * wanted + 16) / total)
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") < F.ceil(share * float(1 << 32))


def has_rows(df: DataFrame) -> bool:
    return bool(df.select(F.lit(1)).take(1))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star / small-star rounds. Every round is a grouped
    minimum (map-side combined, so a hub's links collapse before the shuffle)
    and an equi-join of links with those minima; links never outnumber the
    input's. Each round is a written table, so a lost executor never replays
    earlier rounds, and only one count per round reaches the driver.
    """
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct(), tag)
    while True:
        # large star: every node links to the smallest neighbour of its smaller neighbours
        low = (links.select(F.col("b").alias("n"), F.col("b").alias("m"))
               .unionAll(links.select(F.col("a").alias("n"), F.col("b").alias("m"))).groupBy("n").agg(F.min("m").alias("m")))
        large = links.join(low, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct()
        large = written(large, tag)
        # small star: a node and its smaller neighbours all link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = (large.join(least.where("k > 1").select(F.col("a").alias("n"), "m"), F.col("a") == F.col("n"))
                 .where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        links = written(small, tag)
        # a forest of stars: every node has one parent and no parent has a parent
        parents = links.select(F.col("b").alias("a")).distinct()
        if not has_rows(links.join(parents, "a", "left_semi")) and not has_rows(
                links.groupBy("a").count().where("count > 1")):
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def runs(batches, column: int):
    """Tables of consecutive rows with one value in ``column`` of sorted Arrow batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in itertools.pairwise(cut):
            if held and value[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value[a]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return root
