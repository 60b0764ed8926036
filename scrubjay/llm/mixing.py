"""Mixing sources to target weights by weighted fair queueing (operator 4, DataFrame functions only).

Every source queues its documents in a shuffled order, and queues them again
for each further pass. A queued document's virtual finish time is the words
its source has queued up to its end, divided by the source's weight; the mix
is all queues range-sorted by that time and truncated at the total budget. A
source that has queued all its passes leaves the rest of the budget to the
others by weight, so the cut falls at the virtual time T with
``sum(min(passes * size, weight * T)) = budget``, which the one-row-per-source
totals give; the document being served at T is cut there.

Running totals need no single-task window: a source's shuffled order is cut
into bins of about ``BIN_ROWS`` documents, windows run inside bins, and a
window over one row per bin gives the bins' bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents per bin of a source's shuffled order.
BIN_ROWS = 2_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _sources(queued: DataFrame, cycle: tuple[int, ...], passes: int) -> DataFrame:
    """One row per source: (source, rank, weight, source_size, source_rows, target)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = queued.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    one = one.withColumn("rank", F.row_number().over(by_name).cast("long"))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1)
                                                .cast("int")).cast("long"))
    # sources leave the queue in the order of the virtual time at which their passes end
    one = one.withColumn("cap", passes * F.col("source_size")).withColumn("ends", F.col("cap") / F.col("weight"))
    leaving = Window.orderBy("ends", "rank")
    gone = F.coalesce(F.sum("cap").over(leaving.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(leaving.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy())
    one = one.withColumn("level", (budget - gone) / left)
    cut = F.min(F.when(F.col("level") <= F.col("ends"), F.struct("ends", "rank", "level"))).over(Window.partitionBy())["level"]
    return one.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * cut)).drop("cap", "ends", "level")


def schedule(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), passes: int = 3, seed: int = 0,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, queue).

    ``queue`` is an array of (pass, virtual_finish, words): the passes in which
    the mix takes words of the document, ``words`` below ``size`` only where
    the budget ends inside it. Sources in code point order (null last, a source
    of its own) weigh ``cycle`` over and over.

    Null and empty texts have size 0 and an empty queue. Repeated rows and null
    ids queue like others (equal rows are interchangeable); an empty table
    gives an empty schedule; other columns are ignored, but the row key
    ``__row`` of ``common.row_key`` is carried along if it is there.
    """
    row = ["__row"] if "__row" in docs.columns else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.md5(text)), F.lit(str(seed))))  # no id: by text
    queued = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                 words(F.col(text_col)).alias("size"), F.substring(key, 1, 16).alias("key"), *row), "queue")
    sources = written(_sources(queued, cycle, passes), "sources")
    d = queued.withColumnRenamed("source", "__source").join(sources, F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
    bins = F.ceil(F.col("source_rows") / BIN_ROWS)
    d = d.withColumn("bin", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins / F.lit(1 << 32)))
    base = d.groupBy("rank", "bin").agg(F.sum("size").alias("bin_size"))
    base = base.select("rank", "bin", (F.sum("bin_size").over(Window.partitionBy("rank").orderBy("bin")) - F.col("bin_size")).alias("base"))
    inside = Window.partitionBy("rank", "bin").orderBy("key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(inside)).join(base, ["rank", "bin"]).withColumn("end", F.col("end") + F.col("base"))
    quota = F.floor(F.col("target") + 0.5)

    def served(p: Column) -> Column:
        before = p * F.col("source_size") + F.col("end") - F.col("size")
        return F.struct(p.alias("pass"), ((before + F.col("size")) / F.col("weight")).alias("virtual_finish"),
                        F.greatest(F.lit(0), F.least(F.col("size"), quota - before)).cast("long").alias("words"))

    queue = F.array(*(served(F.lit(p).cast("long")) for p in range(passes)))
    return d.select(*row, "doc_id", "source", "size", "source_size", "target",
                    F.filter(queue, lambda q: q["words"] > 0).alias("queue"))


def taken(scheduled: DataFrame) -> Column:
    return F.aggregate(F.col("queue"), F.lit(0).cast("long"), lambda n, q: n + q["words"])


def copies(docs: DataFrame, scheduled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix as whole documents: each row as often as passes serve at least half of it, in mixed order.

    ``docs`` has the row keys ``__row`` of ``common.row_key``, ``scheduled``
    is its schedule: every row has the passes of its own queue, whatever ids
    are null or repeated. Rows are range-sorted by virtual finish time and go
    without their key; documents without words, which weigh nothing in any
    mix, stay once.
    """
    half = F.filter(F.col("queue"), lambda q: 2 * q["words"] >= F.col("size"))
    times = scheduled.select(F.col("__row").alias("__of"), F.when(F.col("size") == 0, F.array(F.lit(0.0)))
                             .otherwise(F.transform(half, lambda q: q["virtual_finish"])).alias("__times"))
    mixed = docs.join(times, F.col("__row") == F.col("__of")).withColumn("__time", F.explode("__times"))
    return mixed.orderBy("__time", id_col, "__row").select(*[F.col(f"`{c}`") for c in docs.columns if c != "__row"])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':0'), 1, 16) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((rank - 1) % 3 + 1) AS ends FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ends, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ends, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE level <= ends ORDER BY ends, rank LIMIT 1)) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
         (sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start))
        + greatest(0, least(size, quota - 2 * source_size - start)))::BIGINT AS taken FROM q
"""
