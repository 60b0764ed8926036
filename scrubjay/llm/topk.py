"""Exact top-k by inner product with multi-resolution segment statistics (operator 5).

For vectors cut into segments, means and deviations bound a distance from
below: ``|q - v|^2 >= sum(m * (mean_q - mean_v)^2 + (dev_q - dev_v)^2)``, dev
being the root of the summed squared deviations. With ``q.v = (|q|^2 + |v|^2 -
|q - v|^2) / 2`` this bounds an inner product from above. Bounds go coarse to
fine; a pair survives while its bound reaches the score of the query's k-th
best candidate met so far; survivors get their exact product.

Queries (a stated set) and candidates are packed into blocks of fixed size and
met block by block; every pair of blocks gives at most k rows a query, and a
ranked window (its limit applied before the shuffle) merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import written

#: Vectors in a block of queries and in a block of candidates.
QUERY_BLOCK, BLOCK = 512, 8192
#: Segments a vector is cut into, coarse to fine.
SEGMENTS = (4, 16)


def valid(vec: Column) -> Column:
    """Not null, and no component null or not finite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & F.coalesce(F.forall(vec, ok), F.lit(False))


def _pack(rows: DataFrame, size: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """((dim, block, ids, values): vectors of one dimension in blocks of about ``size``, dealt by hash
    of id and vector, so that rows of one id are spread and equal rows meet in one block;
    (dim, blocks): the number of blocks of each dimension)."""
    per = written(rows.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("blocks")), "dims")
    dealt = rows.join(per, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), "blocks"))

    def pack(t: pa.Table) -> pa.Table:
        ids = t["id"].combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        return pa.table({"dim": t["dim"][:1], "block": t["block"][:1], "ids": [ids[order].tobytes()],
                         "values": [flat[order].astype("<i8").tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary())]))

    packed = dealt.select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(
        pack, "dim int, block long, ids binary, values binary")
    return written(packed, kind), per


def _tiles(queries: tuple[DataFrame, DataFrame], candidates: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(dim, q_block, q_ids, q, ids, values): every block of queries beside every block of candidates.

    Each side is copied once for every block of the other under the tile's
    number, so that a tile is a join key of its own and a task's work of its own."""
    (q, q_per), (c, c_per) = queries, candidates
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = q.join(c_per, "dim").select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("values").alias("q"),
                                       every("blocks").alias("block"))
    right = c.join(q_per, "dim").select("dim", "block", "ids", "values", every("blocks").alias("q_block"))
    return left.join(right, ["dim", "q_block", "block"]).select("dim", "q_block", "q_ids", "q", "ids", "values")


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``x``: weighted means, then deviations, of each segment."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(1)
        out += [np.sqrt(part.shape[1]) * mean, np.sqrt(np.maximum(0, ((part - mean[:, None]) ** 2).sum(1)))]
    return np.stack(out, 1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= floor)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """(place of the query, query, id, score) of the k best candidates of every query, its own row left out.

    Its own row is one candidate of its id and vector; of equal rows it does not matter which, as their results are the same."""
    exact = np.float64 if max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) * q.shape[1] < 2 ** 52 else np.int64
    qx, vx = q.astype(exact), v.astype(exact)
    levels = [(_statistics(q.astype(float), s), _statistics(v.astype(float), s)) for s in SEGMENTS if s < q.shape[1]]
    norm_q, norm_v = (q.astype(float) ** 2).sum(1), (v.astype(float) ** 2).sum(1)
    # rounding of the bounds stays far below this
    slack = 1e-9 * (1 + np.sqrt(norm_q.max(initial=0) * norm_v.max(initial=0)))
    if levels:
        a, b = levels[0]
        # |q - v|^2 >= |stat_q - stat_v|^2, and |stat|^2 = |vector|^2: the bound on q.v is stat_q.stat_v
        coarse = a @ b.T
    else:
        coarse = q.astype(float) @ v.astype(float).T
    for i in range(len(q)):
        bound = coarse[i]
        same = np.flatnonzero(ids == q_ids[i])
        bound[same[(v[same] == q[i]).all(1)][:1]] = -np.inf
        at = np.argpartition(bound, max(0, len(bound) - 2 * k))[-2 * k:]
        at = at[np.isfinite(bound[at])]
        first = vx[at] @ qx[i]
        floor = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
        at = np.flatnonzero((bound >= floor - slack) & np.isfinite(bound))
        for a, b in levels[1:]:
            if len(at) > k:
                at = at[b[at] @ a[i] >= floor - slack]
        score = (vx[at] @ qx[i]).astype(np.int64)
        top = _best(score, ids[at], k)
        yield np.full(len(top), i), np.full(len(top), q_ids[i]), ids[at[top]], score[top]


def _meet(k: int):
    def run(batches):
        for batch in batches:
            for dim, q_block, q_ids, q, ids, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                got = list(search_block(q_ids, np.frombuffer(q, "<i8").reshape(-1, dim), ids, np.frombuffer(v, "<i8").reshape(-1, dim), k))
                found = [np.concatenate(x) for x in zip(*got, strict=True)]
                yield pa.record_batch([pa.array(np.full(len(found[0]), x)) for x in (dim, q_block)] + [pa.array(x) for x in found],
                                      names=["dim", "q_block", "place", "query_id", "vec_id", "score"])
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows by inner product of ``floor(scale * x)``.

    ``is_query`` tells the queries by the column ``id``; candidates are all
    rows but the query's own, those that share its id included. Vectors that
    are null, empty or hold null or non-finite components, and rows without
    id, take no part; vectors of another dimension than the query's are no
    candidates. Every query row has ranks of its own, so an id on two rows
    gives two lists under one ``query_id``. Products are 64-bit integers. An empty table gives an empty result; other columns are ignored.
    """
    vec = F.col(vec_col).cast("array<double>")
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("x")).where(valid(F.col("x")) & (F.size("x") > 0) & F.col("id").isNotNull())
    rows = ok.select("id", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(scale * x)).alias("v"))
    met = _tiles(_pack(rows.where(is_query), QUERY_BLOCK, "queries"), _pack(rows, BLOCK, "candidates"))
    best = Window.partitionBy("dim", "q_block", "place").orderBy(F.desc("score"), "vec_id")
    return (met.mapInArrow(_meet(k), "dim long, q_block long, place long, query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS place, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.place <> q.place AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
