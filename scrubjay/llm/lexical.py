"""Ranked lexical search by pipelined term partitioning (operator 11).

Documents are indexed in blocks where they lie: one posting row per block and
term with the places, occurrences and document lengths. Every term has one
owner stage by its document frequency, the rarest terms first. An item's bundle
in a block is the sparse list of the documents met so far with their scores.
Bundles run through the stages: each stage is a cogroup, by block, of the
bundles with the postings of the terms it owns, which adds their integer
contributions to the accumulators.

Contributions are never negative, so between stages the 50th best partial score
of an item is a floor for its results. An accumulator that cannot reach the
floor with all that later terms can still add goes, and no new ones begin once
those terms alone cannot reach it. Ties at the floor stay, so the result is
that of adding everything.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm import textnum
from scrubjay.llm.common import numbered, written

K = 50
#: Owner stages; a stage owns the terms whose share of the documents is at most the bound (the last owns the rest).
BOUNDS = (1 / 256, 1 / 16)
#: Terms of items that are looked for in one pass over the documents; more items are searched in lots.
LOT_TERMS = 400_000
#: Documents and bytes of a block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
# The bytes that terms do not hold, as blanks, and A to Z lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term), written: each item row has a number of its own; its terms once each."""
    rows = numbered(items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "items")

    def run(batches):
        for batch in batches:
            out = [(i, k, t.decode()) for i, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                         batch.column(2).cast(pa.binary()).to_pylist(), strict=True)
                   for t in dict.fromkeys(terms(x or b""))]
            if out:
                item, item_id, term = zip(*out, strict=True)
                yield pa.record_batch([pa.array(item, pa.int64()), pa.array(item_id, batch.column(1).type), pa.array(term, pa.string())],
                                      names=["item", "item_id", "term"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return written(rows.select("__row", "item_id", "text").mapInArrow(run, f"item long, item_id {kind}, term string"), "item-terms")


INDEX = "block long, term int, docs array<int>, tf array<int>, n array<int>, doc_id array<long>"


def index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """The written index of whole texts: per block a row with term -1 (ids and lengths of all its documents, by id,
    null ids last) and a row per term of ``vocabulary`` met there."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def lists(values, kind):
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])), pa.int32()),
                                        pa.array(np.concatenate(values) if values else [], kind))

    def run(batches):
        known = sent.value
        for batch in batches:
            for whole in textnum.blocks(batch, 2, BLOCK_BYTES):
                for a in range(0, whole.num_rows, BLOCK_DOCS):
                    part = whole.slice(a, BLOCK_DOCS).sort_by([("id", "ascending")]) if whole.num_rows else whole
                    number: dict[int, list] = {}
                    length = []
                    for d, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                        words = terms(text or b"")
                        length.append(len(words))
                        for t, tf in Counter(filter(None.__ne__, map(known.get, words))).items():
                            number.setdefault(t, []).append((d, tf))
                    length = np.array(length, np.int32)
                    each = [np.array(v, np.int32).T for v in number.values()]
                    none = np.empty(0, np.int32)
                    ids = part.column(1).to_pylist()
                    yield pa.record_batch([
                        pa.array(np.full(len(each) + 1, part.column(0)[0].as_py())), pa.array([-1, *number], pa.int32()),
                        lists([none, *(e[0] for e in each)], pa.int32()), lists([none, *(e[1] for e in each)], pa.int32()),
                        lists([length, *(length[e[0]] for e in each)], pa.int32()),
                        pa.array([ids, *([None] * len(each))], pa.list_(pa.int64()))], names=["block", "term", "docs", "tf", "n", "doc_id"])

    return written(docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(run, INDEX), "index")


def weight(df, n):
    """floor(1000 * ln((2 * n + 2) / (2 * df + 1)))."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def contribution(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Of a term of weight 1, in 64-bit integers."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))


class Lot:
    """Items searched together: for each stage the terms of each item with their weights, and what later stages can add."""

    def __init__(self, item: np.ndarray, term: np.ndarray, stage: np.ndarray, w: np.ndarray, most: np.ndarray, stages: int):
        self.terms: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(stages)]
        self.later = {int(i): [0] * (stages + 1) for i in np.unique(item)}
        for i, t, s, x, m in zip(item.tolist(), term.tolist(), stage.tolist(), w.tolist(), most.tolist(), strict=True):
            self.terms[s].setdefault(i, []).append((t, x))
            self.later[i][s] += x * m
        for bound in self.later.values():  # from a stage on
            for s in range(stages - 1, -1, -1):
                bound[s] += bound[s + 1]


BUNDLE = "block long, item long, docs array<int>, score array<long>"


def _run_stage(lot, floors, stage: int, docs: int, total: int, k: int | None):
    """A stage as a cogroup of bundles and postings; ``k``: keep the best so many (the last stage)."""
    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        each, low = lot.value, floors.value
        held = {i: (np.array(d), np.array(s)) for i, d, s in zip(
            *(bundles[c].to_pylist() for c in ("item", "docs", "score")), strict=True)}
        found, size = {}, 0
        for t, d, tf, n in zip(postings["term"].to_pylist(), *(postings[c] for c in ("docs", "tf", "n")), strict=True):
            place = d.values.to_numpy()
            found[t] = (place, contribution(tf.values.to_numpy(), n.values.to_numpy(), docs, total))
            size = max(size, int(place.max()) + 1)
        size = max([size, *(int(d.max()) + 1 for d, _ in held.values() if len(d))])
        block = (postings if postings.num_rows else bundles)["block"][0].as_py()
        out = []
        for item in held.keys() | each.terms[stage].keys():
            score = np.zeros(size, np.int64)
            old = held.get(item)
            if old is not None:
                score[old[0]] = old[1]
            for t, w in each.terms[stage].get(item, ()):
                if t in found:
                    place, c = found[t]
                    score[place] += w * c
            floor = low.get(item, 1)
            if each.later[item][stage] < floor:  # only documents met before can still reach the floor
                kept = old[0] if old is not None else np.empty(0, np.int64)
            else:
                kept = np.flatnonzero(score)
            kept = kept[score[kept] + each.later[item][stage + 1] >= floor]
            if k is not None and len(kept) > k:
                least = np.partition(score[kept], len(kept) - k)[len(kept) - k]
                kept = kept[score[kept] >= least]
                kept = np.sort(kept[np.lexsort((kept, -score[kept]))[:k]])
            if len(kept):
                out.append((item, kept, score[kept]))
        cut = pa.array(np.append(0, np.cumsum([len(d) for _, d, _ in out])), pa.int32())
        flat = lambda n, kind: pa.ListArray.from_arrays(cut, pa.array(np.concatenate([o[n] for o in out]) if out else [], kind))
        return pa.table([pa.array([block] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()),
                         flat(1, pa.int32()), flat(2, pa.int64())], names=["block", "item", "docs", "score"])
    return run


def _floors(bundles: DataFrame, k: int) -> dict[int, int]:
    """For each item with ``k`` documents or more the k-th best partial score: one row per item of the lot."""
    best = bundles.select("item", F.explode(F.slice(F.sort_array("score", asc=False), 1, k)).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc())))
    return {r["item"]: r["score"] for r in ranked.where(F.col("rank") <= k).where(F.col("rank") == k).select("item", "score").collect()}


def _search_lot(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    pairs = wanted.select("item", "term").toPandas()  # bounded by LOT_TERMS
    vocabulary = sorted(set(pairs.term))
    number = {t: n for n, t in enumerate(vocabulary)}
    made = index(docs, [t.encode() for t in vocabulary])
    blocks, postings = made.where("term < 0"), made.where("term >= 0").drop("doc_id")
    size = blocks.select(F.explode("n").alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    n_docs, total = size["docs"], size["total"] or 1
    # the most a term adds is that of its largest tf with the shortest document it is in; one row per term
    stats = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("tf")).alias("tf"), F.min(F.array_min("n")).alias("n"))
    stats = stats.withColumn("w", weight(F.col("df"), F.lit(n_docs))).toPandas().set_index("term")
    most = contribution(stats.tf.to_numpy(), stats.n.to_numpy(), n_docs, total) if len(stats) else np.empty(0, np.int64)
    stage = np.searchsorted(np.array(BOUNDS) * n_docs, stats.df.to_numpy())
    place = {t: i for i, t in enumerate(stats.index)}
    met = [(i, number[t]) for i, t in pairs.itertuples(index=False) if number[t] in place]
    item, term = np.array(met, np.int64).reshape(-1, 2).T
    at = np.array([place[t] for t in term.tolist()], np.int64)
    stages = len(BOUNDS) + 1
    lot = spark.sparkContext.broadcast(Lot(item, term, stage[at], stats.w.to_numpy()[at], most[at], stages))
    owner = spark.createDataFrame([(int(t), int(s)) for t, s in zip(stats.index, stage, strict=True)], "term int, stage int")
    postings = postings.join(F.broadcast(owner), "term")
    bundles = spark.createDataFrame([], BUNDLE)
    for s in range(stages):
        floors = spark.sparkContext.broadcast(_floors(bundles, k) if s else {})
        step = _run_stage(lot, floors, s, n_docs, total, k if s == stages - 1 else None)
        owned = postings.where(F.col("stage") == s).select("block", "term", "docs", "tf", "n")
        bundles = written(bundles.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(step, BUNDLE), "bundles")
    best = bundles.select("block", "item", F.explode(F.arrays_zip("docs", "score")).alias("z")).select(
        "block", "item", F.col("z.docs").alias("doc"), F.col("z.score").alias("score")).where("score > 0")
    ids = blocks.select("block", F.posexplode("doc_id").alias("doc", "doc_id"))
    named = best.join(ids, ["block", "doc"])
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "doc")
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = wanted.groupBy("item").agg(F.first("item_id").alias("item_id"))
    return named.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", lot_terms: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every item row.

    Terms are runs of digits, letters and non-ASCII characters, A to Z lowered;
    null and empty texts have none: such items give no rows, such documents
    count nowhere. Equal scores rank by ascending id, null ids last. Repeated
    document rows are documents of their own, repeated item rows are answered
    each for itself. Empty tables give an empty result; other columns are
    ignored. Items beyond ``lot_terms`` terms in all are searched in lots, one
    pass over the documents each.
    """
    wanted = item_terms(items, item_id_col, item_text_col)
    lots = max(1, math.ceil(wanted.count() / (lot_terms or LOT_TERMS)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = [_search_lot(rows, wanted.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == lot), k) for lot in range(lots)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, c GROUP BY term, docs),
i AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
s AS (
  SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
