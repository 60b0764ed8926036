"""Near-duplicate documents by a signature-coordinate inverted join (operator 9).

A document's set is its distinct five-word shingles. Documents with equal sets
become one class. Every class posts its ``COORDINATES`` MinHash values under
(coordinate, value); a posting met once cannot collide and goes. Two sets with
similarity 0.85 agree in fewer than ``MATCHES`` coordinates with a chance under
1e-6, so a class with fewer shared postings is done, and of the others'
postings, rarest first, only the prefix that any pair with ``MATCHES``
agreements must share is merged. Classes joined by prefix postings form
candidate groups; inside a group collisions are counted by comparing
signatures, pairs above the threshold are verified on the full sets in falling
order of matches, and pairs already joined are skipped.

A group beyond ``UNIT`` classes is dealt into blocks by set size and hash, and
pairs of blocks whose sizes allow a link are solved apart; each returns a forest
of its links, never all pairs, and a distributed component pass joins them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm import textnum
from scrubjay.llm.common import components, numbered, runs, written

WORDS = 5
COORDINATES, MATCHES = 64, 39
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Classes of a group that are solved together, and of a block beyond that.
UNIT, PART = 1024, 512
#: Candidate ids that are broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Set sizes of one band differ by less than any two linked sets may.
_BAND = math.log(100 / (PERCENT - 1))
_MULTIPLY = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(9).integers(1 << 20, 1 << 62, COORDINATES)]


def signatures(shingle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """MinHash signature of every set (none empty) laid end to end."""
    start = np.cumsum(size) - size
    out = np.empty((len(size), COORDINATES), np.uint32)
    for k, m in enumerate(_MULTIPLY):
        out[:, k] = np.minimum.reduceat(((shingle * m) >> np.uint64(32)).astype(np.uint32), start)
    return out


def _sets(column: pa.Array):
    """Per chunk [a, b) of documents: a, b and the list of their sorted distinct shingles."""
    data, offsets = textnum.text_buffers(column)
    for a, b in textnum.chunks(offsets):
        shingle, count = textnum.sequences(*textnum.words(data, offsets, a, b, textnum.PLAIN), WORDS)
        end = np.cumsum(count).tolist()
        yield a, b, [np.unique(shingle[x:y]) for x, y in zip([0, *end], end)]


def _key(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def _describe(batches):
    for batch in batches:
        for a, b, sets in _sets(batch.column(2)):
            size = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            sig = signatures(np.concatenate(some), size[size > 0]) if some else np.empty((0, COORDINATES), np.uint32)
            cut = np.append(0, np.cumsum(size > 0) * COORDINATES).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(cut), pa.array(sig.view(np.int32).ravel()))
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size),
                                   pa.array([_key(s) if len(s) else None for s in sets], pa.string()), listed],
                                  names=["row", "doc_id", "n_shingles", "key", "signature"])


def _whole_sets(batches):
    for batch in batches:
        for _, _, sets in _sets(batch.column(0)):
            some = [s for s in sets if len(s)]
            yield pa.record_batch([pa.array([_key(s) for s in some], pa.string()), pa.array([s.tobytes() for s in some], pa.binary())],
                                  names=["key", "shingles"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def solve(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """The smallest place each set is joined to; with ``split``, links run between places before and from it only."""
    n = len(sets)
    sig = signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    left, right = (sig, sig) if split is None else (sig[:split], sig[split:])
    shift = 0 if split is None else split
    match = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDINATES):
        match += left[:, k][:, None] == right[:, k][None, :]
    x, y = np.nonzero(match >= MATCHES)
    if split is None:
        x, y = x[x < y], y[x < y]
    size = np.array([len(s) for s in sets])
    low, high = np.minimum(size[x], size[y + shift]), np.maximum(size[x], size[y + shift])
    x, y = x[100 * low >= PERCENT * high], y[100 * low >= PERCENT * high]
    count = match[x, y]
    y = y + shift
    root = np.arange(n)
    for c in range(COORDINATES, MATCHES - 1, -1):
        at = np.flatnonzero(count == c)
        at = at[root[x[at]] != root[y[at]]]
        for i, j in zip(x[at].tolist(), y[at].tolist(), strict=True):
            a, b = root[i], root[j]
            if a != b:
                both = _common(sets[i], sets[j])
                if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                    root[root == max(a, b)] = min(a, b)
    return root


def _solve_units(batches):
    """unit, part (0 or 1; null: a whole group), key, shingles -> (key, root, whole)."""
    for t in runs(batches, 0):
        if t.num_rows < 2:
            continue
        t = t.sort_by([("part", "ascending"), ("key", "ascending")])
        part = t["part"].to_pylist()
        keys = t["key"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        root = solve(sets, None if part[0] is None or part[-1] == 0 else part.index(1))
        moved = np.flatnonzero(root != np.arange(len(root))).tolist()
        yield pa.record_batch([pa.array([keys[i] for i in moved], pa.string()), pa.array([keys[root[i]] for i in moved], pa.string()),
                               pa.array([part[0] is None] * len(moved), pa.bool_())], names=["key", "root", "whole"])


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(key, n_shingles, doc, grp): classes that may have a link, with the candidate group they are in."""
    posted = classes.select(F.xxhash64("key").alias("id"), F.posexplode("signature").alias("k", "v")).select(
        "id", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    shared = shared.where(F.size("t") >= MATCHES)
    # COORDINATES - MATCHES + 1 rarest, those that nobody shares counted first
    prefix = shared.select("id", F.explode(F.slice("t", 1, F.size("t") - MATCHES + 1)).alias("t")).select("id", "t.token")
    prefix = written(prefix, "prefix")
    first = prefix.groupBy("token").agg(F.min("id").alias("rep"))
    groups = components(prefix.join(first, "token").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "groups")
    return classes.withColumn("node", F.xxhash64("key")).join(groups.withColumnRenamed("root", "grp"), "node").select(
        "key", "n_shingles", "doc", "grp")


def units(grouped: DataFrame) -> DataFrame:
    """(unit, part, key): whole small groups, and pairs of blocks of large ones."""
    band = F.floor(F.log("n_shingles") / F.lit(_BAND)).cast("int")
    sizes = written(grouped.withColumn("band", band).groupBy("grp", "band").agg(F.count("*").alias("n")), "sizes")
    whole = sizes.groupBy("grp").agg(F.sum("n").alias("total"))
    rows = grouped.select("key", "grp", band.alias("band")).join(whole, "grp")
    small = rows.where(F.col("total") <= UNIT).select(F.xxhash64("grp").alias("unit"), F.lit(None).cast("int").alias("part"), "key")
    parts = sizes.join(whole.where(F.col("total") > UNIT), "grp").withColumn("parts", F.ceil(F.col("n") / PART))
    large = rows.where(F.col("total") > UNIT).drop("total").join(parts.select("grp", "band", "parts"), ["grp", "band"]).select(
        "key", "grp", "band", F.pmod(F.xxhash64("key"), "parts").alias("sub"))
    blocks = parts.select("grp", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sub"))
    other = blocks.select("grp", F.col("band").alias("band2"), F.col("sub").alias("sub2"))
    pairs = blocks.join(other.withColumn("band", F.col("band2")), ["grp", "band"]).where("sub <= sub2").unionByName(
        blocks.join(other.withColumn("band", F.col("band2") - 1), ["grp", "band"]))
    pairs = pairs.withColumn("unit", F.xxhash64("grp", "band", "sub", "band2", "sub2"))
    sides = pairs.select("unit", F.lit(0).alias("part"), "grp", "band", "sub").unionByName(
        pairs.where("band <> band2 OR sub <> sub2").select("unit", F.lit(1).alias("part"), "grp", F.col("band2").alias("band"), F.col("sub2").alias("sub")))
    return small.unionByName(large.join(sides, ["grp", "band", "sub"]).select("unit", "part", "key"))


def _solved(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``texts`` (row, doc_id, text): described rows (row, doc_id, n_shingles, key); their classes (key, doc, rows,
    first), ``first`` being (no id, id, row) of the row that comes first; (key, root) of the classes with links."""
    described = written(texts.mapInArrow(_describe, "row long, doc_id long, n_shingles long, key string, signature array<int>"), "described")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = written(described.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("rows"), F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")), "classes")
    grouped = written(candidate_groups(classes), "grouped")
    ids = grouped.select(F.col("doc").alias("rep")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    again = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = again.mapInArrow(_whole_sets, "key string, shingles binary").join(grouped.select("key"), "key", "left_semi").dropDuplicates(["key"])
    work = units(grouped).join(written(sets, "sets"), "key").select("unit", "part", "key", "shingles")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = written(work.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(
        _solve_units, "key string, root string, whole boolean"), "solved")
    joined = components(solved.where("NOT whole").select(F.col("key").alias("a"), F.col("root").alias("b")), "near").where("node <> root")
    roots = solved.where("whole").select("key", "root").unionByName(joined.select(F.col("node").alias("key"), "root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("key"), "root").distinct())
    return described, classes.select("key", "doc", "rows", "first"), roots


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Words lie between white space (0x20, 0x09 to 0x0D), A to Z lowered. Texts
    of fewer than five words are one shingle; null, empty and blank texts have
    none and link with nothing. Repeated rows link like copies; rows with a
    null id take part but name no component: alone they get a null one, and
    are never kept. An empty table gives an empty result; other columns are
    ignored.
    """
    described, least, roots = _solved(docs.select(F.lit(None).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                                                  F.col(text_col).cast("string").alias("text")))
    named = roots.join(least, "key").groupBy("root").agg(F.min("doc").alias("component"))
    classed = least.join(roots.join(named, "root").select("key", "component"), "key", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    # a class of one row without links is its own component: only the others are looked up, and a hot
    # class is split by the join, both sides being plain exchanges
    classed = written(classed.where("rows > 1 OR NOT component <=> doc").select("key", "component", F.lit(True).alias("linked")), "classed")
    out = described.select("doc_id", "n_shingles", "key").join(classed, "key", "left")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group: of the rows with the smallest id, any one.

    Groups are those of ``link``, but rows are told apart by a number of their
    own: of repeated rows one stays, rows that share an id and not a text go
    or stay each for itself, and a row with a null id stays only if its group
    has no row with an id, one of them. Rows without shingles stay.
    """
    rows = numbered(docs, "numbered")
    described, classes, roots = _solved(rows.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                                                    F.col(text_col).cast("string").alias("text")))
    least = classes.join(roots, "key", "left").groupBy(F.coalesce("root", "key")).agg(F.min("first")["row"].alias("row"))
    gone = described.where("key IS NOT NULL").select("row").join(least.select("row"), "row", "left_anti")
    return rows.join(written(gone, "gone").withColumnRenamed("row", "__gone"), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT r, len(g) AS n, unnest(g) AS g FROM s),
i AS (SELECT a.r AS a, b.r AS b, a.n AS m, b.n AS n, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (m + n - k)),
reach(r, m) AS (SELECT r, r FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.m),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.m GROUP BY reach.r)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.component_id, coalesce(s.doc_id = c.component_id, false) AS kept FROM s JOIN c USING (r)
"""
