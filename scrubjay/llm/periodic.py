"""Periodic runs of words by string synchronising sets (operator 12).

Texts are strings of words. At every dyadic scale t = 1, 2, 4, ... all stretches
of t words get a name (equal names, equal words: a name is the rank of the pair
of names of its halves, so no hash decides). A position is selected if, of the
hashed names of the t + 1 stretches that begin at it or up to t words later, the
least is the first or the last. Selection depends on the next 2t words alone, so
equal contexts are selected alike, and any t positions in a row hold a selected
one unless they lie in a highly periodic region.

A run whose smallest period q has t <= q < 2t and which is at least 4q long
therefore holds selected positions of equal context exactly q apart: neighbours
among the selected positions of one context propose their distance, and a
proposal is extended word by word to the maximal run. Stretches of period up to
t / 4 are left out at scale t; the runs found at smaller scales supply them.

Stretches that are not repeated within their document take no part at larger
scales, so plain prose is done after two or three scales. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textnum import mix

#: Words whose runs are searched together; a longer document is searched alone.
BLOCK_WORDS = 1 << 17
#: A run is at least this many words long and holds its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _names(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name for each tuple of values (equal names, equal tuples), and whether it occurs twice or more."""
    key = parts[0] if len(parts) == 1 else (parts[0].astype(np.int64) << 32) | parts[1]
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on (fewer at the end)."""
    out, have = value, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out, np.concatenate([out[step:], np.full(min(step, len(out)), _NEVER)]))
        have += step
    return out


def _extend(word: np.ndarray, a: int, b: int, q: int) -> tuple[int, int]:
    """The longest stretch [a, b) of places that equal the word ``q`` further on, around a known one."""
    step = 64
    while b + q < len(word):
        end = min(b + step, len(word) - q)
        differ = np.flatnonzero(word[b:end] != word[b + q:end + q])
        if len(differ):
            b += int(differ[0])
            break
        b, step = end, step * 2
    step = 64
    while a > 0:
        begin = max(0, a - step)
        differ = np.flatnonzero(word[begin:a] != word[begin + q:a + q])
        if len(differ):
            a = begin + int(differ[-1]) + 1
            break
        a, step = begin, step * 2
    return a, b


def find_runs(word: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, by start, then period.

    ``word`` numbers the words of documents laid end to end, no number in two
    documents; ``longest`` is the length of the longest document.
    """
    at = np.arange(len(word))
    name, twice = _names(word)
    at, name = at[twice], name[twice]
    runs: set[tuple[int, int, int]] = set()
    t = 1
    while len(at) and LEAST_TIMES * t <= longest:
        # names of twice the length, where the second half is repeated too
        second = np.searchsorted(at, at + t)
        whole = np.flatnonzero(at[np.minimum(second, len(at) - 1)] == at + t)
        context, twice = _names(name[whole], name[second[whole]]) if len(whole) else (whole, np.zeros(0, bool))
        whole, context = whole[twice], context[twice]
        value = mix(name.astype(np.uint64))
        for s, length, q in runs:  # highly periodic regions
            if LEAST_TIMES * q <= t and LEAST_WORDS <= t <= length:
                value[np.searchsorted(at, s):np.searchsorted(at, s + length - t, "right")] = _NEVER
        least = _least(value, t + 1)[whole]
        # repeated contexts begin t + 1 repeated stretches in a row, so place + t holds the last of them
        last = value[np.minimum(whole + t, len(value) - 1)]
        chosen = (least != _NEVER) & ((value[whole] == least) | (last == least))
        place, group = at[whole[chosen]], context[chosen]
        order = np.lexsort((place, group))
        place, group = place[order], group[order]
        q = place[1:] - place[:-1]
        near = (group[1:] == group[:-1]) & (q >= t) & (q < 2 * t)
        _proposed(word, place[:-1][near], q[near], 2 * t, runs)
        at, name, t = at[whole], context, 2 * t
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _proposed(word: np.ndarray, place: np.ndarray, q: np.ndarray, size: int, runs: set) -> None:
    """Add the runs around proposals: ``size`` words from each place equal those ``q`` further on."""
    order = np.lexsort((place, q))
    place, q = place[order].tolist(), q[order].tolist()
    period, end = 0, 0
    for a, d in zip(place, q, strict=True):
        if d == period and a < end:
            continue  # within the stretch just extended
        begin, end = _extend(word, a, a + size, d)
        period, length = d, end - begin + d
        if length >= max(LEAST_WORDS, LEAST_TIMES * d):
            runs.add((begin, length, d))


def _of_documents(texts: list[bytes]):
    """For each text: its words and its runs."""
    a = 0
    words = [t.split() for t in texts]  # white space of bytes: 0x20, 0x09 to 0x0D
    while a < len(words):
        b, n = a, 0
        while b < len(words) and (b == a or n + len(words[b]) <= BLOCK_WORDS):
            n += len(words[b])
            b += 1
        parts, base = [], 0
        for w in words[a:b]:
            number = {x: base + k for k, x in enumerate(dict.fromkeys(w))}
            parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
            base += len(number)
        bounds = np.append(0, np.cumsum([len(w) for w in words[a:b]]))
        found: list[list] = [[] for _ in range(b - a)]
        for s, length, q in find_runs(np.concatenate(parts), int(np.diff(bounds).max())) if n else ():
            k = int(np.searchsorted(bounds, s, "right")) - 1
            found[k].append((s - int(bounds[k]), length, q))
        yield from zip(words[a:b], found, strict=True)
        a = b


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


OUTPUTS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
           "runs_sha256": "string", "collapsed_sha256": "string", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _outputs(words: list[bytes], runs: list, wanted: tuple[str, ...]) -> dict:
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    out = {"n_runs": len(runs), "runs_sha256": None, "collapsed_sha256": None}
    out |= dict(zip(("start", "length", "period"), best or (None,) * 3, strict=True))
    out["exponent_milli"] = best and 1000 * best[1] // best[2]
    if "runs" in wanted:
        out["runs"] = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
    if "runs_sha256" in wanted:
        out["runs_sha256"] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    if {"collapsed", "collapsed_sha256"} & {*wanted}:
        joined = b" ".join(collapse(words, runs))
        out |= {"collapsed": joined, "collapsed_sha256": hashlib.sha256(joined).hexdigest()}
    return out


def detect(docs: DataFrame, outputs: tuple[str, ...] = tuple(OUTPUTS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ``outputs``) for every row, whole texts.

    ``runs``: all maximal stretches with smallest period q and at least 6 and 4q
    words, by start, then period; ``start``, ``length``, ``period`` and
    ``exponent_milli`` are those of the longest (ties: smallest start, then
    period; null without any run). ``collapsed``: the words joined by one
    blank, without those that a run holds after its first period. Null, empty
    and blank texts have no words; repeated rows and null ids are taken like
    others; an empty table gives an empty result; other columns are ignored.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = [_outputs(w, r, outputs) for w, r in _of_documents(raw)]
            cols = []
            for c in outputs:
                values = [r[c] for r in rows]
                if c == "runs":
                    cols.append(pa.array(values, pa.list_(_RUN)))
                else:
                    cols.append(pa.array(values, pa.binary()).cast(pa.string()) if c == "collapsed" else pa.array(values, kinds[OUTPUTS[c]]))
            yield pa.record_batch([batch.column(0), *cols], names=["id", *outputs])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {OUTPUTS[c]}" for c in outputs)])).withColumnRenamed("id", id_col)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, but for ids whose crc32 ends in 0 with the words from a place on replaced by repeats of the first of them.

    With h the crc32 of the decimal id, g = h div 10 and n words, word i from a
    = g mod n on becomes word a + (i - a) mod p, where p = 1 + (n - a) div (3 +
    g mod 8). Other texts, and those of null ids, stay.
    """
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(text)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents),
k AS (
  SELECT r, doc_id, o, len(o) AS n, coalesce(xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, len(id) + 1), lambda i: ascii(id[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))), 1) AS h
  FROM d),
p AS (SELECT r, doc_id, o, n, h % 10 = 0 AS made, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, (h // 10) % 8 AS f FROM k),
v AS (SELECT r, unnest(range(n)) AS i, unnest(o) AS w FROM p),
w AS (
  SELECT v.r, v.i, p.n, t.w FROM v JOIN p USING (r)
  JOIN v t ON t.r = v.r AND t.i = CASE WHEN made AND v.i >= a THEN a + (v.i - a) % (1 + (n - a) // (3 + f)) ELSE v.i END),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e) GROUP BY r, q, g),
c AS (SELECT * FROM s WHERE l >= greatest(6, 4 * q)),
u AS (SELECT * FROM c WHERE NOT EXISTS (FROM c b WHERE b.r = c.r AND b.q < c.q AND b.s <= c.s AND b.s + b.l >= c.s + c.l)),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM u GROUP BY r),
kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM w
  WHERE NOT EXISTS (FROM u WHERE u.r = w.r AND w.i >= u.s + u.q AND w.i < u.s + u.l) GROUP BY r)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM p LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
