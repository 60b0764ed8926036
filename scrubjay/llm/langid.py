"""Language identification by prediction by partial matching (operator 3).

Each language has a tree of byte contexts up to ``ORDER`` bytes with symbol
counts. A byte's code length in a language comes from the longest context the
language has seen: a seen symbol costs ``-log2(n / (total + distinct))``, an
unseen one the escape ``-log2(distinct / (total + distinct))`` and then its
cost in the next shorter context, down to 8 bits. Statistics are frozen after
training, so the cost of a byte depends on itself and the bytes before it
alone: costs are resolved once for every string of the trees, and a text's
exact code length in every language is a sum of table rows.  Passages in
another language do not decide: any window of a text may switch to the language
that codes it best, for a fixed price.

Trees come from a bounded sample (``MAX_DOCS`` whole documents a language, by
hash of id and text). Scoring reads each text where it lies, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm import textnum
from scrubjay.llm.common import fold, in_share, written
from scrubjay.llm.textnum import Lookup

#: Longest context in bytes.
ORDER = 3
#: Training documents per language (the documented bound of the fit).
MAX_DOCS = 400
#: Bytes scored together (a multiple of WINDOW); longer texts are scored piece by piece, contexts kept.
PIECE = 1 << 18
#: Bytes that may be in another language than the text, and the price in bits of each such window.
WINDOW, SWITCH = 64, 24.0
_PAD = b"\n" * ORDER  # stands before a text


def _codes(buf: np.ndarray) -> list[np.ndarray]:
    """For each length 1 to ORDER + 1, the number that the bytes up to each position form (from ORDER on)."""
    n, out, code = len(buf) - ORDER, [], np.zeros(len(buf) - ORDER, np.uint32)
    for k in range(ORDER + 1):
        code = code | (buf[ORDER - k:ORDER - k + n].astype(np.uint32) << np.uint32(8 * k))
        out.append(code)
    return out


def _counts(batches):
    for batch in batches:
        data, offsets = textnum.text_buffers(batch.column(1))
        got: dict[tuple[str, int], list] = {}
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            if text:
                for k, code in enumerate(_codes(np.frombuffer(_PAD + text, np.uint8))):
                    got.setdefault((lang, k + 1), []).append(code)
        for (lang, k), code in got.items():
            key, n = np.unique(np.concatenate(code), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(key)), pa.array(np.full(len(key), k, np.int32)),
                                   pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])


class Trees:
    """Frozen code lengths: for every string of the trees a row with its cost in each language."""

    def __init__(self, langs: list[str], prior: np.ndarray, grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
        """grams: (string length, language) to (sorted codes, counts)."""
        self.langs, self.prior = langs, prior
        width = len(langs)
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.cost: list[tuple[Lookup, np.ndarray]] = []
        self.escape: list[tuple[Lookup, np.ndarray]] = []
        for k in range(1, ORDER + 2):
            union = np.unique(np.concatenate([grams.get((k, j), none)[0] for j in range(width)] or [none[0]]))
            # contexts of length k - 1: escape costs, 0 where a language has not seen the context
            context = np.unique(union >> 8) if k > 1 else np.zeros(1, np.int64)
            total, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
            n = np.zeros((len(union), width))
            for j in range(width):
                key, count = grams.get((k, j), none)
                n[np.searchsorted(union, key), j] = count
                at = np.searchsorted(context, key >> 8)
                total[:, j] += np.bincount(at, count, len(context))
                kinds[:, j] += np.bincount(at, minlength=len(context))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                row = np.searchsorted(context, union >> 8)
                seen = -np.log2(n / (total[row] + kinds[row]))
            if k == 1:
                shorter = np.full((len(union), width), 8.0)
            else:
                lookup, cost = self.cost[-1]
                shorter = cost[lookup.find((union & ((1 << 8 * (k - 1)) - 1)).astype(np.uint32))].astype(float)
            self.cost.append((Lookup(union.astype(np.uint32)), np.where(n > 0, seen, escape[row] + shorter).astype(np.float32)))
            self.escape.append((Lookup(context.astype(np.uint32)), escape.astype(np.float32)))

    def bits(self, buf: np.ndarray) -> np.ndarray:
        """Cost of every byte from ORDER on, in each language."""
        codes = _codes(buf)
        out = np.zeros((len(codes[0]), len(self.langs)), np.float32)
        left = None  # positions whose longest strings no tree has
        for k in range(ORDER, -1, -1):
            code = codes[k] if left is None else codes[k][left]
            lookup, cost = self.cost[k]
            at = lookup.find(code)
            if left is None:
                hit = at >= 0
                out[hit] = cost[at[hit]]
                left = np.flatnonzero(~hit)
                at = at[left]
            else:
                hit = at >= 0
                out[left[hit]] += cost[at[hit]]
                left = left[~hit]
            if not len(left):
                break
            lookup, escape = self.escape[k]
            place = lookup.find(codes[k][left] >> np.uint32(8)) if k else np.zeros(len(left), np.int32)
            known = place >= 0
            out[left[known]] += escape[place[known]]
            if k == 0:
                out[left] += 8.0
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray, switch: float | None = None) -> np.ndarray:
        """Code length in bits of every text, in each language.

        With ``switch``, a window of ``WINDOW`` bytes may be coded in the
        language that is shortest for it at a price of so many bits.
        """
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        parts, owner, size = [], [], 0

        def flush():
            nonlocal parts, owner, size
            buf = np.frombuffer(b"".join(parts) + _PAD, np.uint8)
            cost = self.bits(buf)
            # each part is ORDER bytes of context and its text: cuts at its windows' starts and its end
            length = np.array([len(p) for p in parts])
            end = np.cumsum(length) - ORDER
            windows = -((ORDER - length) // WINDOW)
            place = np.arange(int((windows + 1).sum())) - np.repeat(np.cumsum(windows + 1) - windows - 1, windows + 1)
            cut = np.minimum(np.repeat(end + ORDER - length, windows + 1) + WINDOW * place, np.repeat(end, windows + 1))
            each = np.add.reduceat(cost, cut, axis=0, dtype=float)[place < np.repeat(windows, windows + 1)]
            if switch is not None:
                each = np.minimum(each, each.min(1, keepdims=True) + switch)
            np.add.at(out, np.repeat(owner, windows), each)
            parts, owner, size = [], [], 0

        for i in range(len(offsets) - 1):
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            for a in range(0, len(text), PIECE):
                parts.append((text[a - ORDER:a] if a else _PAD) + text[a:a + PIECE])
                owner.append(i)
                size += len(parts[-1])
                if size >= PIECE:
                    flush()
        if parts:
            flush()
        return out


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Trees:
    """Trees from whole texts with a language whose id's crc32 leaves a remainder other than 0 modulo 5.

    The sample holds up to ``max_docs`` distinct rows (id and text) of each
    language, those with the smallest hash, whatever ids or rows repeat.
    """
    text = F.col("text").cast("string")
    known = docs.select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.md5(F.concat_ws(
        ":", F.col("doc_id").cast("string"), F.xxhash64(text).cast("string"), F.length(text).cast("string"))).alias("key")).where(
        (fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())
    # one short row per distinct row, repeats collapsed before the shuffle; "rows" counts them all
    each = written(known.groupBy("lang", "key").agg(F.count("*").alias("rows")), "known")
    count = each.groupBy("lang").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    size = {r["lang"]: r["rows"] for r in count.select("lang", "rows").collect()}  # one row per language, as in the broadcast
    few = each.join(F.broadcast(count.select("lang", "n")), "lang").where(in_share(F.col("key"), max_docs, F.col("n")))
    by_hash = Window.partitionBy("lang").orderBy("key")
    few = few.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= max_docs)
    sample = written(few.select("lang", "key"), "taught")  # at most max_docs rows a language
    taught = known.join(sample, ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))  # equal texts
    # about a language's sample a task, so that its repeated strings are counted before they are shuffled
    counts = taught.select("lang", "text").coalesce(max(4, len(size))).mapInArrow(
        _counts, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toPandas().sort_values("gram")  # bounded by the sample's bytes
    langs = sorted(size)
    grams = {(k, langs.index(lang)): (g.gram.to_numpy(np.int64), g.n.to_numpy(np.int64)) for (k, lang), g in rows.groupby(["k", "lang"])}
    total = sum(size.values())
    return Trees(langs, np.array([-np.log2(size[x] / total) for x in langs]), grams)


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, whole texts.

    The language has the shortest code for its name and the text; ``score`` is
    its share of ``2 ** -bits`` over all languages, ties go to the smaller
    name. Null texts, texts without a letter and corpora without any taught
    language give ``und`` and 0. Repeated rows and null ids are predicted like
    others; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        t = sent.value
        for batch in batches:
            letters = np.array(batch.column(2).to_pylist(), bool)
            n = batch.num_rows
            if t.langs and n:
                bits = t.lengths(*textnum.text_buffers(batch.column(1)), SWITCH) + t.prior
                best = np.argmin(bits, 1)
                share = 1 / np.exp2(np.minimum(0, bits[np.arange(n), best][:, None] - bits)).sum(1)
                name = np.array(t.langs, object)[best]
            else:
                letters, share, name = np.zeros(n, bool), np.zeros(n), np.full(n, "und", object)
            yield pa.record_batch([batch.column(0), pa.array(np.where(letters, name, "und"), pa.string()),
                                   pa.array(np.where(letters, share, 0.0))], names=["id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
