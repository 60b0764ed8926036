"""Exact dedup by Patricia-trie owners (operator 13).

Texts, A to Z lowered, are dealt to owners by a hash of length and content. An
owner inserts whole byte strings into a compressed radix trie: equality is that
of the bytes, the hash only chooses the owner. A terminal node keeps the
identifier that stays, the number of rows and the classes that ended there.

Before the shuffle every batch collapses its equal texts to one class, so a
text that fills a third of the table reaches its owner once a batch. A trie
past ``SPILL_BYTES`` cuts off its heaviest subtree: the texts below go out as
rows of the next round, which deals them to more owners, and later texts with
that prefix follow them. Owners return one short row per class; the rows of the
table find theirs by a join on the class.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import has_rows, written

#: Text bytes of an owner on average, and bytes of labels that a trie holds.
OWNER_BYTES, SPILL_BYTES = 24 << 20, 160 << 20
#: Bytes counted for a node besides its label.
NODE_BYTES = 240
#: Result rows of an owner that leave together.
OUT_ROWS = 20_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Entry:
    """What a terminal node holds: the row that stays, how many rows there are, and their classes."""

    __slots__ = ("doc_id", "members", "n", "row")

    def __init__(self, doc_id: int | None, row: int, n: int, members: list[int]):
        self.doc_id, self.row, self.n, self.members = doc_id, row, n, members

    def merge(self, other: Entry, largest: bool) -> None:
        if _before(other.doc_id, other.row, self.doc_id, self.row, largest):
            self.doc_id, self.row = other.doc_id, other.row
        self.n += other.n
        self.members += other.members


def _before(a: int | None, row_a: int, b: int | None, row_b: int, largest: bool) -> bool:
    """Whether row a stays rather than row b: ids first, null ids last, ties by row number."""
    if a == b:
        return row_a < row_b
    if a is None or b is None:
        return b is None
    return a > b if largest else a < b


class Node:
    __slots__ = ("children", "cut", "entry", "label")

    def __init__(self, label: bytes):
        self.label, self.children, self.entry, self.cut = label, None, None, False


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings, with subtrees that may be cut off."""

    def __init__(self, largest: bool = True):
        self.root, self.largest, self.bytes, self.terminals = Node(b""), largest, 0, 0

    def insert(self, text: bytes, entry: Entry) -> bool:
        """Add ``entry`` under ``text``; False if its subtree was cut off."""
        node, at = self.root, 0
        while not node.cut:
            if at == len(text):
                if node.entry is None:
                    node.entry = entry
                    self.terminals += 1
                else:
                    node.entry.merge(entry, self.largest)
                return True
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += len(child.label) + NODE_BYTES
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                k = _common(child.label, text, at)
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children = {child.label[0]: child}
                node.children[text[at]] = upper
                self.bytes += NODE_BYTES
                node, at = upper, at + k
        return False

    def _weights(self) -> dict[int, int]:
        """Bytes below and at every node."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += (node.children or {}).values()
        out: dict[int, int] = {}
        for node in reversed(order):
            out[id(node)] = 0 if node.cut else len(node.label) + NODE_BYTES + sum(out[id(c)] for c in (node.children or {}).values())
        return out

    def cut_heaviest(self) -> list[tuple[bytes, Entry]]:
        """Cut the heaviest proper subtree off; its texts with their entries."""
        weight = self._weights()
        node, path = self.root, b""
        while True:
            child = max((c for c in node.children.values() if not c.cut), key=lambda c: weight[id(c)])
            alone = node.entry is None and sum(not c.cut for c in node.children.values()) == 1
            if not (alone and child.children):
                break
            node, path = child, path + child.label
        out = list(_texts(child, path))
        self.bytes -= weight[id(child)] - len(child.label)
        self.terminals -= len(out)
        child.children, child.entry, child.cut = None, None, True
        return out

    def entries(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.entry is not None:
                yield node.entry
            stack += (node.children or {}).values()


def _texts(node: Node, path: bytes):
    stack = [(node, path + node.label)]
    while stack:
        node, text = stack.pop()
        if node.entry is not None:
            yield text, node.entry
        stack += [(c, text + c.label) for c in (node.children or {}).values()]


DESCRIBED = "row long, doc_id long, sha binary, class long, text binary, size long, best long, best_row long, n long"


def _describe(largest: bool):
    def run(batches):
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [(t or b"").translate(_LOWER) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            first: dict[bytes, int] = {}
            at = [first.setdefault(t, k) for k, t in enumerate(texts)]
            best, count = {}, {}
            for k, f in enumerate(at):
                count[f] = count.get(f, 0) + 1
                b = best.setdefault(f, k)
                if _before(ids[k], rows[k], ids[b], rows[b], largest):
                    best[f] = k
            sha = {f: hashlib.sha256(texts[f]).digest() for f in count}
            one = [k if k == f else None for k, f in enumerate(at)]  # the first row of each class carries its text
            pick = lambda values: [None if k is None else values(k) for k in one]  # noqa: B023, E731
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array([sha[f] for f in at], pa.binary()), pa.array([rows[f] for f in at], pa.int64()),
                pa.array(pick(texts.__getitem__), pa.binary()), pa.array(pick(lambda k: len(texts[k])), pa.int64()),
                pa.array(pick(lambda k: ids[best[k]]), pa.int64()), pa.array(pick(lambda k: rows[best[k]]), pa.int64()),
                pa.array(pick(count.__getitem__), pa.int64())],
                names=["row", "doc_id", "sha", "class", "text", "size", "best", "best_row", "n"])
    return run


OWNED = "member long, best long, best_row long, n long, members array<long>, text binary"


def _owner(largest: bool, spill_bytes: int):
    def batch_of(rows):
        kinds = (pa.int64(),) * 4 + (pa.list_(pa.int64()), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                               names=["member", "best", "best_row", "n", "members", "text"])

    def run(batches):
        trie, spilled, held = PatriciaTrie(largest), [], 0
        for batch in batches:
            for members, text, best, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = Entry(best, row, n, members)
                out = [] if trie.insert(text, entry) else [(text, entry)]
                while trie.bytes > spill_bytes and trie.terminals > 1:
                    out += trie.cut_heaviest()
                for t, e in out:
                    spilled.append((None, e.doc_id, e.row, e.n, e.members, t))
                    held += len(t)
                    if held > OWNER_BYTES:
                        yield batch_of(spilled)
                        spilled, held = [], 0
        if spilled:
            yield batch_of(spilled)
        out = []
        for e in trie.entries():
            out += [(m, e.doc_id, e.row, e.n, None, None) for m in e.members]
            if len(out) >= OUT_ROWS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)
    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True,
          spill_bytes: int | None = None) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes are, A to Z lowered and nothing else; null
    counts as empty. Of equal texts the row with the largest id stays
    (``largest``; else the smallest), a row with a null id only if no other has
    one, and of repeated rows one. ``keep_id`` is the id that stays, null only
    if all its group's are. An empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    described = written(rows.mapInArrow(_describe(largest), DESCRIBED), "classes")
    left = described.where("text IS NOT NULL").select(F.array("class").alias("members"), "text", "best", "best_row", "n")
    total = described.agg(F.sum("size")).first()[0] or 0
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / OWNER_BYTES))
    found, turn = None, 0
    while True:
        dealt = left.repartition(owners, F.xxhash64(F.lit(turn), F.length("text"), "text"))
        out = written(dealt.mapInArrow(_owner(largest, spill_bytes or SPILL_BYTES), OWNED), "owned")
        done = out.where("member IS NOT NULL").select("member", F.col("best").alias("keep_id"), "best_row", F.col("n").alias("group_size"))
        found = done if found is None else found.unionByName(done)
        left = out.where("member IS NULL").select("members", "text", "best", "best_row", "n")
        if not has_rows(left):
            break
        owners, turn = 4 * owners, turn + 1
    return described.select("row", "doc_id", "sha", "class").join(found, F.col("class") == F.col("member")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
