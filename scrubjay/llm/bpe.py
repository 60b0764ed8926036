"""BPE encoding and decoding by a pair occurrence index (operator 10).

A task first splits its texts into pretokens. The distinct pretokens that it
has not met yet form one array of symbols, and an index maps every mergeable
adjacent pair to all its positions there. Active ranks leave a heap in
ascending order; applying a rank rewrites all its positions and updates the
lists of the neighbouring pairs it touches. Documents are then strings of
known pretokens. Nothing is shuffled; memory is one block of documents plus a
pretoken cache of fixed size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm import textnum
from scrubjay.llm.pretokens import WORD_LEVEL, Splitter, byte_symbols, lower_nfc

#: Pretokens a worker remembers (about 300 bytes each); past this it starts anew (results do not change).
CACHE = 150_000
#: Bytes of text whose new pretokens are merged together.
BLOCK = 4 << 20


class PairIndex:
    """The merges of a vocabulary, applied to many pretokens at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.first = np.array([vocab[s] for s in byte_symbols()])
        self.last = np.array([vocab[s + suffix] for s in byte_symbols()])
        self.wall = max(vocab.values()) + 1  # stands between pretokens; no rule holds it
        rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            rules.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.by_rank = {rank: (*pair, new) for pair, (rank, new) in rules.items()}
        keys = np.array([a * (self.wall + 1) + b for a, b in rules])
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in rules.values()])[order]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where none merges it."""
        key = a * (self.wall + 1) + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pretokens in a row, and how many each has."""
        size = np.array([len(w) for w in words])
        end = np.cumsum(size + 1)
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        sym = self.first[raw]
        sym[end - 2] = self.last[raw[end - 2]]
        sym[end - 1] = self.wall
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[0] = n - 1
        # the index: positions of every mergeable pair, by rank, and those that merges add
        rank = self._rank(sym[:-1], sym[1:])
        place = np.argsort(rank, kind="stable")
        active, begin = np.unique(rank[place], return_index=True)
        listed = dict(zip(active.tolist(), np.split(place, begin[1:]), strict=True))
        listed.pop(-1, None)
        added: dict[int, list[int]] = {}
        heap = sorted(listed)
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.by_rank[r]
            at = listed.pop(r, None)
            if (more := added.pop(r, None)) is not None:
                more = np.array(more)
                at = np.unique(more if at is None else np.concatenate([at, more]))
            j = after[at]
            live = (sym[at] == a) & (sym[j] == b)
            at, j = at[live], j[live]
            if a == b and len(at) > 1:  # in a run of equal symbols every second place goes
                keep, last = [], -1
                for x, y in zip(at.tolist(), j.tolist(), strict=True):
                    keep.append(x != last)
                    last = y if x != last else -1
                at, j = at[keep], j[keep]
            if not len(at):
                continue
            sym[at], sym[j] = new, -1
            k = after[j]
            after[at], before[k] = k, at
            left, right = np.concatenate([before[at], at]), np.concatenate([at, k])
            rank = self._rank(sym[left], sym[right])
            touched = rank >= 0
            for q, x in zip(rank[touched].tolist(), left[touched].tolist(), strict=True):
                if q in added:
                    added[q].append(x)
                else:
                    added[q] = [x]
                    if q not in listed:
                        heapq.heappush(heap, q)
        alive = (sym >= 0) & (sym != self.wall)
        return sym[alive], np.add.reduceat(alive, end - size - 1, dtype=np.int64)


class Lexicon(dict):
    """Numbers pretokens in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


class Codec:
    """Encoder and decoder of one word-level BPE tokenizer file (its JSON text)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.index = PairIndex(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.splitter = Splitter(WORD_LEVEL, list(self.specials), lower_nfc)
        self.token = {i: t for t, i in (model["vocab"] | self.specials).items()}
        self.number = {i: str(i) for i in self.token}
        self._forget()

    def _forget(self) -> None:
        self.words = Lexicon({s: k for k, s in enumerate(self.specials)})
        self.id_text = [str(i) for i in self.specials.values()]
        self.decoded = list(self.specials)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text as numbers of pretokens, whose ``id_text`` and ``decoded`` the codec then knows."""
        if len(self.words) > CACHE:
            self._forget()
        number = self.words.__getitem__
        docs = [np.array(list(map(number, self.splitter.split(t))), np.int32) for t in texts]
        if new := list(itertools.islice(self.words, len(self.id_text), None)):
            flat, size = self.index.encode([w.encode() for w in new])
            flat, end = flat.tolist(), np.cumsum(size).tolist()
            number, token = [self.number[i] for i in flat], [self.token[i] for i in flat]
            for a, b in zip([0, *end], end):
                self.id_text.append(" ".join(number[a:b]))
                self.decoded.append(" ".join(token[a:b]))  # as decode() does
        return docs

    def decode(self, ids) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string",
           "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, vocab_path: str, outputs: tuple[str, ...] = ("ids", "decoded"),
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text decoded from them: (doc_id, *outputs).

    ``outputs``: any of ``ids``, ``decoded``, ``n_tokens``, ``ids_sha256``
    (decimal ids joined by a space), ``decoded_sha256``. The vocabulary file
    (fixed size) is read on the driver and broadcast.

    Null and empty texts give no ids and an empty decoded text; contents of
    special tokens in a text become their ids; rows, repeated or with null
    ids, are kept one to one; an empty table gives an empty result; other
    columns are ignored whatever their names.
    """
    with open(vocab_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(raw.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        for batch in batches:
            for block in textnum.blocks(batch, 1, BLOCK):
                out = {name: [] for name in outputs}
                for words in map(np.ndarray.tolist, c.encode([t or "" for t in block.column(1).to_pylist()])):
                    id_text = " ".join([c.id_text[w] for w in words])
                    decoded = " ".join([c.decoded[w] for w in words])
                    made = {"ids": lambda t=id_text: [int(i) for i in t.split()], "n_tokens": lambda t=id_text: t.count(" ") + 1 if t else 0,
                            "decoded": lambda t=decoded: t, "ids_sha256": lambda t=id_text: sha(t), "decoded_sha256": lambda t=decoded: sha(t)}
                    for name in outputs:
                        out[name].append(made[name]())
                yield pa.record_batch([block.column(0), *(pa.array(out[n], types.get(n, pa.string())) for n in outputs)],
                                      names=["id", *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{n} {OUTPUTS[n]}" for n in outputs)])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
