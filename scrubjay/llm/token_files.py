"""Token ids as flat binary files with 64-bit document offsets (operator 7).

Documents are range-partitioned by id and sorted, each task encodes its range
and writes three flat files: ids (unsigned 16 or 32 bit, little-endian, by
vocabulary size), offsets (unsigned 64 bit, one more than documents, counted
from the part's first id) and document ids (signed 64 bit). One row per part
comes back; prefix sums over these rows give every part's base, and a manifest
in the folder (JSON: dtype of the ids and the parts with their bases) stores
them, so that any later session opens the set. Readers memory-map a part and
add its base.

Pretokens are known by a hash and compared with the learnt one's code points, so
ids are always those of the library.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
import os
import posixpath
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrubjay.llm import textnum
from scrubjay.llm.pretokens import byte_level_starts
from scrubjay.llm.textnum import Lookup

#: Pretokens a worker remembers (about 100 bytes each); past this it starts anew (results do not change).
CACHE = 1_500_000
#: Pretokens met since the large table of known ones was last built anew.
YOUNG = 150_000
#: Bytes of text whose pretokens are found together.
BLOCK = 2 << 20
#: Characters of a text by which rows that share an id, or have none, are dealt to parts.
RANGE_CHARS = 32
MANIFEST = "manifest.json"


class PretokenEncoder:
    """Ids of whole texts; each distinct pretoken goes through the tokenizer once."""

    def __init__(self, raw: bytes, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.specials = [t["content"] for t in json.loads(raw)["added_tokens"]]
        self.dtype = dtype
        self._forget()

    def _forget(self) -> None:
        self.old = self.young = Lookup(np.empty(0, np.uint64))
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, self.dtype)
        self.length = np.empty(0, np.int64)  # code points of the learnt pretokens, end to end
        self.points = np.empty(0, np.uint32)

    def _find(self, word: np.ndarray) -> np.ndarray:
        place = self.old.find(word)
        rest = np.flatnonzero(place < 0)
        late = self.young.find(word[rest])
        place[rest] = np.where(late >= 0, late + len(self.old.keys), -1)
        return place

    def _learn(self, word: np.ndarray) -> None:
        young = np.concatenate([self.young.keys, word])
        if len(young) > YOUNG:
            self.old, young = Lookup(np.concatenate([self.old.keys, young])), young[:0]
        self.young = Lookup(young)

    def _others(self, place: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pretokens differ from the learnt ones that their hashes led to; they lie end to end in ``points``."""
        length = end - start
        begin = (np.cumsum(self.length) - self.length)[place]
        source = np.repeat(begin - start, length) + np.arange(len(points))
        differ = points != self.points[np.minimum(source, len(self.points) - 1)]
        return np.flatnonzero(np.logical_or.reduceat(differ, start) | (self.length[place] != length))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = [i for s in self.specials for i, t in enumerate(texts) if s in t]
        plain = list(texts)
        for i in special:
            plain[i] = ""
        out = self._plain(plain)
        for i in special:  # contents of special tokens: the library cuts the text itself
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype)
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.empty(0, self.dtype)] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        length = np.array([len(t) for t in texts])
        at = np.cumsum(length) - length
        start = byte_level_starts(points, at[length > 0])
        end = np.append(start[1:], len(points))
        word = textnum.segments(points.astype(np.uint64) + np.uint64(1), start, end)
        if len(self.size) > CACHE:
            self._forget()
        place = self._find(word)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = np.unique(word[missing], return_index=True)
            first = missing[first]
            ids = self._library([joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            self.length = np.concatenate([self.length, (end - start)[first]])
            self.points = np.concatenate([self.points, *(points[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True))])
            self.size = np.concatenate([self.size, [len(x) for x in ids]])
            self.ids = np.concatenate([self.ids, np.array(list(itertools.chain.from_iterable(ids)), self.dtype)])
            self._learn(new)
            place[missing] = self._find(word[missing])
        known, size, ids = np.cumsum(self.size) - self.size, self.size[place], self.ids
        offset = known[place]
        others = self._others(place, points, start, end)
        if len(others):  # a hash shared by unlike pretokens: the library codes these each time
            coded = self._library([joined[a:b] for a, b in zip(start[others].tolist(), end[others].tolist(), strict=True)])
            size[others] = [len(x) for x in coded]
            offset[others] = len(ids) + np.cumsum(size[others]) - size[others]
            ids = np.concatenate([ids, np.array(list(itertools.chain.from_iterable(coded)), self.dtype)])
        done = np.cumsum(size)
        flat = ids[np.repeat(offset - done + size, size) + np.arange(int(done[-1]))]
        bound = np.append(0, done)[np.searchsorted(start, np.append(at, len(points)))]
        return [flat[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def _encoder(raw: bytes, dtype: str) -> PretokenEncoder:
    return PretokenEncoder(raw, dtype)


@dataclass(frozen=True)
class TokenFiles:
    """A written set: folder, dtype of ids and one row per part with its bases (what the manifest holds)."""

    folder: str
    dtype: str
    parts: list  # (part, documents, null ids, ids, first document, first id)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


@contextlib.contextmanager
def _whole(fs: pafs.FileSystem, path: str):
    """A file written under a name of its own, then renamed: a task that runs twice leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        yield f
    fs.move(own, path)


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if not fs.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with fs.open_input_file(path) as f:  # a store that cannot be mapped
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, vocab_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text", partitions: int | None = None) -> TokenFiles:
    """Encode every whole text, append ``end_id``, write the files in ascending ``id_col`` order.

    ``folder`` must be storage that executors and driver share. Null and empty
    texts give only the end id; null document ids come first (their number is
    kept with the part) and rows repeating an id keep the order of their
    texts, parts being cut between texts too; an empty table gives a set
    without parts; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocab_path, "rb") as f:
        raw = f.read()
    top = max([*json.loads(raw)["model"]["vocab"].values(), *(t["id"] for t in json.loads(raw)["added_tokens"]), end_id])
    dtype = "<u2" if top < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(raw)

    def run(batches):
        enc, end = _encoder(sent.value, dtype), np.array([end_id], dtype).tobytes()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, sizes, ids, nulls = first.column(2)[0].as_py(), [], [], 0
        name = posixpath.join(base, f"part-{part:06d}")
        with _whole(fs, name + ".ids") as f:
            for batch in itertools.chain([first], batches):
                nulls += batch.column(0).null_count
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for block in textnum.blocks(batch, 1, BLOCK):
                    for x in enc.encode([t or "" for t in block.column(1).to_pylist()]):
                        f.write(x.tobytes() + end)
                        sizes.append(len(x) + 1)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype="<u8")]).astype("<u8")
        with _whole(fs, name + ".offsets") as f:
            f.write(offsets.tobytes())
        with _whole(fs, name + ".docs") as f:
            f.write(np.concatenate(ids).tobytes())
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (part, len(sizes), nulls, int(offsets[-1]))],
                              names=["part", "docs", "nulls", "ids"])

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .repartitionByRange(n, "id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("id", "text")
            .withColumn("part", F.spark_partition_id().cast("long")))
    # one short row per part, whatever the number of documents
    made = sorted(tuple(r) for r in rows.mapInArrow(run, "part long, docs long, nulls long, ids long").collect())
    parts, first_doc, first_id = [], 0, 0
    for part, n_docs, nulls, n_ids in made:
        parts.append((part, n_docs, nulls, n_ids, first_doc, first_id))
        first_doc, first_id = first_doc + n_docs, first_id + n_ids
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with _whole(fs, posixpath.join(base, MANIFEST)) as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "parts": parts}).encode())
    return TokenFiles(folder, dtype, parts)


def open_token_files(folder: str) -> TokenFiles:
    """A set that was written before, from its manifest."""
    fs, base = _open(folder)
    with fs.open_input_file(posixpath.join(base, MANIFEST)) as f:
        found = json.loads(f.read())
    return TokenFiles(folder, found["dtype"], [tuple(p) for p in found["parts"]])


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document from the memory-mapped files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before; the checksum is that of
    the ids as little-endian unsigned 32-bit integers.
    """
    folder, dtype = files.folder, files.dtype

    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for part, n_docs, nulls, _, _, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = posixpath.join(base, f"part-{part:06d}")
                ids, offsets = _mapped(fs, name + ".ids", dtype), _mapped(fs, name + ".offsets", "<u8")
                doc = _mapped(fs, name + ".docs", "<i8")
                bounds = offsets.tolist()
                for a in range(0, n_docs, 20_000):
                    b = min(n_docs, a + 20_000)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes())
                           for x, y in zip(bounds[a:b], bounds[a + 1:b + 1], strict=True)]
                    yield pa.record_batch(
                        [pa.array(doc[a:b].astype(np.int64), pa.int64(), mask=np.arange(a, b) < nulls),
                         pa.array(offsets[a:b].astype(np.int64) + first), pa.array(np.diff(offsets[a:b + 1]).astype(np.int64)),
                         pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.createDataFrame(files.parts, "part long, docs long, nulls long, ids long, first_doc long, first_id long")
    parts = parts.repartition(max(1, len(files.parts)), "part") if files.parts else parts
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(files: TokenFiles, position: int) -> np.ndarray:
    """Ids of the document at ``position`` in the global order, mapped from its part."""
    part = next(p for p in files.parts if p[4] <= position < p[4] + p[1])
    fs, base = _open(files.folder)
    name = posixpath.join(base, f"part-{part[0]:06d}")
    offsets = _mapped(fs, name + ".offsets", "<u8")
    a, b = offsets[position - part[4]:position - part[4] + 2].tolist()
    return _mapped(fs, name + ".ids", files.dtype)[a:b]
