"""Token ids in files of planes: blocks of ids are transposed into byte or bit planes, each compressed with Zstandard, and an
index of the blocks stands at the end.

File format (integers little-endian):
  header   magic, kind of planes (8 or 1 bits), ids of a full block
  blocks   the planes of a block one after the other, lowest first; planes above the highest that is not zero are left out.
           Byte plane k holds byte k of each id, bit plane k holds bit k of each id, eight ids to a byte
  index    Zstandard frames: of the blocks (place, ids, checksum, lengths of the planes), and of the documents (doc_id, whether
           it is null, number of ids)
  trailer  places and lengths of the two frames, numbers of ids and documents, magic
A reader finds any id by the index and decodes only the blocks that it needs (`Reader.ids`), or streams a whole file.

Encoding. The library's tokenizer does it, but each distinct stretch of text once: a text is cut before every run of ASCII
white space that follows something else, where no token of a byte-level tokenizer with the usual pattern reaches across. Arrow
finds the distinct stretches of a batch; those that the worker has not seen are encoded by the library, many at a time,
and told apart by the lengths of their tokens in bytes. What a worker remembers is bounded (`REMEMBERED`). Tokenizers of other
kinds encode whole texts.

Writing. Rows are dealt by ranges of doc_id and sorted; each task streams its part to files of its own (a new one after
`rotate` ids), whose manifest row says the range and the order within it. Spark's commit of the manifest decides which attempt counts.
Starts over all files are sums over the manifest, a row for each file.

Defined cases. Null text: as empty, the end id alone. Rows without doc_id: first. Rows that share a doc_id: in the order of the table;
each is a document. Very long texts: a text's ids are held at once. Strings of special tokens in a text are these tokens, as the
library does by default. Ids must be below 2^32. Empty table: no file, empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_path, pieces, prepare, saved, table, utf8
from .warc import opened

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Stretches that a worker remembers, bytes of text that are encoded together, and unseen stretches that go to the library as one text.
REMEMBERED, TOGETHER, JOINED = 2_000_000, 8 << 20, 100

# --- the format ---------------------------------------------------------------------------------------------------

MAGIC = b"IDPLANES"
HEADER, TRAILER = struct.Struct("<8sII"), struct.Struct("<QQQQQQ8s")


def planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first, up to the highest that is not zero."""
    ids = ids.astype("<u4")
    used = -(-int(ids.max(initial=0)).bit_length() // bits)
    if bits == 8:
        return [x.tobytes() for x in ids.view(np.uint8).reshape(-1, 4)[:, :used].T]
    return [np.packbits((ids >> k) & 1, bitorder="little").tobytes() for k in range(used)]


def joined(found: list[bytes], n: int, bits: int) -> np.ndarray:
    """The n ids of a block from its planes."""
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(found):
        raw = np.frombuffer(plane, np.uint8)
        ids |= (raw if bits == 8 else np.unpackbits(raw, count=n, bitorder="little")).astype("<u4") << np.uint32(bits * k)
    return ids


class Writer:
    """One file; ids come document by document and leave block by block."""

    def __init__(self, out: BinaryIO, bits: int = 8, block: int = 1 << 16, level: int = 3) -> None:
        if bits not in (1, 8):
            raise ValueError("planes are of 1 or 8 bits")
        self.out, self.bits, self.block = out, bits, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.total = 0, 0
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.blocks: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        self.n_docs = 0
        self.put(HEADER.pack(MAGIC, bits, block))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Some documents: their ids, and the token ids of all of them."""
        self.docs.append(np.stack([doc_ids, nulls, lengths]).astype("<i8"))
        self.n_docs += len(doc_ids)
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ready = np.concatenate(self.held)
            full = len(ready) // self.block * self.block
            for lo in range(0, full, self.block):
                self.write_block(ready[lo : lo + self.block])
            self.held, self.waiting = [ready[full:].copy()], len(ready) - full

    def write_block(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p) for p in planes(ids, self.bits)]
        self.blocks.append([self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(frames), *map(len, frames)])
        self.put(b"".join(frames))

    def close(self) -> int:
        """Write what is left and the index; returns the file's size."""
        if self.waiting:
            self.write_block(np.concatenate(self.held))
        parts = [self.zstd.compress(np.array([x for b in self.blocks for x in b], "<i8").tobytes())]
        parts.append(self.zstd.compress((np.hstack(self.docs) if self.docs else np.zeros((3, 0), "<i8")).tobytes()))
        at = self.at
        for p in parts:
            self.put(p)
        self.put(TRAILER.pack(at, len(parts[0]), len(parts[1]), len(self.blocks), self.total, self.n_docs, MAGIC))
        self.out.close()
        return self.at


class Reader:
    """One file that can be read at any place."""

    def __init__(self, source, name: str = "file") -> None:
        self.source, self.name = source, name
        size = source.size()
        if size < HEADER.size + TRAILER.size:
            raise ValueError(f"{name}: too short")
        magic, self.bits, self.block = HEADER.unpack(self.get(0, HEADER.size))
        at, index, docs, blocks, self.total, self.n_docs, end = TRAILER.unpack(self.get(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or end != MAGIC or self.bits not in (1, 8):
            raise ValueError(f"{name}: not a file of planes, or cut off")
        unzip = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")
        flat, self.blocks = unzip(self.get(at, index)).tolist(), []
        while flat:
            n = 4 + flat[3]
            self.blocks.append(flat[:n])
            flat = flat[n:] if len(flat) <= 4096 else self.rest(flat, n)
        if len(self.blocks) != blocks or sum(b[1] for b in self.blocks) != self.total:
            raise ValueError(f"{name}: the index does not fit")
        self.docs = unzip(self.get(at + index, docs)).reshape(3, -1)
        if self.docs.shape[1] != self.n_docs or self.docs[2].sum() != self.total:
            raise ValueError(f"{name}: the documents do not fit")

    def rest(self, flat: list[int], n: int) -> list[int]:
        """Long indexes are taken apart in place, not copied for each block."""
        at = n
        while at < len(flat):
            m = 4 + flat[at + 3]
            self.blocks.append(flat[at : at + m])
            at += m
        return []

    def get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read_block(self, k: int) -> np.ndarray:
        at, n, crc, count, *lengths = self.blocks[k]
        raw, zstd, found = self.get(at, sum(lengths)), zstandard.ZstdDecompressor(), []
        for size in lengths:
            found.append(zstd.decompress(raw[:size]))
            raw = raw[size:]
        ids = joined(found, n, self.bits)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"{self.name}, block {k}: checksum")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of the half-open range of the file's ids; only the blocks that hold them are read."""
        stop = min(stop, self.total)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block  # all blocks but the last are full
        return np.concatenate([self.read_block(k) for k in range(first, last + 1)])[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place of the first id in the file, ids; a block at a time is decoded."""
        block, base, k = np.zeros(0, "<u4"), 0, 0
        at = 0
        for doc_id, null, n in zip(*self.docs.tolist(), strict=True):
            parts, need = [], n
            while need:
                if at - base == len(block):
                    base, block, k = base + len(block), self.read_block(k), k + 1
                piece = block[at - base : at - base + need]
                parts.append(piece)
                at, need = at + len(piece), need - len(piece)
            yield None if null else doc_id, at - n, parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])


# --- encoding -----------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of the white space beyond ASCII, in UTF-8: C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """ids of texts, as the library's tokenizer gives them one by one."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        before = said["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        own = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]) for t in said["added_tokens"])
        self.by_stretch = bool(plain and own and said["normalizer"] is None and said["model"]["type"] == "BPE" and not said["model"].get("dropout"))
        if self.by_stretch:
            sizes = {i: len(t) for t, i in said["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in said["added_tokens"]}
            self.size = np.zeros(max(sizes) + 1, np.int64)
            self.size[list(sizes)] = list(sizes.values())
        self.forget()

    def forget(self) -> None:
        self.known, self.codes = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        data, off = utf8(texts)
        if not self.by_stretch:
            each = self.library([x or "" for x in texts.to_pylist()])
            return np.array([i for x in each for i in x], "<u4"), np.array([len(x) for x in each], np.int64)
        made = [self.stretches(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in pieces(off, TOGETHER)]
        return np.concatenate([np.zeros(0, "<u4"), *(m[0] for m in made)]), np.concatenate([np.zeros(0, np.int64), *(m[1] for m in made)])

    def stretches(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(off) - 1, np.int64)
        space = _SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        # no cut within a run of white space that has other characters than ASCII
        lead = np.flatnonzero(_LEAD[data])
        odd = np.zeros(n + 1, bool)
        if len(lead):
            at = lambda k: data[np.minimum(lead + k, n - 1)]
            a, b, c = data[lead], at(1), at(2)
            two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            odd[lead[two] + 2] = odd[np.minimum(lead[three] + 3, n)] = True
            cut &= ~odd
        cut[off] = True
        at = np.flatnonzero(cut)
        found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = found.dictionary.cast(pa.large_binary())
        where = pc.index_in(distinct, value_set=self.known)
        if where.null_count:
            new = distinct.filter(where.is_null())
            codes = self.unseen(new)
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
            self.known, self.codes = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.codes, codes])
            where = pc.index_in(distinct, value_set=self.known)
            if where.null_count:  # some that were known were forgotten just now
                missing = distinct.filter(where.is_null())
                self.known, self.codes = pa.concat_arrays([self.known, missing]), pa.concat_arrays([self.codes, self.unseen(missing)])
                where = pc.index_in(distinct, value_set=self.known)
        out = self.codes.take(where).take(found.indices)
        ends = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1] // 4
        ids = np.frombuffer(out.buffers()[2], "<u4")[ends[0] : ends[-1]] if out.buffers()[2] is not None else np.zeros(0, "<u4")
        return ids, np.diff(ends[np.searchsorted(at, off)])

    def unseen(self, new: pa.Array) -> pa.Array:
        """The ids of each new stretch, as bytes. Those that begin with ASCII white space and end in something else may stand
        one after the other in one text."""
        raw = new.to_pylist()
        out: list[bytes | None] = [None] * len(raw)
        chain, alone = [], []
        for i, x in enumerate(raw):
            fit = x[0] in b"\t\n\v\f\r " and x[-1] not in b"\t\n\v\f\r " and (len(x) < 2 or x[-2] != 0xC2) and (len(x) < 3 or x[-3] not in b"\xe1\xe2\xe3")
            (chain if fit else alone).append(i)
        groups = [chain[k : k + JOINED] for k in range(0, len(chain), JOINED)]
        for group, ids in zip(groups, self.library([b"".join([raw[i] for i in g]).decode() for g in groups]), strict=True):
            ids = np.array(ids, "<u4")
            ends = np.cumsum(self.size[ids])
            want = np.cumsum([len(raw[i]) for i in group])
            stop = np.searchsorted(ends, want) + 1
            if len(ends) and ends[-1] == want[-1] and (ends[stop - 1] == want).all():
                for i, a, b in zip(group, np.append(0, stop[:-1]), stop, strict=True):
                    out[i] = ids[a:b].tobytes()
            else:
                alone += group
        for i, ids in zip(alone, self.library([raw[i].decode() for i in alone]), strict=True):
            out[i] = np.array(ids, "<u4").tobytes()
        return pa.array(out, pa.large_binary())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's own, kept while it lives."""
    return Encoder(path)


# --- tables -------------------------------------------------------------------------------------------------------

MANIFEST = "part int, seq int, path string, docs long, ids long, bytes long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int | None = 2, bits: int = 8, block: int = 1 << 16, rotate: int = 1 << 26) -> DataFrame:
    """Encode doc_id (long) and text in ascending order of doc_id into files below folder; returns the manifest, saved: a row for each
    file, with its place in the order (part, seq)."""
    prepare(docs.sparkSession)
    store, top = opened(folder)
    store.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        done: list[dict] = []
        writer: Writer | None = None

        def close() -> None:
            done.append({"part": part, "seq": len(done), "path": path, "docs": writer.n_docs, "ids": writer.total, "bytes": writer.close()})

        for b in merged(batches):
            ids, n = code.encode(b.column("text"))
            if end is not None:
                ids, n = np.insert(ids, np.cumsum(n), end).astype("<u4"), n + 1
            key = b.column("doc_id")
            at = np.append(0, np.cumsum(n))
            lo = 0
            keys, nulls = np.asarray(pc.fill_null(key, 0)), np.asarray(key.is_null())
            while lo < b.num_rows:
                if writer is None:
                    path = f"{top}/ids-{uuid.uuid4().hex}.planes"
                    writer = Writer(store.open_output_stream(path, compression=None), bits, block)
                # as many documents as bring the file to its size
                hi = min(b.num_rows, int(np.searchsorted(at, at[lo] + rotate - writer.total)) + 1) if rotate > writer.total else lo + 1
                hi = max(hi, lo + 1)
                writer.add(keys[lo:hi], nulls[lo:hi], n[lo:hi], ids[at[lo] : at[hi]])
                lo = hi
                if writer.total >= rotate:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "place").sortWithinPartitions(F.asc_nulls_first("doc_id"), "place")
    return saved(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), "ids-manifest")


def merged(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches joined to about `most` bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with base, the number of ids in all files before. A row for each file passes one task."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32, and ids (an array) if asked for, read from the files of a manifest."""
    prepare(manifest.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if ids else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for b in batches:
            for path, base, n_docs, total in zip(*(b.column(c).to_pylist() for c in ("path", "base", "docs", "ids")), strict=True):
                with store.open_input_file(path) as source:
                    file = Reader(source, path)
                    if (file.n_docs, file.total) != (n_docs, total):
                        raise ValueError(f"{path}: {file.n_docs} documents of {file.total} ids, not {n_docs} of {total}")
                    rows, held = [], 0
                    for doc_id, at, found in file.documents():
                        rows.append((doc_id, base + at, len(found), zlib.crc32(found.tobytes()), *([found.astype(np.int64)] if ids else [])))
                        held += len(found) if ids else 1
                        if held >= 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark = manifest.sparkSession
    files = placed(manifest).repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def op11_idplanes(spark, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the files, how many they are, and their checksum, read back from the files."""
    folder = fresh_path(spark, "ids")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder), folder, ids=False)
