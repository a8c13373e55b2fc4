"""Token-id files: blocks of ids turned into bit or byte planes, compressed plane by plane.

A shard holds the ids of a run of documents in ascending doc_id order. Ids are cut into
blocks of a fixed size; a block is transposed (all lowest bytes together, then the next, or
bit by bit) and each plane compressed with zstandard, so the nearly constant high planes
cost next to nothing. Layout, all integers little-endian:

    "TIDEIDS1" | planes of block 0 | planes of block 1 | ... | chunk index | document index | trailer

The chunk index has, for each block, the first id's place in the shard, the number of ids,
the file offset and the compressed length of each plane. The document index has doc_id, a
null flag and the number of ids of each document. Both are zstandard frames. The trailer has the
offsets and lengths of both, block size, plane width, counts and a CRC-32 of the indexes.

A task writes under a name of its own and renames when complete, so a lost executor or a
second attempt leaves no half file. Memory is one block and the indexes. Rows of equal
doc_id follow a hash of the text, then the text, and may be dealt over shards; null doc_ids come first; repeated
rows are documents of their own; null text counts as empty; a very long text spans blocks; an empty
table makes no shard. Extra columns are not read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text, worker_state
from .words import PieceIds, byte_letters

MAGIC = b"TIDEIDS1"
TRAILER = struct.Struct("<QQQQIIQQI8s")
BLOCK_IDS = 1 << 16
BUFFER_CHARS = 6_000_000


# ---- planes ---------------------------------------------------------------------------


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, plane_bits: int) -> np.ndarray:
    if plane_bits == 8:
        raw = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.empty((n, 32), np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


# ---- one shard ------------------------------------------------------------------------


class ShardWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, out, plane_bits: int = 8, block_ids: int = BLOCK_IDS, level: int = 1):
        if plane_bits not in (1, 8):
            raise ValueError("plane_bits is 1 or 8")
        self.out, self.plane_bits, self.block_ids = out, plane_bits, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, int(doc_id is None), len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for lo in range(0, end, self.block_ids):
            block = ids[lo : min(lo + self.block_ids, end)]
            planes = [self.zip.compress(p) for p in to_planes(block, self.plane_bits)]
            self.chunks.append([self.n_ids, len(block), self.at, *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            self.n_ids += len(block)
        self.waiting = [ids[end:]]
        self.n_waiting = len(ids) - end

    def close(self) -> None:
        self._flush(True)
        chunks = self.zip.compress(np.array(self.chunks, "<i8").tobytes())
        docs = self.zip.compress(np.array(self.docs, "<i8").tobytes())
        self.out.write(chunks)
        self.out.write(docs)
        crc = zlib.crc32(docs, zlib.crc32(chunks))
        self.out.write(TRAILER.pack(self.at, len(chunks), self.at + len(chunks), len(docs), self.block_ids, self.plane_bits, len(self.docs), self.n_ids, crc, MAGIC))


class ShardReader:
    """Random access to a shard: `block(k)` reads one chunk, `documents()` streams them all."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - TRAILER.size)
        c_at, c_len, d_at, d_len, self.block_ids, self.plane_bits, self.n_docs, self.n_ids, crc, magic = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(c_at)
        chunks, docs = source.read(c_len), source.read(d_len)
        if magic != MAGIC or zlib.crc32(docs, zlib.crc32(chunks)) != crc:
            raise ValueError("not a complete token-id shard")
        unzip = zstandard.ZstdDecompressor()
        self.chunks = np.frombuffer(unzip.decompress(chunks), "<i8").reshape(-1, 3 + 32 // self.plane_bits)
        self.docs = np.frombuffer(unzip.decompress(docs), "<i8").reshape(-1, 3)
        self.unzip = unzip

    def block(self, k: int) -> np.ndarray:
        _, n, at, *lengths = self.chunks[k].tolist()
        self.source.seek(at)
        planes = [self.unzip.decompress(self.source.read(x)) for x in lengths]
        return from_planes(planes, n, self.plane_bits)

    def documents(self):
        """(doc_id or None, place of its first id in the shard, its ids), one block in memory besides the document."""
        k, block, used, place = 0, np.zeros(0, "<u4"), 0, 0
        for doc_id, null, n in self.docs.tolist():
            parts, need = [], n
            while need:
                if used == len(block):
                    block, used, k = self.block(k), 0, k + 1
                got = min(need, len(block) - used)
                parts.append(block[used : used + got])
                used, need = used + got, need - got
            yield None if null else doc_id, place, np.concatenate(parts) if parts else block[:0]
            place += n


# ---- Spark ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenFiles:
    """A written set: the shards in order, each with its number of ids and documents."""

    uri: str
    shards: tuple[tuple[str, int, int], ...]


def _worker(path: str) -> PieceIds:
    """One encoder per worker process; its memory of pieces outlives a task."""

    def make() -> PieceIds:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return PieceIds(tokenizer, library_words(tokenizer))

    return worker_state(("library", path), make)


def library_words(tokenizer):
    """Words to ids by the library's own model: many words in one call, cut at the word-end ids."""
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    letters = byte_letters()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelled = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8", "surrogateescape")]) for w in words]
        ids = np.array(plain.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer's words do not end where expected")
        return ids, np.diff(cuts, prepend=0)

    return encode


def write_token_files(docs: DataFrame, uri: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", plane_bits: int = 8, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Encode with the tokenizer file at `path`, close each document with `end_id`, write shards under `uri`.

    Documents are dealt by ranges of doc_id, so shard order is id order. `uri` is any folder
    that pyarrow.fs opens (file, hdfs, s3, gs) and all executors share.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    # the hash splits many rows of one id over tasks
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        worker = _worker(path)
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:07d}.tidm"
        own = posixpath.join(folder, f"_{name}.{uuid.uuid4().hex}")
        end = np.array([end_id], np.uint32)
        writer, out = None, None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi, done = lo, 0
                while hi < batch.num_rows and (hi == lo or done + sizes[hi] <= BUFFER_CHARS):
                    done += sizes[hi]
                    hi += 1
                if writer is None:
                    out = store.open_output_stream(own)
                    writer = ShardWriter(out, plane_bits, block_ids)
                for d, got in zip(ids[lo:hi], worker.encode(texts[lo:hi].to_pylist())[0]):
                    writer.add(d, np.concatenate((got, end)))
                lo = hi
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, posixpath.join(folder, name))
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_ids": [writer.n_ids], "n_docs": [len(writer.docs)]})

    listed = rows.mapInArrow(run, "part long, name string, n_ids long, n_docs long").collect()  # one row for each shard
    return TokenFiles(uri, tuple((r.name, r.n_ids, r.n_docs) for r in sorted(listed)))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids): `start` counts the ids of all documents before; ids are little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files.shards:
        return spark.createDataFrame([], schema)
    before, rows = 0, []
    for name, n, _ in files.shards:
        rows.append((name, before))
        before += n
    uri = files.uri

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                at = posixpath.join(folder, name)
                with store.open_input_file(at) as source:
                    out, size = [], 0
                    for doc, place, ids in ShardReader(source, source.size()).documents():
                        out.append((doc, base + place, len(ids), ids.tobytes()))
                        size += len(out[-1][3])
                        if size > 8_000_000:
                            yield _batch(out)
                            out, size = [], 0
                    if out:
                        yield _batch(out)

    listed = spark.createDataFrame(rows, "name string, base long").repartition(len(rows))
    return listed.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
