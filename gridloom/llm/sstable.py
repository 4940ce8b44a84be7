"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their id: blocks of entries whose
keys are prefix-compressed, a sparse index with one line for each block, a
Bloom filter of the keys and a footer of fixed size. A lookup reads the footer,
asks the filter, finds the block by binary search in the index and scans that
block alone.

Layout (little-endian numbers, but keys, whose bytes must sort):

* block: entries, zstd-compressed, with a crc32 of the raw bytes. Entry: length
  shared with the key before, length of the rest, length of the value (varints),
  rest of the key, value. A key is the id as 8 big-endian bytes with the sign
  bit turned; a value is the ids as unsigned 16- or 32-bit integers.
* index line: first key, offset, stored length, entries, ids, crc32.
* Bloom filter: 10 bits a key, 7 probes.
* footer: offsets and lengths of index and filter, documents, ids, bytes of an
  id, magic.

Rows are dealt by ranges of ids, sorted, and each task streams its range to
files of at most about ``shard_bytes``. A file's name has the task's attempt;
the manifest, written by Spark, names the files of the attempts that counted,
so that lost executors and repeated attempts leave no trace in what is read.

Defined cases: null texts count as empty and hold only the end id; rows with a
null id have no key and are left out; rows that repeat an id are kept, in the
order of their texts; an empty table gives an empty manifest; other columns are
not stored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, file_system, parts_of, shared_dir, shuffle_partitions
from .words import WordEncoder

MAGIC = b"GLSST001"
_INDEX = struct.Struct("<8sQIIQI")
_FOOTER = struct.Struct("<QQQQQQI8s")
_BITS, _PROBES = 10, 7
MANIFEST = "path string, part int, roll int, first_id long, last_id long, docs long, ids long, bytes long"


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(_PROBES)]


class ShardWriter:
    """Streams entries, which must come in ascending order of their ids, to one file."""

    def __init__(self, stream, width: int, block_bytes: int) -> None:
        self.stream, self.width, self.block_bytes = stream, width, block_bytes
        self.press = zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.first, self.entries, self.block_ids = bytearray(), b"", b"", 0, 0
        self.offset, self.index, self.keys, self.ids = 0, [], [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if not self.entries:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.block_ids += len(ids)
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.offset += len(data)

    def flush(self) -> None:
        if self.entries:
            raw = bytes(self.block)
            stored = self.press.compress(raw)
            self.index.append(_INDEX.pack(self.first, self.offset, len(stored), self.entries, self.block_ids, zlib.crc32(raw)))
            self._put(stored)
            self.ids += self.block_ids
            self.block, self.entries, self.block_ids = bytearray(), 0, 0

    def close(self) -> None:
        self.flush()
        bits = max(64, _BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        at = np.array([p for k in self.keys for p in _probes(k, bits)], np.int64)
        np.bitwise_or.at(bloom, at >> 3, (1 << (at & 7)).astype(np.uint8))
        index_at = self.offset
        self._put(b"".join(self.index))
        bloom_at = self.offset
        self._put(struct.pack("<Q", bits) + bloom.tobytes())
        self._put(_FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.offset - bloom_at, len(self.keys), self.ids, self.width, MAGIC))
        self.stream.close()


class ShardReader:
    """Random access to one shard: what is read is the footer, the index, the filter and the blocks asked for."""

    def __init__(self, path: str) -> None:
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        footer = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        index_at, index_len, self.bloom_at, self.bloom_len, self.docs, self.ids, self.width, magic = footer
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.index = [_INDEX.unpack(line) for line in _lines(self.file.read_at(index_len, index_at))]
        self.first = [line[0] for line in self.index]
        self.bloom = b""

    def may_hold(self, doc_id: int) -> bool:
        data = self.bloom = self.bloom or self.file.read_at(self.bloom_len, self.bloom_at)
        bits = struct.unpack("<Q", data[:8])[0]
        return all(data[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key_of(doc_id), bits))

    def block(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """(id, token ids) of a block's entries."""
        _, offset, length, _, _, crc = self.index[i]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset))
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        at, key, kind = 0, b"", "<u2" if self.width == 2 else "<u4"
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield id_of(key), np.frombuffer(raw, kind, size // self.width, at)
            at += size

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Token ids of every entry with this id, found by binary search; none if the filter excludes it."""
        if not self.index or not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.index) and self.first[i] <= key:
            out += [ids for k, ids in self.block(i) if k == doc_id]
            i += 1
        return out


def _lines(data: bytes) -> list[bytes]:
    return [data[i : i + _INDEX.size] for i in range(0, len(data), _INDEX.size)]


@functools.cache
def tokenizer_encoder(path: str, match_added: bool = False) -> WordEncoder:
    """Encoder of a tokenizers file that adds no special tokens; one for each worker process.

    With ``match_added``, as is the library's default, the file's added tokens
    are found in texts; a text that holds one is encoded whole, as it may lie
    across words. Without, special tokens are encoded as any other text. Texts
    are encoded by words if the file's tokens are bytes and a space begins a
    word (byte-level, with the library's own pattern and nothing before it),
    and whole otherwise.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not match_added
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    vocabulary = tokenizer.get_vocab()
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a byte-level token has a character for each
    for token, i in vocabulary.items():
        size[i] = len(token)
    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made["normalizer"]
    special = {t["content"] for t in made["added_tokens"] if t["special"]}
    found = [t for t in added if match_added or t not in special]

    def encode(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    return WordEncoder(encode, size, (lambda text: any(t in text for t in found)) if by_words and found else None if by_words else lambda text: True, joined=not any(" " in t for t in found))


def write(
    docs: DataFrame, make_encoder: Callable[[], WordEncoder], end_id: int | None = None, doc_id: str = "doc_id", text: str = "text",
    folder: str | None = None, partitions: int | None = None, block_bytes: int = 64 << 10, shard_bytes: int = 64 << 20,
) -> DataFrame:
    """Write shards to ``folder`` (by default a new one in the shared folder); the manifest has a row for each.

    An id takes two bytes in the files if the encoder's largest and ``end_id`` fit, four otherwise.
    """
    spark = docs.sparkSession
    base = (folder or f"{shared_dir(spark)}/gridloom-shards-{uuid.uuid4().hex}").rstrip("/")
    fs, at = file_system(base)
    fs.create_dir(at)
    rows = (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        .repartitionByRange(partitions or shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = make_encoder(), TaskContext.get()
        end = np.array([] if end_id is None else [end_id], np.int32)
        width = 2 if max(len(encode.id_bytes) - 1, end_id or 0) < 1 << 16 else 4
        writer, roll, span, out = None, 0, [0, 0], []

        def close() -> None:
            nonlocal writer, roll
            if writer:
                writer.close()
                out.append({"path": name, "part": task.partitionId(), "roll": roll, "first_id": span[0], "last_id": span[1], "docs": len(writer.keys), "ids": writer.ids, "bytes": writer.offset})
                writer, roll = None, roll + 1

        def entries() -> Iterator[tuple[int, np.ndarray]]:
            for b in parts_of(batches, 2000):
                ids = encode(b.column(1))
                values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                for i, x, y in zip(b.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                    yield i, np.r_[values[x:y], end]

        for i, ids in entries():
            if writer is None:
                name = f"{base}/{task.partitionId():06d}-{roll:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
                there, path = file_system(name)
                writer, span[0] = ShardWriter(there.open_output_stream(path), width, block_bytes), i
            writer.add(i, ids)
            span[1] = i
            if writer.offset >= shard_bytes:
                close()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), *[(c, pa.int64()) for c in ("first_id", "last_id", "docs", "ids", "bytes")]]))

    return cut(rows.mapInArrow(shards, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) in the shards' order; start counts the ids of all documents before, ids are unsigned 32-bit little-endian bytes.

    The manifest has a row for each shard; only those counts are summed in one
    place. A task reads one shard block by block.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", "part", "roll", before.alias("base"))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["base"], strict=True):
                shard = ShardReader(path)
                for i in range(len(shard.index)):
                    out = []
                    for doc_id, ids in shard.block(i):
                        out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                    yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInPandas(entries, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents asked for: ids go to the shards whose range holds them, and each is searched there.

    Ids and shards meet by equal stretches of the ids between the first and the
    last, about four to a shard; a shard lies in as many as its range touches.
    """
    asked = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    shards = manifest.select("path", "first_id", "last_id")
    ends = shards.agg(F.min("first_id").alias("a"), F.max("last_id").alias("z"), F.count(F.lit(1)).alias("n")).first()
    low, stretch = float(ends["a"] or 0), max(1.0, (float(ends["z"] or 0) - float(ends["a"] or 0)) / (4 * ends["n"] + 1))
    at = lambda c: F.floor((F.col(c).cast("double") - low) / stretch)  # noqa: E731  never falls as ids grow
    there = shards.withColumn("at", F.explode(F.sequence(at("first_id"), at("last_id"))))
    inside = F.col("doc_id").between(F.col("first_id"), F.col("last_id"))
    routed = asked.withColumn("at", at("doc_id")).join(there, "at").where(inside)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shards: tuple[str | None, ShardReader | None] = (None, None)
        for b in batches:
            out = []
            for d, path in zip(b["doc_id"], b["path"], strict=True):
                if open_shards[0] != path:
                    open_shards = (path, ShardReader(path))
                out += [(d, ids.astype("<u4").tobytes()) for ids in open_shards[1].get(int(d))]
            yield pd.DataFrame(out, columns=["doc_id", "ids"])

    return routed.repartition("path").sortWithinPartitions("path").select("doc_id", "path").mapInPandas(search, "doc_id long, ids binary")
