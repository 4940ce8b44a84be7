"""Byte-level BPE encoding and decoding, by overlapping chunks.

A long text is cut into chunks of ``chunk`` code points that overlap the next
by ``overlap``. Chunks are pre-tokenised in parallel, each from its own start.
A match of the pattern depends only on what follows its start, so once two
neighbours have a boundary in common they agree from there on: the first common
boundary in the overlap is where their pieces are stitched. Each chunk then
encodes the pieces between its two seams. A document with a pair of chunks that
never agree in their overlap (a match longer than it) is encoded in one go.
Texts of one chunk have no seam and take no shuffle.

Decoding concatenates the bytes of the ids.

Seams lie behind something other than white space: there a piece ends whatever
follows it, so that the text between two seams is encoded as it stands.

Defined cases: null texts count as empty and have no ids; repeated rows and
null ids get a row each; empty tables give empty results; results have the id
column, ``ids`` and columns named to be carried, so that others never clash.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_of
from .words import WordEncoder, lists

#: Of a match that ends nearer than this to a cut, more text could change the end: contractions have three code points.
_MARGIN = 2
#: A task has a worker beside the JVM's share of an executor: what one encodes at a time and the words it keeps take about 70 MB less than at twice these parts and three times these words, in nearly the same time.
_ROWS, _PART_BYTES, _KEPT = 1000, 4 << 20, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def rank_encoder(path: str, pattern: str) -> WordEncoder:
    """One for each worker process."""
    ranks = read_ranks(path)
    merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = list(map(len, ranks))
    return WordEncoder(lambda text: np.array(merges.encode_ordinary(text), np.int32), size, part_bytes=_PART_BYTES, kept=_KEPT)


@functools.cache
def rank_decoder(path: str) -> Callable[[pa.ListArray], pa.BinaryArray]:
    """Bytes of lists of ids: each id's bytes, taken from one table."""
    ranks = read_ranks(path)
    by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    tokens = pa.array(by_id, pa.binary())

    def decoded(ids: pa.ListArray) -> pa.BinaryArray:
        size = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        taken = tokens.take(ids.flatten())  # flatten leaves out what null lists have
        if taken.null_count:
            raise ValueError("an id stands for no bytes")
        at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :][np.r_[0, np.cumsum(size)]]
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), taken.buffers()[2] or pa.py_buffer(b"")])

    return decoded


def boundaries(text: str, pieces, last: bool) -> list[int]:
    """Starts of pieces behind something other than white space that no text beyond a cut could change, and the end of a text's last chunk."""
    out = [0]
    for m in pieces.finditer(text):
        if not last and m.end() > len(text) - _MARGIN:
            break
        if not text[m.end() - 1].isspace() or m.end() == len(text):
            out.append(m.end())
    return out


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = 32_768, overlap: int = 512, carry: Sequence[str] = (),
    decoded: str | None = None,
) -> DataFrame:
    """(doc_id, ``carry`` columns, ids array<int>) of every row, as encoding each match of the pattern separately gives.

    ``decoded`` names a further column, of the bytes that the ids decode to:
    what decode() adds, worked out beside the encoding where one task does both.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *carry)
    schema = f"doc_id {kind}{more}, ids array<int>{f', {decoded} binary' if decoded else ''}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(ranks_path, pattern)
        for b in parts_of(batches, _ROWS):
            ids = enc(b.column("text"))
            back = {decoded: rank_decoder(ranks_path)(ids)} if decoded else {}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("doc_id", *carry)} | {"ids": ids} | back)

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, schema)

    # long texts are written once, as their chunks are read several times; repeated rows are encoded once; the hash stands for the text in keys
    long = cut(
        rows.where(F.length("text") > chunk)
        .groupBy("doc_id", "text", *carry)
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("doc_id", F.xxhash64("text").alias("h"), "copies", *carry, "text")
    )
    key = ["doc_id", "h", "copies", *carry]
    chunks = (
        long.select(*key, "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / chunk).cast("int") - 1)).alias("k"))
        .select(*key, "k", (F.length("text") <= (F.col("k") + 1) * chunk).alias("last"), F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("part"))
        .repartition(*key, "k")
    )
    key_schema = f"doc_id {kind}, h long, copies long{more}, k int"

    def seams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = regex.compile(pattern)
        for b in batches:
            head, tail = [], []
            for k, last, part in zip(b["k"], b["last"], b["part"], strict=True):
                at = boundaries(part, pieces, last)
                head.append([int(k) * chunk + p for p in at if p <= overlap])
                tail.append([] if last else [int(k) * chunk + p for p in at if p >= chunk])
            yield b[[*key, "k", "last"]].assign(head=head, tail=tail)

    of_doc = Window.partitionBy(*key)
    in_order = of_doc.orderBy("k")
    stitched = (
        chunks.mapInPandas(seams, f"{key_schema}, last boolean, head array<int>, tail array<int>")
        .withColumn("to", F.when(~F.col("last"), F.array_min(F.array_intersect("tail", F.lead("head").over(in_order)))))
        .withColumn("from", F.when(F.col("k") == 0, 0).otherwise(F.lag("to").over(in_order)))
        .withColumn("apart", F.max((~F.col("last") & F.col("to").isNull()).cast("int")).over(of_doc) == 1)
        .select(*key, "k", "from", "to", "apart")
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "k")]
    pieces_of = (
        chunks.alias("a")
        .join(stitched.alias("b"), functools.reduce(lambda x, y: x & y, same))
        .where("not apart")
        .select(*[F.col(f"a.{c}").alias(c) for c in (*key, "k")], F.expr(f"from - a.k * {chunk}").alias("start"), F.expr(f"coalesce(to - a.k * {chunk}, length(part))").alias("stop"), "part")
    )

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(ranks_path, pattern)
        for b in parts_of(batches, _ROWS):
            spans = zip(*(b.column(c).to_pylist() for c in ("part", "start", "stop")), strict=True)
            ids = enc(pa.array([part[start:stop] for part, start, stop in spans], pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*key, "k")], ids], names=[*key, "k", "ids"])

    joined = (
        pieces_of.mapInArrow(between, f"{key_schema}, ids array<int>")
        .groupBy(*key)
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
    apart = stitched.where("apart").select(*key).distinct().alias("b")
    same_text = functools.reduce(lambda x, y: x & y, same[:-1])
    in_one = long.alias("a").join(apart, same_text, "left_semi")

    def in_one_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(ranks_path, pattern)
        for b in parts_of(batches, 1):
            ids = lists([enc.encode(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in key], ids], names=[*key, "ids"])

    rest = in_one.select(*key, "text").mapInArrow(in_one_go, f"doc_id {kind}, h long, copies long{more}, ids array<int>")
    each = joined.unionByName(rest).select("doc_id", *carry, "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *carry, "ids")
    return short.unionByName(decode(each, ranks_path, out=decoded) if decoded else each)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Add the bytes that the ids stand for: those of each id, one after the other. Null ids decode to no bytes."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.concat_arrays([rank_decoder(ranks_path)(x) for x in parts_of([b], _ROWS)])

    return df.withColumn(out, of(F.col(ids)))
