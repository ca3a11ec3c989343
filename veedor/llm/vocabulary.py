"""Global look-ups of distinct words for documents that stay where they are.

``pack`` turns each run of documents (a block of a few MB) into codes of its own distinct words and
deals those words, packed, to buckets by their hash. ``ask`` brings each bucket together, so that
every distinct word of the corpus is handled once, in one place; ``answer`` sends the results home
to the blocks, where the codes put them back at every position. A word of which half the corpus
consists travels once per block, so no word makes a hot key; what is shuffled grows with the
distinct words of the blocks, not with the tokens.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veedor.llm.arrays import pieces, tidy, utf8
from veedor.runtime import stage


class Piece(NamedTuple):
    """Tokens of some texts: their hashes, the first token of each text, and a way to their bytes."""

    hashes: np.ndarray
    first: np.ndarray
    read: Callable[[np.ndarray], list[bytes]]


#: (bytes, offsets of the texts) -> Piece
Splitter = Callable[[np.ndarray, np.ndarray], Piece]


def deflate(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def inflate(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def pack_words(found: list[bytes]) -> tuple[bytes, bytes]:
    return np.array([len(x) for x in found], np.uint32).tobytes(), b"".join(found)


def unpack_words(packed: tuple[bytes, bytes]) -> list[bytes]:
    end = np.cumsum(np.frombuffer(packed[0], np.uint32), dtype=np.int64)
    start = np.concatenate(([0], end[:-1])) if len(end) else end
    body = packed[1]
    return [body[a:b] for a, b in zip(start.tolist(), end.tolist())]


def _planes(codes: np.ndarray) -> list[bytes]:
    """The four bytes of every code, apart: the upper ones are nearly all 0 and compress well."""
    return [codes.astype("<u4").view(np.uint8)[k::4].tobytes() for k in range(4)]


def _codes(planes: list[bytes]) -> np.ndarray:
    out = np.empty((len(planes[0]), 4), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.frombuffer(plane, np.uint8)
    return out.view("<u4").ravel().astype(np.int64)


class Block(NamedTuple):
    """Codes of all tokens, first token of each document, bucket of each code."""

    codes: np.ndarray
    first: np.ndarray
    bucket: np.ndarray


def open_block(data: bytes) -> Block:
    planes, first, bucket = inflate(data)
    return Block(_codes(planes), first, bucket)


def block_key(number: int, known: np.ndarray) -> int:
    """Partition, number within it, and a check sum of the block's words."""
    return (TaskContext.get().partitionId() << 44) | (number << 24) | int(np.bitwise_xor.reduce(known) & np.uint64(0xFFFFFF) if len(known) else 0)


def _packer(split: Splitter, block_bytes: int, n_buckets: int, counted, id_type: pa.DataType, want: set[str]):
    def close(number, ids, parts) -> pa.RecordBatch:
        hashes = np.concatenate([p.hashes for p in parts])
        first = np.cumsum(np.concatenate([[0], *(np.diff(p.first) for p in parts)]))
        ids = pa.concat_arrays(ids)
        known, at, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        by = np.argsort(-count, kind="stable")  # frequent words get small codes
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        bucket = (known[by] % np.uint64(n_buckets)).astype(np.uint32)
        at, text, base = at[by], np.empty(len(by), object), 0
        for p in parts if "parts" in want else ():
            own = np.flatnonzero((at >= base) & (at < base + len(p.hashes)))
            text[own] = p.read(at[own] - base)
            base += len(p.hashes)
        weight = counted(ids, first, place[inverse], len(by)) if counted else None
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        dealt = []
        for b in np.flatnonzero(np.diff(edges)) if "parts" in want else ():
            own = order[edges[b] : edges[b + 1]]
            extra = None if weight is None else weight[own]
            dealt.append({"bucket": int(b), "part": deflate((pack_words(list(text[own])), known[by][own] if counted else None, extra))})
        payload = deflate((_planes(place[inverse]), first, bucket)) if "payload" in want else None
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block_key(number, known)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(id_type)),
                pa.array([payload], pa.binary()),
                pa.array([dealt], pa.list_(pa.struct([("bucket", pa.int32()), ("part", pa.binary())]))),
            ],
            ["block", "ids", "payload", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, parts = 0, 0, [], []
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                parts.append(split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                ids.append(batch.column(0).slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                if size >= block_bytes:
                    yield close(number, ids, parts)
                    number, size, ids, parts = number + 1, 0, [], []
        if parts:
            yield close(number, ids, parts)

    return run


class Packed(NamedTuple):
    """``parts``: block, parts (one per bucket that has words). ``home``: block, ids, payload."""

    parts: DataFrame
    home: DataFrame


def pack(docs: DataFrame, id_col: str, text_col: str, split: Splitter, block_bytes: int, counted=None, staged: bool = True) -> Packed:
    """Blocks of documents.

    ``counted(ids, first, codes, n)`` may give a weight per code, which travels with the words.
    ``staged=False`` reads the documents twice instead of writing the blocks: half the disk for twice
    the splitting. The table must then read the same both times, as files do; a check sum in the
    block's key turns a difference into an error.
    """
    n_buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.typeName()
    if kind not in _ARROW:
        narrow, kind = narrow.withColumn("id", F.col("id").cast("string")), "string"
    spark_type = {"long": "bigint", "integer": "int"}.get(kind, kind)
    schema = f"block long, ids array<{spark_type}>, payload binary, parts array<struct<bucket: int, part: binary>>"
    made = lambda *want: narrow.mapInArrow(tidy(_packer(split, block_bytes, n_buckets, counted, _ARROW[kind], {*want})), schema)
    if staged:
        blocks = stage(made("parts", "payload"), "word-blocks")
        return Packed(blocks.select("block", "parts"), blocks.select("block", "ids", "payload"))
    return Packed(made("parts").select("block", "parts"), made("payload").select("block", "ids", "payload"))


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}


def ask(parts: DataFrame, handle, schema: str) -> DataFrame:
    """``handle`` gets the Arrow batches (block, bucket, part) of whole buckets, one bucket after another."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select("block", F.explode("parts").alias("p")).select("block", "p.bucket", "p.part")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(tidy(handle), schema)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, rows of (block, part)); the rows of a bucket must be read before the next is asked for."""
    rows = ((b["bucket"], b["block"], b["part"]) for batch in batches for b in batch.to_pylist())
    held = next(rows, None)
    while held is not None:
        bucket = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == bucket:
                yield held[1], held[2]
                held = next(rows, None)

        yield bucket, own()


def answer_blocks(home: DataFrame, replies: DataFrame, assemble, schema: str) -> DataFrame:
    """``assemble(row, {bucket: reply})`` gives the Arrow table of a block; ``row`` has its other columns."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("the documents read differently the second time: stage them first")
        got = dict(zip(right.column("bucket").to_pylist(), right.column("reply").to_pylist()))
        return assemble(left.to_batches()[0], got)

    return home.groupBy("block").cogroup(replies.select("block", "bucket", "reply").groupBy("block")).applyInArrow(run, schema)


def answer(home: DataFrame, replies: DataFrame, assemble, schema: str) -> DataFrame:
    """``assemble(ids, Block, {bucket: reply})`` gives the Arrow table of a block's documents."""

    def run(row, got):
        block = open_block(row.column("payload")[0].as_py())
        if len(np.unique(block.bucket)) != len(got):
            raise RuntimeError("the documents read differently the second time: stage them first")
        return assemble(row.column("ids").flatten(), block, got)

    return answer_blocks(home, replies, run, schema)
