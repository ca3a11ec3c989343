"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are cut into pre-tokens with their positions; each distinct pre-token of the corpus is encoded
once (see ``vocabulary``), its ids go home to the blocks and take their places. A NULL text is empty
and has no ids; very long pre-tokens merge through a heap; equal rows give equal results; other
columns, whatever their names, play no part. The vocabulary is a file of ranks: its size bounds what
is broadcast.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veedor.llm.arrays import span_hashes
from veedor.llm.vocabulary import Block, Piece, answer, ask, by_bucket, deflate, inflate, pack, unpack_words

BLOCK_BYTES = 4 << 20
LONG_WORD = 256
SPACE, LETTER, NUMBER, OTHER = range(4)
# Fixed values of the split pattern: what an apostrophe at the start of a token takes along.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points))
    for name, kind in ((r"\p{White_Space}+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for run in regex.finditer(name, every):
            out[points[run.start() : run.end()]] = kind
    return out


@functools.cache
def _point_codes() -> np.ndarray:
    return np.random.default_rng(77).integers(1 << 62, size=0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pretokens(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the split pattern starts a token; ``first`` has each text's first code point and the end."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[chars]
    opens = np.zeros(n + 1, bool)  # first character of a text; n counts as one
    opens[first] = True
    begins = np.ones(n + 1, bool)  # of a run of one class
    begins[1:n] = kind[1:] != kind[:-1]
    begins |= opens
    space = kind == SPACE
    blank = np.zeros(n + 1, bool)  # after a plain blank of the same text
    blank[1:] = (chars == 0x20) & ~opens[1:]
    start = begins[:n] & (space | ~blank[:n])
    # the last white space of a run belongs to what follows, or stands alone; not at a text's end
    start |= space & begins[1:] & ~opens[1:]
    quote = np.flatnonzero((chars == 0x27) & start)
    for ending in ENDINGS:
        own = quote[quote + len(ending) < n]
        fits = np.ones(len(own), bool)
        for k, letter in enumerate(ending, 1):
            fits &= (chars[own + k] == ord(letter)) & ~opens[own + k]
        own = own[fits]
        start[own + 1] = False
        after = own + 1 + len(ending)
        start[after[after < n]] = True
    return np.flatnonzero(start)


def split(data: np.ndarray, offsets: np.ndarray) -> Piece:
    text = data.tobytes().decode()
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = (data & 0xC0) != 0x80
    first = np.concatenate(([0], np.cumsum(heads)))[offsets]
    start = pretokens(chars, first)
    end = np.append(start[1:], len(chars))
    hashes = span_hashes(_point_codes()[chars], start, end)

    def read(at: np.ndarray) -> list[bytes]:
        return [text[a:b].encode() for a, b in zip(start[at].tolist(), end[at].tolist())]

    return Piece(hashes, np.searchsorted(start, first), read)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbours of least rank merge first, leftmost on a tie."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _encode_long(word, ranks)
    none, get = len(ranks) + 256, ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over linked parts, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once merged into the one before
    before = list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if before[i] >= 0 and (rank := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (rank, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _encoder(shared):
    """mapInArrow function over buckets: a reply (lengths, ids) for every block's words."""

    def run(batches):
        ranks = shared.value
        for bucket, rows in by_bucket(batches):
            known: dict[bytes, list[int]] = {}
            for block, part in rows:
                ids, sizes = [], []
                for word in unpack_words(inflate(part)[0]):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode_word(word, ranks)
                    ids += got
                    sizes.append(len(got))
                reply = deflate((np.array(sizes, np.uint32), np.array(ids, np.uint32)))
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "reply": pa.array([reply], pa.binary())}
                )

    return run


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... of each range, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _assemble(ids: pa.Array, block: Block, replies: dict[int, bytes]) -> pa.Table:
    size, flat, base = np.zeros(len(block.bucket), np.int64), [], 0
    start = np.zeros(len(block.bucket), np.int64)
    order = np.argsort(block.bucket, kind="stable")
    edges = np.searchsorted(block.bucket[order], sorted(replies))
    for at, bucket in zip(edges, sorted(replies)):
        sizes, tokens = inflate(replies[bucket])
        own = order[at : at + len(sizes)]
        size[own] = sizes
        start[own] = base + np.cumsum(sizes, dtype=np.int64) - sizes
        flat.append(tokens)
        base += len(tokens)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    sizes = size[block.codes]
    tokens = flat[expand(start[block.codes], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes)))[block.first]
    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.astype(np.int32)))
    return pa.table({"id": ids, "ids": values})


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", finish=None, schema: str = "ids array<int>") -> DataFrame:
    """One row per document: id, ids (array of token ids). ``vocabulary``: path of a rank file, read by the driver.

    ``finish`` takes and gives Arrow tables of such rows in the task that made them; ``schema`` then
    names its columns after id.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    blocks = pack(docs, id_col, text_col, split, BLOCK_BYTES, staged=False)
    replies = ask(blocks.parts, _encoder(ranks), "block long, bucket int, reply binary")
    kind = blocks.home.schema["ids"].dataType.elementType.simpleString()
    made = (lambda *block: finish(_assemble(*block))) if finish else _assemble
    return answer(blocks.home, replies, made, f"id {kind}, {schema}")


def token_bytes(spark: SparkSession, vocabulary: str):
    """Broadcast token-byte table: all bytes end to end, and the first byte of each id."""
    ranks = load_ranks(vocabulary)
    by_id = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        by_id[rank] = word
    first = np.concatenate(([0], np.cumsum([len(w) for w in by_id])))
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(by_id), np.uint8), first))


def decode_batches(batches, shared):
    """Batches (id, ids) joined with the token-byte table: (id, ids, decoded)."""
    flat, first = shared.value
    for batch in batches:
        column = batch.column("ids")
        tokens = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        size = (first[1:] - first[:-1])[tokens]
        at = np.concatenate(([0], np.cumsum(size)))[ends]
        step = 1 << 20  # tokens at a time
        body = b"".join(flat[expand(first[tokens[k : k + step]], size[k : k + step])].tobytes() for k in range(0, len(tokens), step))
        decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(body)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), column, decoded.cast(pa.binary())], ["id", "ids", "decoded"])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """id, ids, decoded (the bytes that the ids stand for)."""
    shared = token_bytes(encoded.sparkSession, vocabulary)
    kind = encoded.schema["id"].dataType.simpleString()
    rows = encoded.select("id", "ids")
    return rows.mapInArrow(lambda b: decode_batches(b, shared), f"id {kind}, ids array<int>, decoded binary")
