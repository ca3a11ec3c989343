"""Benchmark decontamination with suffix arrays over the training texts.

Every task sorts the word suffixes of a bounded shard of documents once; every suffix of every
benchmark item is then binary-searched in the shard's array. The range found for a suffix holds
all places of its window (13 words, or the whole of a shorter item), and neighbouring ranges on one
diagonal join into the longest verbatim match. Shards never meet, so nothing is shuffled. The
benchmark is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words, read one at a time.

NULL and empty texts have no words and no matches; items without words are never found; repeated
documents and items are treated one by one, items that repeat an id count once; an empty benchmark
marks nothing; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veedor.llm.arrays import ALNUM, pieces, tidy, utf8, word_hashes, words

WINDOW = 13
BLOCK_WORDS = 200_000
SHARD_BYTES = 2 << 20
#: A document is affected when at least one of so many words is hit.
AFFECTED_ONE_IN = 20


class Block(NamedTuple):
    """Benchmark items: word hashes end to end, the first word of each item, ids as strings."""

    hashes: np.ndarray
    first: np.ndarray
    ids: list[str]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Block]:
    """Items in blocks of at most ``most`` words; a longer item is a block of its own."""
    hashes, ids, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        data, offsets = utf8(pa.array([row.t], pa.large_string()))
        own = word_hashes(words(data, offsets, ALNUM))
        if ids and size + len(own) > most:
            yield _block(hashes, ids)
            hashes, ids, size = [], [], 0
        if len(own):
            hashes.append(own)
            ids.append("" if row.i is None else row.i)
            size += len(own)
    if ids:
        yield _block(hashes, ids)


def _block(hashes: list[np.ndarray], ids: list[str]) -> Block:
    return Block(np.concatenate(hashes), np.cumsum([0, *map(len, hashes)]), ids)


class SuffixArray:
    """Suffixes of ``codes`` (0 ends a document), ordered by their first ``depth`` codes."""

    def __init__(self, codes: np.ndarray, most: int, depth: int):
        n = len(codes)
        bits = max(1, int(most).bit_length())
        step = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(step):
            key <<= bits
            if k < n:
                key[: n - k] |= codes[k:]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.zeros(n + 1, np.int64)  # of a suffix: the first place of its group, from 1; past the end 0
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group + 1
        while step < depth:
            last = np.ones(n, bool)
            last[:-1] = new[1:]
            slots = np.flatnonzero(~(new & last))  # groups of more than one suffix
            if not len(slots):
                break
            at = order[slots]
            then = rank[np.minimum(at + step, n)]
            by = np.lexsort((then, group[slots]))
            at, then, own = at[by], then[by], group[slots]
            order[slots] = at
            split = np.ones(len(slots), bool)
            split[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
            new[slots] = split
            group[slots] = np.maximum.accumulate(np.where(split, slots, 0))
            rank[at] = group[slots] + 1
            step *= 2
        self.codes, self.order = np.append(codes, np.zeros(depth, codes.dtype)), order

    def ranges(self, wanted: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``wanted`` (codes, padded): the slots of suffixes that begin with it."""
        found = []
        for upper in (False, True):
            low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order), np.int64)
            while len(live := np.flatnonzero(low < high)):
                middle = (low[live] + high[live]) // 2
                at, sign, open_ = self.order[middle], np.zeros(len(live), np.int8), np.ones(len(live), bool)
                for k in range(wanted.shape[1]):
                    open_ &= k < length[live]
                    if not open_.any():
                        break
                    gap = self.codes[at + k] - wanted[live, k]
                    sign = np.where(open_ & (sign == 0), np.sign(gap), sign).astype(np.int8)
                    open_ &= sign == 0
                right = sign <= 0 if upper else sign < 0
                low[live[right]] = middle[right] + 1
                high[live[~right]] = middle[~right]
            found.append(low)
        return found[0], found[1]


class Shard:
    """Words of some documents, coded by their place among the shard's distinct words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        firsts, parts, ends = [], [], []
        at = 0
        for a, b in pieces(offsets):
            w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
            firsts.append(w.first[:-1] + at)
            parts.append(word_hashes(w))
            at += len(w.start)
        ends.append(at)
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        first = np.concatenate([*firsts, ends])
        self.n_words = np.diff(first)
        self.known, inverse = np.unique(hashes, return_inverse=True)
        # a 0 after each document keeps suffixes from running into the next one
        self.first = first + np.arange(len(first))
        stream = np.zeros(len(hashes) + len(self.n_words), np.int64)
        inside = np.ones(len(stream), bool)
        inside[self.first[1:] - 1] = False
        stream[inside] = inverse + 1
        self.array = SuffixArray(stream, len(self.known), depth)
        self.length = len(stream)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's codes of test words; -1 for words it does not have."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, -1)

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place of every window: place in the shard, item, word of the item, window length."""
        n_items = np.diff(block.first)
        item = np.repeat(np.arange(len(n_items)), n_items)
        word = np.arange(len(item)) - block.first[:-1][item]
        length = np.minimum(WINDOW, n_items[item])
        whole = word + length <= n_items[item]
        item, word, length = item[whole], word[whole], length[whole]
        codes = np.append(self.codes(block.hashes), np.zeros(WINDOW, np.int64))
        known = np.concatenate(([0], np.cumsum(codes >= 0)))
        at = block.first[:-1][item] + word
        able = known[at + length] - known[at] == length
        item, word, length, at = item[able], word[able], length[able], at[able]
        if not len(item) or not self.length:
            return (np.zeros(0, np.int64),) * 4
        low, high = self.array.ranges(codes[at[:, None] + np.arange(WINDOW)], length)
        count = high - low
        slot = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.array.order[slot], np.repeat(item, count), np.repeat(word, count), np.repeat(length, count)


def _longest(place, item, word, length):
    """Windows that follow one another on a diagonal, joined: place, item, word, length of each match."""
    by = np.lexsort((word, place - word, item))
    place, item, word, length = place[by], item[by], word[by], length[by]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - place[:-1] != 1) | (word[1:] - word[:-1] != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(item)) - 1
    return place[head], item[head], word[head], word[tail] + length[tail] - word[head]


def _scan(broadcasts: list, report: str):
    """mapInArrow function; ``report`` is "documents" (one row each) or "matches"."""

    def shards(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets, SHARD_BYTES):
                shard = Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WINDOW)
                yield ids.slice(a, b - a), shard

    def found(shard):
        for block in broadcasts:
            block = block.value
            yield block, shard.search(block)

    def documents(batches):
        for ids, shard in shards(batches):
            edges = np.zeros(shard.length + 1, np.int64)
            items: dict[int, set[str]] = {}
            for block, (place, item, _, length) in found(shard):
                np.add.at(edges, place, 1)
                np.add.at(edges, place + length, -1)
                doc = np.searchsorted(shard.first, place, "right") - 1
                for pair in np.unique(doc * len(block.ids) + item):
                    items.setdefault(int(pair) // len(block.ids), set()).add(block.ids[int(pair) % len(block.ids)])
            hit = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
            n_hit = hit[shard.first[1:]] - hit[shard.first[:-1]]
            names = [sorted(items.get(k, ())) for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(shard.n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                ],
                ["id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    def matches(batches):
        for ids, shard in shards(batches):
            for block, hits in found(shard):
                place, item, word, length = _longest(*hits)
                doc = np.searchsorted(shard.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc)),
                        pa.array([block.ids[i] for i in item], pa.string()),
                        pa.array(place - shard.first[doc], pa.int64()),
                        pa.array(word, pa.int64()),
                        pa.array(length, pa.int64()),
                    ],
                    ["id", "item_id", "doc_word", "item_word", "n_words"],
                )

    return documents if report == "documents" else matches


def _run(docs: DataFrame, benchmark: DataFrame, report: str, schema: str, columns: tuple[str, str, str, str]) -> DataFrame:
    id_col, text_col, item_col, item_text = columns
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in benchmark_blocks(benchmark, item_col, item_text, BLOCK_WORDS)]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(_scan(blocks, report)), f"id {narrow.schema['id'].dataType.simpleString()}, {schema}")


COLUMNS = ("doc_id", "text", "item_id", "text")


def contamination(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated.

    ``columns`` names the documents' id and text and the benchmark's id and text.
    """
    rows = _run(docs, benchmark, "documents", "n_words long, n_hit long, n_items long, items_sha256 string", columns)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (AFFECTED_ONE_IN * F.col("n_hit") >= F.col("n_words")))


def longest_matches(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """Longest verbatim matches: id, item_id, doc_word and item_word (where each begins), n_words."""
    return _run(docs, benchmark, "matches", "item_id string, doc_word long, item_word long, n_words long", columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """The documents that are not affected, with all their columns; rows are judged one by one."""
    rows = docs.select(F.struct("*").alias("row"), F.col(columns[1]).alias("text"))
    item_col, item_text = columns[2:]
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in benchmark_blocks(benchmark, item_col, item_text, BLOCK_WORDS)]
    scan = _scan(blocks, "documents")

    def clean(batches):
        for batch in batches:
            for out in scan([pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(1)], ["id", "text"])]):
                n_hit, n_words = out.column("n_hit").to_numpy(), out.column("n_words").to_numpy()
                keep = ~((n_hit > 0) & (AFFECTED_ONE_IN * n_hit >= n_words))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(out.column("id").filter(pa.array(keep)))], ["row"])

    kept = rows.mapInArrow(tidy(clean), rows.select("row").schema)
    return kept.select("row.*")
