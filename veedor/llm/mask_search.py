"""Ranked lexical search by presence masks.

Documents become blocks of postings of the terms that some item asks for. In a block, the bitmaps of an
item's terms, laid side by side, give every document its mask: which of the terms it holds. Documents
of equal mask are one group, whose best possible score is the sum of its terms' best shares in the
block. Groups are scored from the best bound down, until the next bound is under the item's last
place; then no document left can come in, and the item is done with the block. Places are kept over
all blocks of a task, so later blocks end sooner, and the tasks' places are merged at the end.

Items are taken in packs of a bounded number of bytes. Only the pack's terms and, at the end, sums over
them reach the driver, in the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veedor.llm.arrays import ALNUM, hash_texts, pieces, tidy, utf8, word_hashes, words
from veedor.llm.sums import added, sliced
from veedor.llm.tables import delete, narrow_ids
from veedor.llm.vocabulary import deflate, inflate
from veedor.runtime import stage

#: A block ends at so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Bytes of item texts that one pass over the documents looks for.
PACK_BYTES = 4 << 20
#: Documents scored at once; a larger group is scored whole.
SCORED = 256
_SALTS = 64

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class Postings(NamedTuple):
    """Where the wanted terms stand in a block, by term and document."""

    n: np.ndarray  # terms of each document, with repeats
    terms: np.ndarray  # wanted terms that occur, ascending
    first: np.ndarray  # first posting of each; one entry more than terms
    docs: np.ndarray
    counts: np.ndarray


class Item(NamedTuple):
    key: int
    item_id: object
    terms: np.ndarray  # distinct wanted terms
    repeats: np.ndarray


# --- index ---------------------------------------------------------------------------------


def _piece(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of some texts, and (text, term, count) of the wanted terms."""
    w = words(data, offsets, ALNUM)
    n = np.diff(w.first)
    h = word_hashes(w)
    at = np.searchsorted(wanted, h)
    at[at == len(wanted)] = 0
    hit = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(n)), n)[hit]
    pair, counts = np.unique(at[hit].astype(np.int64) * len(n) + doc, return_counts=True)
    return n, pair % max(1, len(n)), pair // max(1, len(n)), counts


def _indexer(wanted: np.ndarray, id_type: pa.DataType):
    def close(ids: list, parts: list) -> pa.RecordBatch:
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        n, term = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        doc = np.concatenate([p[1] + b for p, b in zip(parts, base)])
        count = np.concatenate([p[3] for p in parts])
        order = np.lexsort((doc, term))
        terms, first = np.unique(term[order], return_index=True)
        first = np.append(first, len(order))
        held = pa.concat_arrays([x.cast(id_type) for x in ids])
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array([int((n > 0).sum())], pa.int64()),
                pa.array([int(n.sum())], pa.int64()),
                pa.array([deflate((terms, np.diff(first)))], pa.binary()),
                pa.array([deflate(Postings(n, terms, first, doc[order].astype(np.int32), count[order]))], pa.binary()),
            ],
            ["ids", "n_docs", "n_terms", "df", "postings"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n, size = [], [], 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                for a in range(a, b, BLOCK_DOCS):
                    z = min(b, a + BLOCK_DOCS)
                    if n + z - a > BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield close(ids, parts)
                        ids, parts, n, size = [], [], 0, 0
                    parts.append(_piece(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], wanted))
                    ids.append(batch.column(0).slice(a, z - a))
                    n, size = n + z - a, size + int(offsets[z] - offsets[a])
        if parts:
            yield close(ids, parts)

    return run


def _document_counts(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                terms, df = inflate(packed.as_py())
                total[terms] += df
        parts = sliced(total)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    return run


# --- scoring -------------------------------------------------------------------------------


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 * n * N) div L, without leaving 64 bits on the way."""
    whole, rest = divmod(25 * n_docs, max(1, n_terms))
    if len(n) and int(n.max()) * max(rest, 1) >= 1 << 62:
        return 75 + n * whole + np.array([int(x) * rest // n_terms for x in n], np.int64)
    return 75 + n * whole + n * rest // max(1, n_terms)


def shares(p: Postings, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) of every posting."""
    m = norms(p.n, n_docs, n_terms)
    return 1_000_000_000 * p.counts // (1000 * p.counts + 12 * m[p.docs])


class Places:
    """The best documents of one item so far: highest score first, equal ones by id, NULL last."""

    def __init__(self, most: int):
        self.most, self.held = most, []

    @property
    def last(self) -> int:
        """Under this score nothing comes in any more."""
        return self.held[-1][0] if len(self.held) == self.most else 1

    def add(self, scores: np.ndarray, ids: pa.Array, docs: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.last)
        if len(good) > self.most:
            good = good[scores[good] >= np.partition(scores[good], -self.most)[-self.most]]
        if len(good):
            self.held += zip(scores[good].tolist(), ids.take(pa.array(docs[good])).to_pylist())
            self.held.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            del self.held[self.most :]


def masks(p: Postings, at: np.ndarray) -> np.ndarray:
    """Per document of the block, which of the terms ``at`` it holds: one bit each, 64 to a word."""
    out = np.zeros((len(p.n), (len(at) + 63) // 64), np.uint64)
    for j, t in enumerate(at):
        out[p.docs[p.first[t] : p.first[t + 1]], j // 64] |= np.uint64(1) << np.uint64(j % 64)
    return out


def groups(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks but the empty one, the documents ordered by mask, and each mask's first document there."""
    docs = np.flatnonzero(found.any(axis=1))
    rows = found[docs]
    order = np.lexsort(rows.T)
    docs, rows = docs[order], rows[order]
    new = np.ones(len(docs), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return rows[first], docs, np.append(first, len(docs))


def bounds(distinct: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The sum of ``best`` over the bits of each mask."""
    bits = np.unpackbits(distinct.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits[:, : len(best)].astype(np.int64) @ best


def scores_of(docs: np.ndarray, p: Postings, at: np.ndarray, factor: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Exact scores of some documents, ascending."""
    out = np.zeros(len(docs), np.int64)
    for t, f in zip(at, factor):
        lo, hi = p.first[t], p.first[t + 1]
        own = p.docs[lo:hi]
        k = np.minimum(np.searchsorted(own, docs), hi - lo - 1)
        out += np.where(own[k] == docs, f * share[lo + k], 0)
    return out


def search_block(p: Postings, share: np.ndarray, best: np.ndarray, item: Item, weights: np.ndarray, places: Places, ids: pa.Array) -> int:
    """Bring an item's places up to date with a block; how many documents were scored. ``best``: each term's largest share."""
    at = np.searchsorted(p.terms, item.terms)
    at[at == len(p.terms)] = 0
    held = p.terms[at] == item.terms
    factor = (weights[item.terms] * item.repeats)[held]
    at = at[held][factor > 0]
    factor = factor[factor > 0]
    if not len(at):
        return 0
    distinct, docs, first = groups(masks(p, at))
    bound = bounds(distinct, factor * best[at])
    order = np.argsort(-bound, kind="stable")
    sizes = np.diff(first)[order]
    upto = np.cumsum(sizes)
    g = scored = 0
    while g < len(order) and bound[order[g]] >= places.last:
        end = max(g + 1, int(np.searchsorted(upto, scored + SCORED, "right")))
        end = min(end, int(np.searchsorted(-bound[order], -places.last, "right")))
        own = np.sort(np.concatenate([docs[first[k] : first[k + 1]] for k in order[g:end]]))
        places.add(scores_of(own, p, at, factor, share), ids, own)
        scored, g = int(upto[end - 1]), end
    return scored


def _searcher(items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int, most: int, id_type: pa.DataType):
    def run(batches):
        places = [Places(most) for _ in items]
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values
                p = inflate(batch.column("postings")[k].as_py())
                if not len(p.terms):
                    continue
                share = shares(p, n_docs, n_terms)
                best = np.maximum.reduceat(share, p.first[:-1])
                for item, own in zip(items, places):
                    search_block(p, share, best, item, weights, own, ids)
        found = [(i.key, s, d) for i, own in zip(items, places) for s, d in own.held]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[2], id_type), pa.array(columns[1], pa.int64())], ["key", "doc", "score"])

    return run


# --- the operator --------------------------------------------------------------------------


def search(
    docs: DataFrame, items: DataFrame, most: int = 20, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``most`` best documents of every item, scores above 0 only.

    NULL and empty texts hold no terms: such items have no rows, such documents are in none and count for
    nothing. Every row is an item or a document of its own, whatever its id: an item id in two rows has each
    rank twice. Equal scores come by ascending id, a NULL id last. Other columns are not looked at. Without
    documents or items there are no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(narrow_ids(docs, doc_id).alias("doc"), F.col(doc_text).cast("string").alias("text"))
    kind = narrow.schema["doc"].dataType.simpleString()
    asked = stage(
        items.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")),
        "items",
    )
    n_bytes = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_packs = max(1, math.ceil(n_bytes / pack_bytes))
    found = []
    for number in range(n_packs):
        own = asked.where(F.pmod(F.xxhash64("key"), F.lit(n_packs)) == number)
        found.append(_search_pack(narrow, own, most, kind))
    best = reduce(DataFrame.unionByName, found)
    names = asked.select("key", F.col("item").alias("item_id"))
    return best.join(names, "key").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def _search_pack(docs: DataFrame, pack: DataFrame, most: int, kind: str) -> DataFrame:
    rows = pack.orderBy("key").collect()
    hashed = hash_texts([r.text or "" for r in rows], ALNUM)
    wanted = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
    items = []
    for r, h in zip(rows, hashed):
        if len(h):
            terms, repeats = np.unique(np.searchsorted(wanted, h), return_counts=True)
            items.append(Item(r.key, None, terms, repeats))
    if not items:
        return docs.sparkSession.createDataFrame([], f"key long, doc {kind}, score long, rank int")
    columns = f"ids array<{kind}>, n_docs long, n_terms long, df binary, postings binary"
    index = stage(docs.mapInArrow(tidy(_indexer(wanted, _ARROW[kind])), columns), "postings")
    whole = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    df = added(index.select("df").mapInArrow(tidy(_document_counts(len(wanted))), "slice int, counts binary"), len(wanted))
    weights = np.array([weight(whole.n, int(x)) for x in df], np.int64)
    run = tidy(_searcher(items, weights, whole.n, whole.l, most, _ARROW[kind]))
    places = index.select("ids", "postings").mapInArrow(run, f"key long, doc {kind}, score long")
    salted = places.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    best = stage(_ranked(_ranked(salted, most, "key", "salt").drop("rank", "salt"), most, "key"), "places")
    delete(docs.sparkSession, index)
    return best


def _ranked(places: DataFrame, most: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
