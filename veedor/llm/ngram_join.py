"""Jaccard join of word n-gram sets by vertical partitioning.

A global order of all n-grams, rare ones first, is taken from counts over every document. Two sets
that are similar enough share some of the first n-grams of each (its prefix), the more so the more
equal their sizes are, and the rarest one they share stands early in both; that gives the candidates.
``links`` keeps their number linear in hot groups. To verify a pair, the order is cut into fragments;
each set falls apart into one segment per fragment, overlaps are counted fragment by fragment, and
summed per pair.

Documents with equal sets are one node from the start, so copies never meet as pairs. A node is a
64-bit hash of its set and n-grams are 64-bit hashes: with 10^9 different sets, two of them meet
with a probability of about 0.03. Overlaps are counted exactly from the hashes.

NULL and empty texts have an empty set and link with nothing; a text of fewer than ``WORDS`` words
is one n-gram; rows that repeat an id or a text are kept apart in the result; other columns,
whatever their names, play no part in ``components_of`` and stay as they are in ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veedor.llm.arrays import NON_SPACE, mix, pieces, tidy, utf8, window_hashes, word_hashes, words
from veedor.llm.links import components, leftover_pairs, small
from veedor.llm.sums import SLICES, added, sliced
from veedor.llm.vocabulary import _codes, _planes, answer_blocks, ask, block_key, by_bucket, deflate, inflate
from veedor.runtime import stage

WORDS = 5
#: Least similarity in hundredths.
PERCENT = 75
FRAGMENTS = 8
BLOCK_BYTES = 8 << 20
#: Counters for the global order; the order is exact for any counts, better counts only prune more.
SKETCH_BITS = 20


def gram_sets(data: np.ndarray, offsets: np.ndarray):
    """The set of each text as sorted hashes."""
    for a, b in pieces(offsets):
        w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NON_SPACE)
        h = word_hashes(w)
        grams = window_hashes(h, WORDS)
        for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if hi - lo >= WORDS:
                yield np.unique(grams[lo : hi - WORDS + 1])
            elif hi > lo:
                yield window_hashes(h[lo:hi], hi - lo)
            else:
                yield h[:0]


def node_of(grams: np.ndarray) -> int:
    """One number for the whole set, as a signed 64-bit integer."""
    total = np.array([len(grams), np.bitwise_xor.reduce(grams), (grams * mix(grams)).sum(dtype=np.uint64)], np.uint64)
    return int(window_hashes(total, 3).view(np.int64)[0])


def prefix_size(n: int) -> int:
    """So many first n-grams of a set of n that any similar set shares one of them."""
    return n - -(-n * PERCENT // 100) + 1


def _measure(batches):
    """Rows (id, n, node, NULL, NULL), and at the end the task's counters: (NULL, NULL, NULL, slice, counts)."""
    counts, schema = np.zeros(1 << SKETCH_BITS, np.int64), None
    for batch in batches:
        ids = batch.column(0)
        data, offsets = utf8(batch.column(1))
        sizes, nodes, held, n = [], [], [], 0
        for grams in gram_sets(data, offsets):
            sizes.append(len(grams))
            nodes.append(node_of(grams) if len(grams) else None)
            held.append(grams)
            n += len(grams)
            if n >= len(counts):
                counts += _counted(held)
                held, n = [], 0
        counts += _counted(held)
        schema = ids.type
        yield _measured(ids, sizes, nodes, [None] * len(sizes), [None] * len(sizes))
    if schema is not None:
        parts = sliced(counts)
        nothing = [None] * SLICES
        yield _measured(pa.nulls(SLICES, schema), nothing, nothing, list(range(SLICES)), parts)


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    grams = np.concatenate([np.zeros(0, np.uint64), *sets])
    return np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)


def _measured(ids, sizes, nodes, slices, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(slices, pa.int32()), pa.array(parts, pa.binary())],
        ["id", "n", "node", "slice", "counts"],
    )


class Order:
    """Global order of n-grams: by how often their counter was met, then by hash; cut into fragments."""

    def __init__(self, counts: np.ndarray):
        by = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), np.uint64)
        self.rank[by] = np.arange(len(counts), dtype=np.uint64)
        share = np.cumsum(counts[by]) / max(1, counts.sum())
        self.fragment = np.empty(len(counts), np.int8)
        self.fragment[by] = np.minimum((share * FRAGMENTS).astype(np.int8), FRAGMENTS - 1)

    def key(self, grams: np.ndarray) -> np.ndarray:
        slot = (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        return (self.rank[slot] << np.uint64(64 - SKETCH_BITS)) | (grams & np.uint64((1 << (64 - SKETCH_BITS)) - 1))

    def prefix(self, grams: np.ndarray) -> np.ndarray:
        """The first n-grams of the set, in no order."""
        size = prefix_size(len(grams))
        return grams[np.argpartition(self.key(grams), size - 1)[:size]]


def _prefix_packer(shared, n_buckets: int):
    """Blocks of prefixes: codes stay in the payload, the distinct n-grams go to buckets (32 bits of each).

    Two n-grams that agree in bucket and 32 bits count as one here: that only adds candidates.
    """

    def close(number, nodes, prefixes):
        nodes, keep = np.unique(np.array(nodes, np.int64), return_index=True)
        prefixes = [prefixes[k] for k in keep]
        first = np.cumsum([0, *map(len, prefixes)])
        grams = np.concatenate(prefixes)
        spot = ((grams >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF))
        known, inverse, count = np.unique(spot, return_inverse=True, return_counts=True)
        bucket = (known >> np.uint64(32)).astype(np.int64)
        low = (known & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
        dealt = [
            {"bucket": int(b), "part": deflate((low[edges[b] : edges[b + 1]], np.packbits(count[edges[b] : edges[b + 1]] > 1)))}
            for b in np.flatnonzero(np.diff(edges))
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block_key(number, known)], pa.int64()),
                pa.array([deflate((nodes, first, _planes(inverse), edges, known))], pa.binary()),
                pa.array([dealt], pa.list_(pa.struct([("bucket", pa.int32()), ("part", pa.binary())]))),
            ],
            ["block", "payload", "parts"],
        )

    def run(batches):
        order = shared.value
        number, size, nodes, prefixes = 0, 0, [], []
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for k, grams in enumerate(gram_sets(data, offsets)):
                if len(grams):
                    nodes.append(node_of(grams))
                    prefixes.append(order.prefix(grams))
                size += int(offsets[k + 1] - offsets[k])
                if size >= BLOCK_BYTES and nodes:
                    yield close(number, nodes, prefixes)
                    number, size, nodes, prefixes = number + 1, 0, [], []
        if nodes:
            yield close(number, nodes, prefixes)

    return run


def _find_shared(batches):
    """For each block's n-grams of a bucket: a bit that says whether another document has it too."""
    for bucket, rows in by_bucket(batches):
        blocks, parts = [], []
        for block, part in rows:
            blocks.append(block)
            parts.append(inflate(part))
        low = np.concatenate([x for x, _ in parts])
        multiple = np.concatenate([np.unpackbits(bits, count=len(x)) for x, bits in parts])
        _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
        again = (count > 1) | (np.bincount(inverse, multiple) > 0)
        ends = np.cumsum([len(x) for x, _ in parts])
        replies = [deflate(np.packbits(bits)) for bits in np.split(again[inverse], ends[:-1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array(replies, pa.binary())], ["block", "bucket", "reply"]
        )


def _post(row: pa.RecordBatch, replies: dict[int, bytes]) -> pa.Table:
    """Rows (key, node) of a block for the n-grams that others have as well."""
    nodes, first, planes, edges, known = inflate(row.column("payload")[0].as_py())
    again = np.zeros(len(known), bool)
    for bucket, reply in replies.items():
        lo, hi = edges[bucket], edges[bucket + 1]
        again[lo:hi] = np.unpackbits(inflate(reply), count=hi - lo)
    codes = _codes(planes)
    own = np.flatnonzero(again[codes])
    node = nodes[np.searchsorted(first, own, "right") - 1]
    return pa.table({"key": pa.array(known[codes[own]].view(np.int64)), "node": pa.array(node)})


def _segments(shared):
    """(node, fragment, grams) rows of the texts whose set is the node they were looked up for."""

    def run(batches):
        order = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            wanted, nodes, fragments, parts, n = batch.column(0).to_pylist(), [], [], [], 0
            for node, grams in zip(wanted, gram_sets(data, offsets)):
                if not len(grams) or node_of(grams) != node:
                    continue
                own = order.fragment[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                by = np.argsort(own, kind="stable")
                edges = np.searchsorted(own[by], np.arange(FRAGMENTS + 1))
                for f in np.flatnonzero(np.diff(edges)):
                    nodes.append(node)
                    fragments.append(int(f))
                    parts.append(grams[by[edges[f] : edges[f + 1]]].view(np.int64))
                    n += len(parts[-1])
                if n > 1 << 18:
                    yield _segment_rows(nodes, fragments, parts)
                    nodes, fragments, parts, n = [], [], [], 0
            if nodes:
                yield _segment_rows(nodes, fragments, parts)

    return run


def _segment_rows(nodes, fragments, parts) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)))],
        ["node", "fragment", "grams"],
    )


class Joiner:
    """The join over one table of documents; what several steps need is staged once."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kind = self.docs.schema["id"].dataType.simpleString()
        measured = stage(self.docs.mapInArrow(tidy(_measure), f"id {kind}, n long, node long, slice int, counts binary"), "gram-sizes")
        self.sizes = measured.where("slice IS NULL").select("id", "n", "node")
        counts = added(measured.where("slice IS NOT NULL").select("slice", "counts"), 1 << SKETCH_BITS)
        self.order = self.spark.sparkContext.broadcast(Order(counts))

    def postings(self) -> DataFrame:
        """key, node: prefix n-grams that more than one node may have; staged."""
        n_buckets = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        packer = _prefix_packer(self.order, n_buckets)
        schema = "block long, payload binary, parts array<struct<bucket: int, part: binary>>"
        blocks = stage(self.docs.select("text").mapInArrow(tidy(packer), schema), "gram-blocks")
        replies = ask(blocks.select("block", "parts"), _find_shared, "block long, bucket int, reply binary")
        return stage(answer_blocks(blocks.select("block", "payload"), replies, _post, "key long, node long").distinct(), "gram-postings")

    def describe(self, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Two staged tables.

        Of nodes: node, n (size), p (size of the prefix), first (smallest id), keys (those of
        ``postings`` that other nodes have too, rare ones first), weight (how many nodes they lead to).
        Of keys: key, node, n, p, weight, rank (place of the key in the node's prefix). Of keys
        with the very same nodes only the first is kept.
        """
        groups = ["size", "low", "high", "total"]
        total = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
        sizes = postings.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), total.alias("total"))
        sizes = stage(sizes.where("size > 1"), "gram-keys")
        every = self.sizes.where("node IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.min("id").alias("first"))
        own = postings.join(sizes.select("key", "size"), "key").groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("size", "key"))).alias("own"),  # no more than one document's prefix
            F.sum("size").alias("weight"),
        )
        p = F.col("n") - F.ceil(F.col("n") * PERCENT / F.lit(100)) + 1
        nodes = own.join(every, "node").select("node", "n", p.cast("long").alias("p"), "first", F.col("own.key").alias("keys"), "weight")
        nodes = stage(nodes, "gram-nodes")
        once = stage(sizes.groupBy(*groups).agg(F.min("key").alias("key")).select("key"), "gram-distinct-keys")
        # what is not in keys comes before: nobody else has it
        rank = F.col("p") - F.size("keys") + F.col("at")
        ranked = nodes.select("node", "n", "p", "weight", "keys", F.posexplode("keys").alias("at", "key"))
        ranked = ranked.select("key", "node", "n", "p", "weight", rank.alias("rank")).join(once, "key", "left_semi")
        return nodes, stage(ranked, "gram-ranked")

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sizes and common prefix allow a link, with na and nb; staged.

        A common n-gram is in both prefixes, or after the prefix that ends first in the global order.
        """
        side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "p", "keys")))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("keysa", "keysb"))
        most = F.least(F.col("na"), F.col("nb"), common + F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))
        return stage(both.withColumn("most", most).where(_linked("most")).select("a", "b", "na", "nb"), "gram-likely")

    def segments(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """node, fragment, grams of all nodes of ``pairs``; staged. One document stands for each node."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(nodes.select("node", "first").join(wanted, "node", "left_semi"), "gram-wanted")
        texts = self.docs.join(small(wanted), self.docs["id"].eqNullSafe(wanted["first"])).select("node", "text")
        kept = texts.mapInArrow(tidy(_segments(self.order)), "node long, fragment int, grams array<long>")
        return stage(kept.dropDuplicates(["node", "fragment"]), "gram-segments")

    def links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that link: overlaps counted fragment by fragment, then summed; staged."""
        pairs = self.likely(pairs, nodes)
        if pairs.isEmpty():
            return pairs.select("a", "b")
        segments = self.segments(pairs, nodes)
        left = pairs.select("a", "b").join(segments.withColumnsRenamed({"node": "a", "grams": "ga"}), "a")
        met = left.join(segments.withColumnsRenamed({"node": "b", "grams": "gb"}), ["b", "fragment"])
        partial = met.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("common"))
        total = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
        return stage(pairs.join(total, ["a", "b"]).where(_linked("common")).select("a", "b"), "gram-links")

    def roots(self) -> DataFrame:
        """node, root for all nodes that link with another node."""
        nodes, ranked = self.describe(self.postings())
        # the node that leads to most others is the likeliest to be near the rest of a key
        best = F.max(F.struct("weight", "node", "n", "p", "rank"))
        centre = stage(ranked.groupBy("key").agg(best.alias("c")).select("key", *(F.col(f"c.{c}").alias(f"x_{c}") for c in ("node", "n", "p", "rank"))), "gram-centres")
        star = ranked.join(centre, "key").where((F.col("node") != F.col("x_node")) & _may_link())
        star = stage(star.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct(), "gram-star")
        links = self.links(star, nodes)
        first = components(links)
        placed = ranked.drop("weight").join(first, "node", "left")
        placed = stage(placed.withColumn("component", F.coalesce("root", "node")).drop("root"), "gram-placed")
        rest = leftover_pairs(placed, _may_link()).join(star, ["a", "b"], "left_anti")
        more = self.links(rest, nodes)
        return first if more.isEmpty() else components(links.union(more))


def _may_link():
    """Whether nodes of sizes n and x_n, prefixes p and x_p, may link by a key of ranks rank and x_rank.

    Linked sets share at least so many n-grams of both prefixes; the rarest of these has the others
    behind it, in either prefix.
    """
    n, x = F.col("n"), F.col("x_n")
    overlap = F.ceil(PERCENT * (n + x) / F.lit(100 + PERCENT))
    shared = F.greatest(F.lit(1), overlap - F.greatest(n - F.col("p"), x - F.col("x_p")))
    ranks = (F.col("rank") <= F.col("p") - shared) & (F.col("x_rank") <= F.col("x_p") - shared)
    return (100 * F.least(n, x) >= PERCENT * F.greatest(n, x)) & ranks


def _linked(overlap: str):
    """Whether an overlap makes a link of sizes na and nb."""
    return 100 * F.col(overlap) >= PERCENT * (F.col("na") + F.col("nb") - F.col(overlap))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n (size of its set), component (smallest id that links lead to)."""
    join = Joiner(docs, id_col, text_col)
    rooted = stage(
        join.sizes.join(join.roots(), "node", "left").select("id", "n", F.coalesce("root", "node").alias("root")),
        "gram-roots",
    )
    least = stage(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component")), "gram-components")
    return rooted.join(least, "root", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest (id, text)."""
    join = Joiner(docs, id_col, text_col)
    roots = join.roots()
    copies = join.sizes.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    grouped = stage(copies.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("root")), "gram-grouped")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    def with_node(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            nodes = [node_of(g) if len(g) else None for g in gram_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64())], ["row", "node"])

    schema = rows.select("row", F.lit(0).cast("long").alias("node")).schema
    schema["node"].nullable = True
    placed = rows.mapInArrow(tidy(with_node), schema)
    alone = placed.join(grouped, "node", "left_anti").select("row")
    best = F.min_by("row", F.struct(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    one = placed.join(grouped, "node").groupBy("root").agg(best.alias("row")).select("row")
    return alone.unionByName(one).select("row.*")
