"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veedor.llm import cotrain
from veedor.llm.bilinear_lm import score
from veedor.llm.byte_bpe import decode_batches, encode, token_bytes
from veedor.llm.decontaminate import contamination
from veedor.llm.exact_dedup import exact_groups
from veedor.llm.heap_kmeans import cluster
from veedor.llm.html_text import extract
from veedor.llm.learned_partitions import nearest
from veedor.llm.licenses import scan_licenses
from veedor.llm.line_dedup import line_report
from veedor.llm.mask_search import search
from veedor.llm.ngram_join import components_of
from veedor.llm.warc import read_archive, resolve_revisits, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = resolve_revisits(spark, write_archive(_table(spark, sf_dir, "pages")))
    return read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(_table(spark, sf_dir, "documents")).toDF("doc_id", "n_shingles", "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes of every document."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    shared = token_bytes(docs.sparkSession, vocabulary)

    def digests(table: pa.Table) -> pa.Table:
        (batch,) = decode_batches(table.to_batches(), shared)
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        return pa.table(
            {
                "id": batch.column("id"),
                "n_tokens": ids.value_lengths().cast(pa.int64()),
                "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in np.split(flat, ends[:-1])],
                "decoded_sha256": [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")],
            }
        )

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(docs, vocabulary, finish=digests, schema=columns).withColumnRenamed("id", "doc_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cotrain.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("row.doc_id", "text_score", "meta_score", "score", (F.col("score") >= cotrain.KEEP_FROM).alias("kept"))


def op8_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_report(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_kept", F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped_lines"))


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it takes its last stage from this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bilinear_lm": op8_bilinear_lm,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_learned_partitions": op11_learned_partitions,
    "op12_mask_search": op12_mask_search,
    "op13_heap_kmeans": op13_heap_kmeans,
    "pipeline": pipeline,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"



def _rounds_sql(rounds: int) -> str:
    """Every round of the clustering written out: x(r, i, a) vectors, c0, c1, ... (c, i, a) centroids."""
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
             FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64),
        x AS MATERIALIZED (SELECT r, i, v[i] AS a FROM kept, range(1, 65) t(i)),
        c0 AS MATERIALIZED (SELECT c, i, v[i] AS a FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c
             FROM kept QUALIFY c < 8), range(1, 65) t(i))"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((x.a - k.a) * (x.a - k.a))::BIGINT AS d FROM x JOIN c{n} k USING (i) GROUP BY r, c)
             QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, a) AS a FROM c{n} LEFT JOIN
             (SELECT c, i, sum(a)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY c, i) USING (c, i))""")
    return ",\n        ".join(parts)


ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM documents),
        i AS (SELECT item_id, w, least(13, len(w)) AS k
              FROM (SELECT item_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
        x AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS t
              FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM i)),
        p AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS t
              FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM x))),
        h AS (SELECT r, j, p.k, item_id FROM p JOIN x ON p.k = x.k AND p.t = x.t),
        c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(j, j + k)) AS q FROM h) GROUP BY r),
        e AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
              FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN e USING (r)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
        b AS (SELECT page_id, h, octet_length(encode(h)) AS n,
                     max(page_id) OVER (PARTITION BY h) AS m,
                     row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r) = 1 AS newest FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND NOT newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND NOT newest THEN m END AS refers_to
        FROM b""",
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_FOLD} AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                     row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
              FROM n WINDOW w AS (PARTITION BY t))
        SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g""",
    "op12_mask_search": f"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_TERM}) AS w FROM documents),
        s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM t WHERE len(w) > 0),
        i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_FOLD}, {_TERM}) AS w FROM benchmark),
        q AS MATERIALIZED (SELECT i, item_id, v, count(*) AS k FROM (SELECT i, item_id, unnest(w) AS v FROM i) GROUP BY ALL),
        p AS MATERIALIZED (SELECT r, v, count(*) AS tf FROM (SELECT r, unnest(w) AS v FROM t) WHERE v IN (SELECT v FROM q) GROUP BY ALL),
        f AS (SELECT v, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS g FROM (SELECT v, count(*) AS df FROM p GROUP BY v), s),
        m AS (SELECT r, doc_id, 75 + (25 * len(w) * n) // l AS m FROM t, s),
        x AS (SELECT i, item_id, r, doc_id, sum(k * g * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM q JOIN p USING (v) JOIN f USING (v) JOIN m USING (r) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
        FROM x WHERE score > 0 QUALIFY rank <= 20""",
    "op13_heap_kmeans": f"""
        WITH {_rounds_sql(10)},
        h AS (SELECT c, sha256(string_agg(a::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a10 JOIN kept USING (r) JOIN h USING (c)""",
}
