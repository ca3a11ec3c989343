"""Every registered query of the subpackage, on the smallest tables."""

import re

import pytest
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
import public_tokenizers as P
from checks.compare import connect, difference
from tests.conftest import SF
from tests.llm import brute
from veedor.llm.byte_bpe import load_ranks
from veedor.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_query(spark, sql, name):
    rows = QUERIES[name](spark, SF).toPandas()
    keys = {"op1": ("page_id", "pages"), "op3": ("page_id", "pages"), "op13": ("vec_id", "embeddings")}
    key, source = keys.get(name.split("_")[0], ("doc_id", "documents"))
    if name.split("_")[0] not in ("op11", "op12"):  # these have a row per place
        assert sorted(rows[key]) == sorted(sql.execute(f"SELECT {key} FROM {source}").df()[key])
    if name in ORACLES:
        assert difference(rows, sql.execute(ORACLES[name]).df()) == ""


def test_names():
    assert [n for n in contract.queries() if re.match(r"op\d+_|pipeline", n)] == list(QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline(spark, sql):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    steps = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}

    def step(name):
        nonlocal docs
        out = steps[name](spark, docs, SF).cache()
        assert out.columns == docs.columns
        docs = out
        return {r.doc_id: r.text for r in out.collect()}

    now = step("quality_classifier")
    assert all(q for i, q in labels.items() if i in now) and all(i in now for i, q in labels.items() if q and i in before)
    before, now = now, step("exact_dedup")
    assert set(now) == {max(i for i, t in before.items() if brute.fold(t) == f) for f in {brute.fold(t) for t in before.values()}}
    before, now = now, step("ngram_jaccard_join")
    assert set(now) == set(brute.components(before).values())
    before, now = now, step("benchmark_decontamination")
    assert set(now) == {i for i, (n, h, _) in brute.hits(before, benchmark).items() if not (h and 20 * h >= n)}
    last = {r.doc_id: r.n_tokens for r in steps["byte_bpe"](spark, docs, SF).collect()}
    assert last == {i: len(library.encode_ordinary(t)) for i, t in now.items()}
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == last
