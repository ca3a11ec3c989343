import zlib

import pytest

from tests.conftest import SF
from veedor.llm import cotrain

SF = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    hidden = [r.doc_id for r in labels.collect() if zlib.crc32(f"t{r.doc_id}".encode()) % 3 == 0]
    seen = labels.where(~labels.doc_id.isin(hidden))
    kept = {r.row.doc_id: r.score >= cotrain.KEEP_FROM for r in cotrain.score(docs, seen, carry=["doc_id"]).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in set(hidden)}
    right = sum(kept[i] == bool(q) for i, q in truth.items())
    assert right >= 0.97 * len(truth)
    assert sum(kept[i] for i, q in truth.items() if q) >= 0.99 * sum(truth.values())


def test_edges(spark, tables, table):
    docs, labels = tables
    odd = table([(1, None), (2, ""), (2, "word"), (None, "the and of"), (3, "*** &&& " * 20_000)])
    more = docs.unionByName(odd.select(docs.columns))
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None), (6, 7, 0)], labels.schema))
    assert cotrain.score(more, messy).count() == more.count()
    kept = cotrain.keep_good(odd, labels)
    assert kept.dtypes == odd.dtypes
    assert cotrain.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert cotrain.keep_good(odd.limit(0), labels).count() == 0
    assert cotrain.keep_good(odd.drop("lang", "n_chars"), labels).columns == odd.drop("lang", "n_chars").columns


def test_calibration():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    fit = cotrain.Calibration.of(x, y)
    assert abs(fit.weights[0] - 2) < 0.25 and abs(fit.weights[1] + 1) < 0.2
