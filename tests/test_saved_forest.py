import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veedor.functions.flags import enrich
from veedor.operators import signals
from veedor.operators.isolation import Forest, SavedForest, fit_saved, load_forest, normalized, save_forest, with_anomaly
from veedor.runtime import stage
from veedor.sources.star import contracts
from veedor.streaming import feeds

FEATURES = signals.CONTRACT_FEATURES
KEYS = ("id_contrato",)


def values(df):
    return {r["id_contrato"]: (r["crudo"], r["score_anomalia"]) for r in df.collect()}


def test_feed_scores_equal_batch_scores(spark, tmp_path):
    source = contracts(spark, SF)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = stage(signals.contract_features(enrich(source)).select(*KEYS, *FEATURES), "features")
    model = fit_saved(rows, FEATURES, KEYS, trees=20)
    save_forest(spark, model, str(tmp_path / "model"))
    batch = normalized(stage(with_anomaly(rows, FEATURES, model.forest, "crudo"), "raw"), "crudo", "score_anomalia")
    feed = feeds.contract_feed(spark, str(tmp_path / "in"), source.schema, maxFilesPerTrigger="1")
    arriving = signals.contract_features(enrich(feed)).select(*KEYS, *FEATURES)
    streamed = feeds.run_available(load_forest(spark, str(tmp_path / "model")).scored(arriving, "crudo", "score_anomalia"), "forest")
    want, got = values(batch), values(streamed)
    assert got.keys() == want.keys() and len(got) > 100
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair, abs=1e-12)
    assert {0.0, 1.0} <= {round(p[1], 9) for p in got.values()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "model")
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"))
    for version, seed in ((1, 1), (2, 2)):
        save_forest(spark, fit_saved(rows, ("x",), ("k",), version, trees=5, seed=seed), path)
    newest, first = load_forest(spark, path), load_forest(spark, path, 1)
    assert (newest.version, first.version, newest.features) == (2, 1, ("x",))
    point = np.array([[3.0], [99.0]])
    assert not np.allclose(newest.forest.score(point), first.forest.score(point))
    with pytest.raises(Exception, match="exists"):
        save_forest(spark, first, path)
    with pytest.raises(ValueError):
        load_forest(spark, path, 7)


def test_few_rows_and_values_outside_the_range(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    few = fit_saved(rows, ("x",), ("k",))
    save_forest(spark, few, str(tmp_path / "few"))
    assert {tuple(r) for r in load_forest(spark, str(tmp_path / "few")).scored(rows, "c", "s").select("c", "s").collect()} == {(0.0, 0.0)}
    save_forest(spark, fit_saved(rows.limit(0), ("x",), ("k",)), str(tmp_path / "none"))
    assert load_forest(spark, str(tmp_path / "none")).forest.trees == []
    many = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"))
    model = fit_saved(many, ("x",), ("k",), trees=10)
    narrow = SavedForest(Forest(model.forest.trees, model.forest.scale), ("x",), model.low, (model.low + model.high) / 2, 1)
    found = [r.s for r in narrow.scored(many, "c", "s").collect()]
    assert min(found) >= 0 and max(found) == 1
