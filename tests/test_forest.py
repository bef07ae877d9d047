"""Forests grown without the driver: against MLlib's rules on the same nodes, and against brute force."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from tidegauge.config import TrainingConfig
from tidegauge.operators import forest, learn, models
from tidegauge.sources.tables import load_model, save_model

CFG = TrainingConfig("random_forest", num_trees=6, max_depth=5)


@pytest.fixture(scope="module")
def flows(spark):
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10
    y = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7))
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10))
    return spark.range(3000).select(
        x.cast("double").alias("Flow Duration"), y.cast("double").alias("SYN Flag Count"), noise.cast("double").alias("ACK Flag Count"),
        F.when((x > 55) & (y > 2) | (noise == 0), "Syn").otherwise("BENIGN").alias("label")).cache()


@pytest.fixture()
def large(monkeypatch):
    """Any forest counts as one of many nodes."""
    monkeypatch.setattr(learn, "DRIVER_NODES", 0)


@pytest.mark.parametrize("rows", [1 << 19, 400])
def test_a_large_forest_says_what_mllib_says_of_its_nodes(spark, flows, tmp_path, monkeypatch, large, rows):
    monkeypatch.setattr(forest, "LOCAL_ROWS", rows)
    monkeypatch.setattr(forest, "SENT", 100)
    fitted, metrics = learn.train(flows, CFG)
    assert isinstance(fitted.stages[-1], forest.GrownForestModel) and metrics.first().accuracy > 0.95
    save_model(spark, fitted, {}, str(tmp_path / "a"))
    model, _ = load_model(spark, str(tmp_path / "a"))
    path = f"{tmp_path}/a/model"
    folder, kind = models._classifier_path(spark, path)
    assert kind == models.FOREST
    # The same nodes, as MLlib's own model.
    meta = json.loads(spark.read.text(f"{folder}/metadata").first().value)
    forest._write_text(spark, json.dumps(meta | {"class": f"org.apache.spark.ml.classification.{models.FOREST}"}), str(tmp_path / "b/metadata"))
    for part in ("data", "treesMetadata"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(str(tmp_path / "b" / part))
    known = RandomForestClassificationModel.load(str(tmp_path / "b"))
    own = model.stages[-1]
    assert (known.getNumTrees, known.numFeatures, known.numClasses, known.totalNumNodes) == (own.getNumTrees, own.numFeatures, own.numClasses, own.totalNumNodes)
    assert max(t.depth for t in known.trees) == CFG.max_depth
    assert own.featureImportances.toArray() == pytest.approx(known.featureImportances.toArray())
    scaled = models.PipelineModel(model.stages[:-1]).transform(models.predict_by_nodes(flows, path))
    for a, b in zip(known.transform(scaled).collect(), model.transform(models.predict_by_nodes(flows, path)).collect(), strict=True):
        assert a.prediction == b.prediction == b.node_prediction
        assert list(a.probability) == pytest.approx(list(b.probability), abs=1e-12)
        assert b.node_probability == pytest.approx(list(b.probability), abs=1e-12)
        assert list(a.rawPrediction) == pytest.approx(list(b.rawPrediction), abs=1e-9)


def test_nodes_split_by_histograms_are_those_grown_in_a_task(spark, flows, monkeypatch, large):
    seen = []
    for rows in (1 << 19, 300):
        monkeypatch.setattr(forest, "LOCAL_ROWS", rows)
        model = learn.train(flows, CFG)[0].stages[-1]
        seen.append(sorted(tuple(map(str, r)) for r in model._nodes().collect()))
    assert seen[0] == seen[1]


def test_the_best_split_is_that_of_brute_force():
    rng = np.random.default_rng(5)
    x, y, c = rng.integers(0, 9, (400, 4)).astype(np.uint8), rng.integers(0, 3, 400).astype(np.uint8), rng.integers(1, 4, 400).astype(np.uint8)
    grower = forest.Grower(4, [1.0, 2.0, 0.5], TrainingConfig(num_trees=2, min_leaf=5))
    subsets = grower.subsets(1, np.array([1]))
    feature, b, gain, left = grower.splits(grower.histograms(x, y, c, np.zeros(400, np.int64), subsets), subsets)

    def gini(rows):
        w = np.bincount(y[rows], c[rows], 3) * grower.weights
        return (1 - ((w / w.sum()) ** 2).sum(), w.sum()) if w.sum() else (0.0, 0.0)
    whole, total = gini(np.ones(400, bool))
    best = {}
    for f in subsets[0]:
        for k in range(8):
            go = x[:, f] <= k
            if min(c[go].sum(), c[~go].sum()) >= 5:
                (i, m), (j, n) = gini(go), gini(~go)
                best[f, k] = whole - m / total * i - n / total * j
    assert gain[0] == pytest.approx(max(best.values())) == pytest.approx(best[feature[0], b[0]])
    go = x[:, feature[0]] <= b[0]
    assert left[0].tolist() == np.bincount(y[go], c[go], 3).tolist()


def test_thresholds_lie_between_few_values_and_at_quantiles_of_many(spark):
    df = spark.range(5000).select(F.array((F.col("id") % 4).cast("double"), F.col("id").cast("double"), F.lit(7.0)).alias("x"))
    few, many, one = forest.candidates(df, 3)
    assert few.tolist() == [0.5, 1.5, 2.5] and len(one) == 0
    assert len(many) == 31 and many == pytest.approx([5000 * i / 32 for i in range(1, 32)], abs=3)


def test_small_forests_are_mllibs(spark, flows):
    assert isinstance(learn.train(flows, CFG)[0].stages[-1], RandomForestClassificationModel)
