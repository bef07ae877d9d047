"""Tree models as tables of nodes against the fitted models themselves."""

import math

import pytest
from pyspark.sql import functions as F

from tidegauge.config import TrainingConfig
from tidegauge.operators import learn, models
from tidegauge.sources.tables import load_model, save_model

KINDS = [TrainingConfig("random_forest", num_trees=7, max_depth=6), TrainingConfig("gradient_boosting", num_trees=5, max_depth=3),
         TrainingConfig("tree", max_depth=5)]


@pytest.fixture(scope="module")
def flows(spark):
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10
    y = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7))
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10))
    return spark.range(1500).select(
        x.cast("double").alias("Flow Duration"), y.cast("double").alias("SYN Flag Count"), noise.cast("double").alias("ACK Flag Count"),
        F.when((x > 55) & (y > 2) | (noise == 0), "Syn").otherwise("BENIGN").alias("label")).cache()


@pytest.mark.parametrize("cfg", KINDS, ids=lambda c: c.model_type)
def test_nodes_say_what_the_model_says(spark, flows, tmp_path, cfg):
    fitted, metrics = learn.train(flows, cfg)
    save_model(spark, fitted, {"kind": cfg.model_type}, str(tmp_path))
    model, meta = load_model(spark, str(tmp_path))
    path = f"{tmp_path}/model"
    assert meta == {"kind": cfg.model_type}
    for r in model.transform(models.predict_by_nodes(flows, path)).collect():
        assert r.prediction == r.node_prediction and list(r.probability) == pytest.approx(r.node_probability, abs=1e-12)
    known = {r.feature: r.importance for r in learn.feature_importance(spark, model).collect()}
    own = {r.feature: r.importance for r in models.importance_by_nodes(spark, path).collect()}
    assert own == pytest.approx({f: v for f, v in known.items() if v > 0})
    assert tuple(models.metrics_by_nodes(learn._binary(flows), path).first()) == pytest.approx(tuple(metrics.first()))
    nodes, _ = models.tree_nodes(spark, path)
    trees = {r.tree: r.n for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(trees) == (1 if cfg.model_type == "tree" else cfg.num_trees) and all(n % 2 for n in trees.values())


def test_rows_reach_the_leaves_they_were_fitted_on(spark, flows, tmp_path):
    fitted, _ = learn.train(flows, KINDS[2])
    save_model(spark, fitted, {}, str(tmp_path))
    leaves = models.leaf_counts(flows, f"{tmp_path}/model").collect()
    assert all(r.reached == r.rows for r in leaves) and sum(r.reached for r in leaves) == 1500
    fitted, _ = learn.train(flows, KINDS[0])
    save_model(spark, fitted, {}, str(tmp_path))
    with pytest.raises(ValueError):
        models.leaf_counts(flows, f"{tmp_path}/model")


def test_empty_tables_are_scored(spark, flows, tmp_path):
    fitted, _ = learn.train(flows, KINDS[2])
    save_model(spark, fitted, {}, str(tmp_path))
    assert models.predict_by_nodes(flows.limit(0), f"{tmp_path}/model").count() == 0


def test_folds_are_even_in_every_label(spark, flows):
    n = learn.with_folds(learn._binary(flows), 4).groupBy("code", "fold").count().collect()
    for code in (0.0, 1.0):
        sizes = [r["count"] for r in n if r.code == code]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_anova_of_odd_features(spark):
    rows = [(c, float(c), 5.0, float(i)) for c in (0, 1) for i in range(4)]
    got = {r.feature: r.f for r in learn.anova(spark.createDataFrame(rows, "label int, a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got["a"] == math.inf and got["b"] is None and got["c"] == 0
    one = learn.anova(spark.createDataFrame(rows[:4], "label int, a double, b double, c double"), ["c"]).first()
    assert one.f is None


@pytest.mark.parametrize("bins", [2, 256])
def test_exact_quantiles(spark, bins):
    rows = [("a", float(i * 37 % 101), i % 3) for i in range(101)] + [("b", 7.0, 1)] * 50 + [("a", None, 1), (None, 3.0, 0)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    got = {(r.k, r.column, r.share): r.value for r in learn.exact_quantiles(df, "k", ["x", "y"], [0.0, 0.05, 0.5, 1.0], bins).collect()}
    for k in ("a", "b", None):
        for c, i in (("x", 1), ("y", 2)):
            values = sorted(r[i] for r in rows if r[0] == k and r[i] is not None)
            for q in (0.0, 0.05, 0.5, 1.0):
                assert got[k, c, q] == values[max(math.ceil(len(values) * q - 1e-9), 1) - 1]
