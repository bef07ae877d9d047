import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidegauge.config import TrainingConfig
from tidegauge.functions import columns as C
from tidegauge.operators import evaluate, learn
from tidegauge.schemas import FEATURES
from tidegauge.sources import flows, tables


def labelled(spark, attacks, benign):
    return (spark.range(attacks + benign)
            .select(F.when(F.col("id") < attacks, "Syn").otherwise("BENIGN").alias("label"),
                    F.col("id").cast("double").alias("Flow Duration"), F.lit("f").alias("source_file")))


def separable(spark, n=1200):
    noise = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(f) for i, f in enumerate(FEATURES)]
    df = spark.range(n).select("id", (F.col("id") % 3 == 0).alias("attack"), *noise)
    for f, up in (("Flow Packets/s", 20_000), ("SYN Flag Count", 500), ("Flow Bytes/s", 2_000_000)):
        df = df.withColumn(f, F.when(F.col("attack"), C.feature(f) * 100 + up).otherwise(C.feature(f) * 100))
    return df.withColumn("label", F.when(F.col("attack"), "Syn").otherwise("BENIGN")).drop("attack", "id")


def test_scores_with_a_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "label int, prediction int")
    assert evaluate.accuracy(df).first().accuracy == 0.5
    w = evaluate.weighted_scores(df).first()
    assert (w.precision, w.recall, round(w.f1, 6)) == (0.25, 0.5, 0.333333)
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert (report[1].precision, report[1].recall, report[1].support) == (0, 0, 2)
    rates = evaluate.binary_rates(df).first()
    assert (rates.tpr, rates.tnr, rates.fpr, rates.f1) == (0, 1, 0, 0)


@pytest.mark.parametrize("benign, kept", [(100, 30), (10, 10)])
def test_balance(spark, benign, kept):
    out = learn.balance(labelled(spark, 70, benign), 0.3)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"Syn": 70, "BENIGN": kept}


def test_split_is_exact_per_label_and_repeatable(spark):
    df = labelled(spark, 700, 300)
    out = learn.split(df)
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {("Syn", "train"): 490, ("Syn", "val"): 70, ("Syn", "test"): 140,
                      ("BENIGN", "train"): 210, ("BENIGN", "val"): 30, ("BENIGN", "test"): 60}
    again = learn.split(df.repartition(7))
    assert out.exceptAll(again).count() == 0
    assert learn.split_by_hash(df).count() == 1000


def test_sample_per_file(spark):
    df = labelled(spark, 70, 30).unionByName(labelled(spark, 5, 0).withColumn("source_file", F.lit("g")))
    got = flows.sample_per_group(df, "source_file", 20)
    assert {r.source_file: r["count"] for r in got.groupBy("source_file").count().collect()} == {"f": 20, "g": 5}


def test_scaling_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in learn.scale_pop(df, ["a", "b"]).orderBy("a").collect()] == [(-1, 0), (1, 0)]
    w = {r.label: r.weight for r in learn.class_weights(labelled(spark, 30, 10)).collect()}
    assert w == {"Syn": pytest.approx(40 / 60), "BENIGN": 2.0}


def test_train_predict_save_load(spark, tmp_path):
    df = separable(spark)
    cfg = TrainingConfig(num_trees=5, max_depth=4, samples_per_file=None)
    model, meta, out = learn.train_job(spark, df.withColumn("source_file", F.lit("f")), cfg)
    assert meta["accuracy"] > 0.95 and out["test"].first().f1 > 0.95
    assert learn.evaluate_model(model, df) > 0.95
    scored = learn.predict(model, df.withColumn("ACK Flag Count", F.lit(0.0)))
    r = scored.filter("is_attack").first()
    assert r.attack_type == "SYN_Flood" and 50 <= r.confidence <= 100 and r.attack_probability > 0.5
    assert scored.filter("NOT is_attack").first().attack_type == "BENIGN"
    tables.save_model(spark, model, meta, str(tmp_path / "m"))
    loaded, meta2 = tables.load_model(spark, str(tmp_path / "m"))
    assert meta2["num_trees"] == 5
    a, b = (learn.predict(m, df).select("is_attack", F.round("confidence", 6)).collect() for m in (model, loaded))
    assert a == b
    assert tables.load_model(spark, str(tmp_path / "none")) == (None, {})
    info = learn.model_info(spark, loaded, meta2).first()
    assert info.is_trained and info.features == 64 and info.trees == 5
    assert not learn.model_info(spark, None).first().is_trained
    top = learn.feature_importance(spark, model, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance


def test_other_models_and_selection(spark):
    df = separable(spark, 600)
    few = ["Flow Packets/s", "SYN Flag Count", "Idle Min", "Idle Max"]
    for cfg in (TrainingConfig("gradient_boosting", num_trees=3, max_depth=3), TrainingConfig("tree", max_depth=3)):
        assert learn.train(df, cfg, features=few)[1].first().accuracy > 0.95
    assert set(learn.select_by_anova(df, 2, few)) == set(few[:2])
    models, folds = learn.cross_validate(df, TrainingConfig("tree", max_depth=3), 3, few)
    assert len(models) == 3 and all(r.accuracy > 0.95 for r in folds.collect()) and sum(r.rows for r in folds.collect()) == df.count()
    with pytest.raises(ValueError):
        learn.train(df, TrainingConfig("svm"), features=few)


def test_untrained(spark):
    df = labelled(spark, 2, 2)
    assert {(r.attack_type, r.confidence) for r in learn.predict(None, df).collect()} == {("UNKNOWN", 0)}
    assert learn.predict_batch(None, df).count() == 0


def test_rules_from_flows(spark):
    df = separable(spark, 300).withColumn("attack_type", F.when(C.is_benign("label"), "BENIGN").otherwise("Syn"))
    out = learn.mine_signatures(df.withColumn("confidence", F.lit(99.0)), ["Flow Packets/s"], extremes=True).collect()
    assert [(r.attack_type, r.matched, r.false_rate, r.keep) for r in out] == [("Syn", 1, 0, True)]
    approx = learn.mine_signatures(df.withColumn("confidence", F.lit(99.0)), ["Flow Packets/s"], 0.01, 0.99).first()
    assert approx.keep
    assert learn.mine_signatures(df.withColumn("confidence", F.lit(10.0)), ["Idle Min"]).count() == 0


def csv(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_flow_files(spark, tmp_path):
    folder = str(tmp_path / "flows")
    csv(folder, "a.csv", "Flow Duration, SYN Flag Count, Label\n1,Infinity, BENIGN\n2,abc,Syn\n")
    csv(folder, "deep/er/b.csv", " Flow Duration, Label\n3,Syn\nNaN,DrDoS_UDP\n")
    csv(folder, "c.csv", "")
    csv(folder, "notes.txt", "no flows")
    raw = flows.read_labelled_flows(spark, folder)
    assert {"Flow Duration", "SYN Flag Count", "Label", "source_file"} == set(raw.columns) and raw.count() == 4
    got = sorted(tuple(r)[:3] for r in learn.prepare_flows(raw).collect())
    assert got == [(0, 0, "DrDoS_UDP"), (1, 0, "BENIGN"), (2, 0, "Syn"), (3, 0, "Syn")]
    assert flows.read_labelled_flows(spark, folder, max_files=1).count() == 2
    os.makedirs(tmp_path / "empty")
    with pytest.raises(FileNotFoundError):
        flows.read_labelled_flows(spark, str(tmp_path / "empty"))


def test_dedupe(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (float("nan"), "x"), (float("inf"), "y"), (None, "z"), (2.0, None)],
                               "v double, label string")
    assert [tuple(r) for r in learn.dedupe_flows(df).collect()] == [(1.0, "x")]


def test_a_null_label_has_a_weight_whatever_the_number_of_classes(spark):
    for classes in (3, 1500):
        rows = [(f"c{i}", i) for i in range(classes)] + [(None, -1), (None, -2)]
        out = learn.with_weights(spark.createDataFrame(rows, "label string, x int"))
        n, k = classes + 2, classes + 1
        assert {r.weight for r in out.filter("label is null").collect()} == {n / (k * 2)}
        assert out.filter("weight is null").count() == 0


def test_only_fitting_rows_are_sampled(spark):
    rows = [(float(i % 7), "BENIGN" if i % 2 else "Syn", f"f{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "`Flow Duration` double, label string, source_file string")
    cfg = TrainingConfig(num_trees=2, max_depth=2, samples_per_file=10)
    _, _, out = learn.train_job(spark, df, cfg)
    assert sum(r["rows"] for r in out["test_confusion"].collect()) == 80
    with pytest.raises(ValueError):
        learn.train_job(spark, df.drop("source_file"), cfg)


def test_edges_of_ratios(spark):
    with pytest.raises(ValueError):
        learn.balance(spark.createDataFrame([("Syn",)], "label string"), 1.0)


def test_a_forest_moves_rows_by_one_node_a_pass_and_stays_the_same(spark):
    cfg = TrainingConfig(num_trees=5, max_depth=6)
    made = learn._classifier(cfg)
    assert made.getCacheNodeIds() and made.getMaxMemoryInMB() > 256
    rows = learn.with_weights(learn._binary(separable(spark)), "code")
    names = ["Flow Duration", "SYN Flag Count", "Flow Bytes/s"]
    ready = Pipeline(stages=learn._stages(names, cfg)[:-1]).fit(rows).transform(rows)
    plain = made.copy().setCacheNodeIds(False).setMaxMemoryInMB(256)
    assert made.fit(ready).toDebugString.split("\n")[1:] == plain.fit(ready).toDebugString.split("\n")[1:]


def test_rows_to_fit_on_are_spread_by_their_number(spark, monkeypatch):
    seen, fit = [], learn.Pipeline.fit
    monkeypatch.setattr(learn, "FIT_ROWS", 300, raising=False)
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, df: (seen.append(df), fit(self, df))[1])
    learn.train(separable(spark).coalesce(1), TrainingConfig("tree", max_depth=2))
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 310 and sum(sizes) == 1200


def test_rows_to_fit_on_are_kept_while_they_are_read_again(spark, monkeypatch):
    seen, fit = [], learn.Pipeline.fit
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, df: (seen.append((df, df.storageLevel)), fit(self, df))[1])
    learn.train(separable(spark), TrainingConfig("tree", max_depth=2))
    (df, during), = seen
    assert during.useDisk and not during.useMemory
    assert not df.storageLevel.useDisk
