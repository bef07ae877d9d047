"""Preparing labelled flows, training and applying classifiers with MLlib, and mining rules."""

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from tidegauge.config import TrainingConfig
from tidegauge.functions import columns as C
from tidegauge.operators import evaluate, forest
from tidegauge.plans.spread import hash_bucket, key_join, running, settle, small_join
from tidegauge.schemas import FEATURES

SPLITS = ("train", "val", "test")

#: Statistics of nodes that a pass over the rows may gather, in a task. It decides how many passes a deep forest needs.
FOREST_MB = 512
#: MLlib keeps a partition's rows in memory, at up to 2 KB a row, and a file's size says little about its number of rows.
FIT_ROWS = 500_000
#: Nodes that a forest may have, by its depth or one for each row, beyond which it is grown without the driver's memory.
DRIVER_NODES = 5_000_000


# -- tables ----------------------------------------------------------------------------------------

def prepare_flows(df: DataFrame, names=FEATURES, label="label", keep=("source_file",)) -> DataFrame:
    """Known features as clean numbers, trimmed label. One projection, so unused columns are never read."""
    by_name = {c.strip(): c for c in df.columns}
    label = by_name.get(label) or by_name["Label"]
    known = C.select_features(df.columns, names)
    kept = [C.feature(c) for c in keep if c in df.columns]
    return df.select(*[C.clean_number(C.to_number(C.feature(by_name[n]))).alias(n) for n in known],
                     C.norm_label(C.feature(label)).alias("label"), *kept)


def dedupe_flows(df: DataFrame) -> DataFrame:
    """Without rows that lack a value or hold NaN or infinity, and without repeated rows."""
    ok = F.lit(True)
    for f in df.schema:
        c = C.feature(f.name)
        ok = ok & c.isNotNull()
        if f.dataType.simpleString() in ("double", "float"):
            ok = ok & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.filter(ok).dropDuplicates()


def encode_multiclass(df: DataFrame, label: str = "label"):
    """Codes in alphabetical order of the trimmed labels; gives the table and the fitted encoder."""
    trimmed = df.withColumn("__label", C.norm_label(label))
    encoder = StringIndexer(inputCol="__label", outputCol="code", stringOrderType="alphabetAsc").fit(trimmed)
    return encoder.transform(trimmed).drop("__label"), encoder


def decode_multiclass(df: DataFrame, encoder, code: str = "code", name: str = "name") -> DataFrame:
    """B9"""
    return IndexToString(inputCol=code, outputCol=name, labels=encoder.labels).transform(df)


def _content_hash(df, seed):
    return F.xxhash64(*[C.feature(c) for c in sorted(df.columns)], F.lit(seed))


def _hash_numbered(df, keys, seed, total=None):
    """Row numbers per key in the order of a content hash; equal hashes mean equal rows, which may swap places."""
    h = df.withColumn("__h", _content_hash(df, seed))
    return running(h, keys, ["__h"], hash_bucket(F.col("__h")), rank="__i", total=total)


def balance(df: DataFrame, ratio: float = 0.3, seed: int = 42, label: str = "label") -> DataFrame:
    """All attacks and as many benign rows as make up ``ratio`` of the result, if there are that many."""
    if not 0 <= ratio < 1:
        raise ValueError(f"ratio must be at least 0 and below 1, not {ratio}")
    attacks = df.filter(~C.is_benign(label))
    n = attacks.count()
    target = int(n * ratio / (1 - ratio))
    benign = (_hash_numbered(df.filter(C.is_benign(label)).withColumn("__one", F.lit(1)), ["__one"], seed)
              .filter(F.col("__i") <= target).drop("__i", "__h", "__one"))
    return attacks.unionByName(benign)


def split(df: DataFrame, fractions=(0.7, 0.1, 0.2), seed: int = 42, label: str = "label") -> DataFrame:
    """Adds ``split`` with the exact fractions of every label, by rank of a content hash.

    Ranks are found in hash ranges, so a label with most of the rows is still spread.
    """
    ranked = _hash_numbered(df, [label], seed, total="__n")
    train = F.round(F.col("__n") * fractions[0])
    val = F.round(F.col("__n") * round(fractions[0] + fractions[1], 9))
    return (ranked.withColumn("split", F.when(F.col("__i") <= train, "train").when(F.col("__i") <= val, "val")
                              .otherwise("test")).drop("__i", "__h", "__n"))


def split_by_hash(df: DataFrame, fractions=(0.7, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """Like ``split`` without any shuffle: the hash itself decides, so fractions hold only on average."""
    u = F.pmod(_content_hash(df, seed), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < fractions[0], "train").when(u < fractions[0] + fractions[1], "val")
                         .otherwise("test"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """N / (k * n_c) per class. The totals run over one row per class; the rows are counted once."""
    counts = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")))
    everything = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn("weight", F.lit(float(everything.n or 0)) / (max(everything.k, 1) * F.col("rows")))


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``; a null label is a class of its own. One row per class is joined, by broadcast if few enough."""
    return _weighted(df, class_weights(df, label), label)


def _weighted(df, weights, label):
    return small_join(df, weights.select(label, "weight"), [label], "left")


def scale_pop(df: DataFrame, columns, fit_on: DataFrame | None = None) -> DataFrame:
    """J5 with the population deviation: (x - mean) / std, and std 1 for a constant column.

    The statistics are one row of two numbers per column.
    """
    source = fit_on if fit_on is not None else df
    row = source.agg(*[F.avg(C.feature(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                     *[F.stddev_pop(C.feature(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = {c: ((C.feature(c) - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"s{i}"] or 1.0)) for i, c in enumerate(columns)}
    return df.select(*[scaled[c].alias(c) if c in scaled else C.feature(c) for c in df.columns])


# -- models ----------------------------------------------------------------------------------------

def _classifier(cfg: TrainingConfig):
    common = {"featuresCol": "scaled", "labelCol": "code", "weightCol": "weight", "seed": cfg.seed,
              "maxDepth": cfg.max_depth, "minInstancesPerNode": cfg.min_leaf}
    if cfg.model_type == "random_forest":
        # A pass over the rows moves each on by one node of every tree, instead of walking all trees down from their roots.
        return RandomForestClassifier(numTrees=cfg.num_trees, cacheNodeIds=True, maxMemoryInMB=FOREST_MB, **common)
    if cfg.model_type == "gradient_boosting":
        return GBTClassifier(maxIter=cfg.num_trees, **common)
    if cfg.model_type == "tree":
        return DecisionTreeClassifier(**common)
    raise ValueError(f"unknown model type {cfg.model_type!r}")


def _stages(features, cfg):
    return [VectorAssembler(inputCols=features, outputCol="raw_vector"),
            StandardScaler(inputCol="raw_vector", outputCol="scaled", withMean=True, withStd=True), _classifier(cfg)]


def _binary(df):
    return df if "code" in df.columns else df.withColumn("code", C.encode_binary("label").cast("double"))


def train(df: DataFrame, cfg: TrainingConfig = TrainingConfig(), validation: DataFrame | None = None,
          features=None):
    """Fits assembler, scaler and classifier; gives (model, metrics as a one-row table).

    Metrics are those on ``validation``, or on the training rows if there is none. ``code`` (0 benign) is the target; it
    is made from ``label`` when missing.
    """
    features = features or [f for f in FEATURES if f in df.columns]
    coded = _binary(df).select(*[C.feature(f) for f in features], "code")
    weights = class_weights(coded, "code")
    weighted, n = _weighted(coded, weights, "code"), weights.agg(F.sum("rows")).first()[0] or 0
    large = cfg.model_type == "random_forest" and cfg.num_trees * min(n, 2 ** (cfg.max_depth + 1)) > DRIVER_NODES
    if n > FIT_ROWS:
        weighted = weighted.repartition(max(-(-n // FIT_ROWS), df.sparkSession.sparkContext.defaultParallelism))
    # Scaler and classifier read the rows several times, each from the shuffle's start; on disk they leave memory to MLlib.
    weighted = weighted.persist(StorageLevel.DISK_ONLY)
    try:
        *before, classifier = _stages(features, cfg)
        if large:
            model = Pipeline(stages=before).fit(weighted)
            by_class = {int(r.code): r.weight for r in weights.select("code", "weight").collect()}
            by_class = [by_class.get(k, 0.0) for k in range(max(by_class) + 1)]
            model = PipelineModel([*model.stages, forest.fit_forest(classifier, model.transform(weighted), by_class, n, cfg)])
        else:
            model = Pipeline(stages=[*before, classifier]).fit(weighted)
    finally:
        weighted.unpersist()
    checked = _binary(validation if validation is not None else df)
    return model, model_metrics(model, checked)


def model_metrics(model, df: DataFrame) -> DataFrame:
    """Accuracy, weighted precision, recall and F1 of a model on labelled rows."""
    scored = model.transform(_binary(df)).select(F.col("code").alias("label"), "prediction")
    # Recall averaged by support is the share of right predictions.
    return (evaluate.weighted_scores(scored)
            .select(F.col("recall").alias("accuracy"), "precision", "recall", "f1"))


def evaluate_model(model, df: DataFrame) -> float:
    """J13, D14 by MLlib's evaluator."""
    return MulticlassClassificationEvaluator(labelCol="code", metricName="accuracy").evaluate(
        model.transform(_binary(df)))


def predict(model, df: DataFrame, benign_code: float = 0.0, keep=None) -> DataFrame:
    """Adds ``is_attack``, ``attack_probability``, ``confidence`` (0-100) and ``attack_type``.

    Without a model nothing is known: no attack, type UNKNOWN, confidence 0.
    """
    if model is None:
        return (df.withColumn("is_attack", F.lit(False)).withColumn("attack_probability", F.lit(0.0))
                .withColumn("confidence", F.lit(0.0)).withColumn("attack_type", F.lit("UNKNOWN")))
    columns = keep or df.columns
    p = vector_to_array("probability")
    attack = F.col("prediction") != benign_code
    scored = model.transform(df)
    kind = C.infer_attack_type(is_attack=attack) if "Flow Packets/s" in df.columns else (
        F.when(attack, "DDoS_Generic").otherwise("BENIGN"))
    return scored.select(*[C.feature(c) for c in columns], attack.alias("is_attack"),
                         (1.0 - F.get(p, F.lit(int(benign_code)))).alias("attack_probability"),
                         (F.array_max(p) * 100).alias("confidence"), kind.alias("attack_type"))


def predict_batch(model, df: DataFrame) -> DataFrame:
    """As ``predict``; empty without a model."""
    return predict(model, df) if model is not None else predict(None, df).limit(0)


def feature_importance(spark, model: PipelineModel, n: int = 20) -> DataFrame:
    """the features with the highest importance; as many rows as the model has features at most."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(names, values)]
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(n))


def model_info(spark, model: PipelineModel | None, metadata: dict | None = None) -> DataFrame:
    """One row about a model."""
    meta = metadata or {}
    stage = model.stages[-1] if model is not None else None
    row = (model is not None, meta.get("model_type") or (type(stage).__name__ if stage else None),
           stage.numFeatures if stage else 0, getattr(stage, "getNumTrees", 1 if stage else 0),
           meta.get("training_date"), meta.get("accuracy"))
    return spark.createDataFrame([row], "is_trained boolean, model_type string, features int, trees int, "
                                        "training_date string, accuracy double")


def train_job(spark, flows: DataFrame, cfg: TrainingConfig = TrainingConfig()):
    """Prepare, optionally balance, split, train, and report on the test part.

    ``samples_per_file`` bounds the rows of each source file that the model is fitted on; validation and test always use
    all of theirs. It needs a ``source_file`` column.

    Gives the model, a metadata dict and a dict of result tables.
    """
    from tidegauge.sources.flows import sample_per_group

    df = prepare_flows(flows)
    if cfg.samples_per_file and "source_file" not in df.columns:
        raise ValueError("samples_per_file needs a source_file column")
    if cfg.balance:
        df = balance(df, cfg.benign_ratio, cfg.seed)
    # Every later step (weights, fit iterations, three evaluations) reads the prepared rows again.
    parts = settle(split(_binary(df), cfg.fractions, cfg.seed, "code"))
    train_rows, val_rows, test_rows = (parts.filter(F.col("split") == s) for s in SPLITS)
    if cfg.samples_per_file:
        train_rows = settle(sample_per_group(train_rows, "source_file", cfg.samples_per_file, cfg.seed))
    train_rows, val_rows, test_rows = (p.drop("source_file") for p in (train_rows, val_rows, test_rows))
    model, metrics = train(train_rows, cfg, val_rows)
    scored = model.transform(test_rows).select(F.col("code").alias("label"), "prediction")
    tables = {"validation": metrics, "test_confusion": evaluate.confusion(scored),
              "test_report": evaluate.class_report(scored), "test": model_metrics(model, test_rows),
              "importance": feature_importance(spark, model)}
    meta = {"model_type": cfg.model_type, "features": model.stages[0].getInputCols(), "num_trees": cfg.num_trees,
            "max_depth": cfg.max_depth, "min_leaf": cfg.min_leaf, "seed": cfg.seed,
            "training_date": time.strftime("%Y-%m-%d %H:%M:%S"), "accuracy": metrics.first().accuracy}
    return model, meta, tables


def with_folds(df: DataFrame, folds: int = 5, seed: int = 42, label: str = "code") -> DataFrame:
    """Adds ``fold`` (0 to folds - 1), dealt in turn to the rows of every label by rank of a content hash."""
    ranked = _hash_numbered(df, [label], seed)
    return ranked.withColumn("fold", F.pmod(F.col("__i") - 1, F.lit(folds)).cast("int")).drop("__i", "__h")


def cross_validate(df: DataFrame, cfg: TrainingConfig = TrainingConfig(), folds: int = 5, features=None):
    """One model per fold, fitted on the others; gives the models and their metrics as one table (a row per fold).

    Every row is in one test fold, and every label is spread evenly over the folds. Class weights are those of the rows
    that a model is fitted on.
    """
    features = features or [f for f in FEATURES if f in df.columns]
    dealt = settle(with_folds(_binary(df).select(*[C.feature(f) for f in features], "code"), folds, cfg.seed))
    models, table = [], None
    for k in range(folds):
        test = dealt.filter(F.col("fold") == k)
        model, metrics = train(dealt.filter(F.col("fold") != k), cfg, test, features)
        row = metrics.select(F.lit(k).alias("fold"), F.lit(test.count()).alias("rows"), "*")
        models.append(model)
        table = row if table is None else table.unionByName(row)
    return models, table


def anova(df: DataFrame, features=None, label: str = "label") -> DataFrame:
    """ANOVA of every feature over the classes, as (feature, f, between, within), from one aggregation of the rows.

    Sums are those of squared differences from the means. ``f`` is infinite where a feature varies between classes only,
    and null where it does not vary at all or there are fewer than two classes.
    """
    features = features or [f for f in FEATURES if f in df.columns]
    per = df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(C.feature(f)).alias("m"), F.var_pop(C.feature(f)).alias("v")).alias(f"s{i}")
                                        for i, f in enumerate(features)])
    stats = per.select("n", F.posexplode(F.array(*[f"s{i}" for i in range(len(features))])).alias("i", "s"))
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("s.m")) / F.sum("n")
    # One row per class and feature; sums between classes are taken around the mean of all rows.
    mean = stats.groupBy("i").agg(m.alias("mean"))
    sums = stats.join(F.broadcast(mean), "i").groupBy("i").agg(
        n.alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("s.v")).alias("within"),
        F.sum(F.col("n") * (F.col("s.m") - F.col("mean")) * (F.col("s.m") - F.col("mean"))).alias("between"))
    above, below = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))
    f = F.when((F.col("k") > 1) & (F.col("within") > 0), above / F.when(F.col("n") > F.col("k"), below)).when(
        (F.col("k") > 1) & (F.col("between") > 0), F.lit(float("inf")))
    names = F.array(*[F.lit(x) for x in features])
    return sums.select(F.get(names, F.col("i")).alias("feature"), f.alias("f"), "between", "within")


def select_by_anova(df: DataFrame, n: int = 20, features=None):
    """Names of the n features with the highest ANOVA F value; of equal values in the order of the names."""
    top = anova(_binary(df), features, "code").filter("f is not null").orderBy(F.desc("f"), "feature").limit(n)
    return [r.feature for r in top.collect()]


# -- rules -----------------------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, key: str, columns, shares, bins: int = 256) -> DataFrame:
    """Of every key and column the least value at or below which each share of the key's rows lies.

    Gives (key, column, share, value). An approximate histogram over all rows cuts every column into ``bins``; the values
    are counted per bin, and only the bins in which a share is reached are put in order. Nulls do not count.
    """
    edges = df.agg(*[F.percentile_approx(C.feature(c), [i / bins for i in range(1, bins)], 10_000).alias(f"e{i}")
                     for i, c in enumerate(columns)]).first()
    out = None
    for i, c in enumerate(columns):
        cuts = sorted(set(edges[f"e{i}"] or []))
        rows = df.select(F.col(key).alias(key), C.feature(c).cast("double").alias("value")).filter("value is not null")
        place = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda e: e <= F.col("value")))
        rows = rows.withColumn("__bin", place)
        counts = rows.groupBy(key, "__bin").agg(F.count(F.lit(1)).alias("__n"))
        along = Window.partitionBy(key)
        before = along.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(key, "__bin", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                               F.sum("__n").over(along).alias("__all"))
        want = counts.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        want = want.withColumn("__rank", F.greatest(F.ceil(F.col("__all") * F.col("share") - F.lit(1e-9)), F.lit(1)))
        want = want.filter((F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__n")))
        inside = Window.partitionBy(key, "__bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Equal values are one row with a count, so a frequent value is no hot key.
        met = key_join(rows, want.select(key, "__bin").distinct(), [key, "__bin"], "left_semi")
        ranked = met.groupBy(key, "__bin", "value").agg(F.count(F.lit(1)).alias("__m")).withColumn("__upto", F.sum("__m").over(inside))
        found = key_join(ranked, want, [key, "__bin"], extra=(F.col("__before") + F.col("__upto") >= F.col("__rank"))
                         & (F.col("__before") + F.col("__upto") - F.col("__m") < F.col("__rank")))
        one = found.select(key, F.lit(c).alias("column"), "share", "value")
        out = one if out is None else out.unionByName(one)
    return out


def mine_signatures(flows: DataFrame, features, low: float = 0.05, high: float = 0.95, sure: float = 90.0,
                    min_match: float = 0.9, max_false: float = 0.001, extremes: bool = False) -> DataFrame:
    """Per attack type a box of feature bounds from flows predicted with high confidence.

    ``flows`` has ``attack_type``, ``confidence`` and ``label``. Bounds are exact quantiles (``extremes`` takes the least and
    the greatest value instead). ``matched`` is the share of the type's flows inside its box, ``false_rate`` the share of
    benign flows; ``keep`` tells whether both limits hold. The boxes, one per attack type, are held against all flows in
    one scan.
    """
    attack = flows.filter((F.col("attack_type") != "BENIGN") & (F.col("confidence") > sure))
    if extremes:
        boxes = attack.groupBy("attack_type").agg(
            F.array(*[F.min(C.feature(c)).cast("double") for c in features]).alias("low"),
            F.array(*[F.max(C.feature(c)).cast("double") for c in features]).alias("high"))
    else:
        bounds = exact_quantiles(attack, "attack_type", features, [low, high])
        boxes = bounds.groupBy("attack_type").agg(*[F.array(*[
            F.max(F.when((F.col("column") == c) & (F.col("share") == F.lit(float(q))), F.col("value"))) for c in features]).alias(n)
            for n, q in (("low", low), ("high", high))])
    rows = boxes.orderBy("attack_type").collect()
    schema = "attack_type string, low array<double>, high array<double>, matched double, false_rate double, keep boolean"
    if not rows:
        return flows.sparkSession.createDataFrame([], schema)
    box = F.array(*[F.struct(F.lit(r.attack_type).alias("t"), F.lit(list(r.low)).cast("array<double>").alias("low"),
                             F.lit(list(r.high)).cast("array<double>").alias("high")) for r in rows])
    value = F.array(*[C.feature(c).cast("double") for c in features])
    seen = flows.select("attack_type", C.is_benign("label").alias("__benign"), value.alias("__v"), F.explode(box).alias("b"))
    inside = F.coalesce(F.forall(F.arrays_zip("__v", F.col("b.low").alias("l"), F.col("b.high").alias("h")),
                                 lambda z: z["__v"].between(z["l"], z["h"])), F.lit(False))
    mine = F.col("attack_type") == F.col("b.t")
    out = seen.groupBy(F.col("b.t").alias("attack_type"), F.col("b.low").alias("low"), F.col("b.high").alias("high")).agg(
        C.ratio(F.count_if(mine & inside), F.count_if(mine)).alias("matched"),
        C.ratio(F.count_if(F.col("__benign") & inside), F.count_if("__benign")).alias("false_rate"))
    return out.withColumn("keep", (F.col("matched") >= min_match) & (F.col("false_rate") < max_false))


# The documented example rule.
UDP_FLOOD_RULE = ("`Total Fwd Packets` > 200 AND `Down/Up Ratio` < 0.05 AND `Flow Packets/s` > 100 "
                  "AND `Packet Length Variance` < 10")


def apply_rules(flows: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Adds ``matched_rules``, the names of the rules (SQL predicates) a flow meets."""
    rules = rules or {"udp_flood": UDP_FLOOD_RULE}
    hits = [F.when(F.expr(text), F.lit(name)) for name, text in rules.items()]
    return flows.withColumn("matched_rules", F.array_compact(F.array(*hits)))


# Packets per second by verdict.
TOKEN_RATES = {"benign": 50_000, "anomaly": 5_000, "attack": 1_000}


def token_bucket(packets: DataFrame, verdict: str = "state", rates=None) -> DataFrame:
    """Adds ``shaped``: beyond the source's tokens of that second. Tokens are not carried over."""
    from tidegauge.operators.traffic import numbered_in_second
    rates = rates or TOKEN_RATES
    tokens = F.try_element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col(verdict))
    shaped = F.coalesce(F.col("__i") > tokens, F.lit(False))
    return numbered_in_second(packets).withColumn("shaped", shaped).drop("__i")
