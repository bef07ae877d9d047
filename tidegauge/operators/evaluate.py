"""Scores of predictions: confusion matrix and everything that follows from it."""

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import columns as C


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """D12"""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def confusion(df: DataFrame) -> DataFrame:
    """Rows per (label, prediction). The other scores read only this table."""
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(df: DataFrame, classes) -> DataFrame:
    """D13 with a column per predicted class."""
    return df.groupBy("label").pivot("prediction", list(classes)).count().na.fill(0)


def accuracy(df: DataFrame) -> DataFrame:
    """D14"""
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as label or prediction."""
    sides = confusion(df).select("rows", F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.lit(True).alias("is_label"), (F.col("label") == F.col("prediction")).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(False).alias("is_label"),
                 F.lit(False).alias("hit")))).alias("s")).select("rows", "s.*")
    per = sides.groupBy("class").agg(
        F.sum(F.when(F.col("hit"), F.col("rows")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("is_label"), F.col("rows")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_label"), F.col("rows")).otherwise(0)).alias("predicted"))
    out = per.withColumn("precision", C.ratio("tp", "predicted")).withColumn("recall", C.ratio("tp", "support"))
    both = F.col("precision") + F.col("recall")
    return (out.withColumn("f1", C.ratio(2 * F.col("precision") * F.col("recall"), both))
            .select("class", "precision", "recall", "f1", "support"))


def weighted_scores(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 averaged over the classes by support; 0 where undefined."""
    report = class_report(df)
    n = F.sum("support")
    return report.agg(*[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in ("precision", "recall", "f1")])


def binary_rates(df: DataFrame) -> DataFrame:
    """Rates of a 0/1 prediction."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    t = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
               F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    precision, recall = C.ratio("tp", F.col("tp") + F.col("fp")), C.ratio("tp", F.col("tp") + F.col("fn"))
    return t.select(recall.alias("tpr"), C.ratio("tn", F.col("tn") + F.col("fp")).alias("tnr"),
                    C.ratio("fp", F.col("tn") + F.col("fp")).alias("fpr"), precision.alias("precision"),
                    C.ratio(2 * precision * recall, precision + recall).alias("f1"))
