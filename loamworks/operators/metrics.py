"""Metrics of predictions as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.ranges import running


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mse, rmse, mae, r2, mape (over actual values not 0), mean and population deviation of the residuals."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    one = df.filter(y.isNotNull() & p.isNotNull()).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"), F.avg(F.when(y != 0, F.abs(e / y))).alias("mape"), F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"))
    return one.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "v")).alias("r2"), (100 * F.col("mape")).alias("mape"), "residual_mean", "residual_std")


def binary(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, specificity, f1 (guarded by 1e-8), log loss."""
    y, p = F.col(label).cast("int"), F.col(score).cast("double")
    hit = (p >= threshold).cast("int")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    one = df.agg(F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"), F.sum((1 - hit) * (1 - y)).alias("tn"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))
    g = F.lit(1e-8)
    out = one.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + g), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + g), "specificity": F.col("tn") / (F.col("tn") + F.col("fp") + g)})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + g))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support."""
    counts = confusion(df, actual, predicted)
    a = counts.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("found"))
    j = a.join(p, "class", "full").na.fill(0, ["support", "tp", "found"])
    precision, recall = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return j.select("class", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "support")


def multiclass(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, and precision, recall and f1 weighted by support."""
    c = per_class(df, actual, predicted)
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return c.agg(w("recall").alias("accuracy"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """class, n, and the ratio of the largest class to the smallest."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg((F.max("n") / F.min("n")).alias("imbalance"))
    return counts.crossJoin(F.broadcast(ends))  # one row


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin, mean score, share of positives, count over equal widths from 0 to 1."""
    at = F.least(F.floor(F.col(score) * bins) + 1, F.lit(bins)).cast("int")
    return df.filter(F.col(score).between(0, 1)).groupBy(at.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n"))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and precision-recall points, one for each distinct score, from the highest down; pos and neg are the score's own labels.

    Labels are summed by score first; running sums go range by range of scores.
    """
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).select("score", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    run = running(by, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    total = run.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    run = run.crossJoin(F.broadcast(total))  # one row
    return run.select("score", "pos", "neg", "tp", "fp", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "q").alias("fpr"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def auc(points: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, from (0, 0): each point's step right times its mean height."""
    return points.agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(points: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by steps: the sum of precision times the rise in recall."""
    return points.agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("pr_auc"))


def common_range(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Least and largest value over actual and predicted."""
    return df.agg(F.least(F.min(actual), F.min(predicted)).alias("lo"), F.greatest(F.max(actual), F.max(predicted)).alias("hi"))
