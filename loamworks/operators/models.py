"""Models of the dashboard, on MLlib."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSIFIERS = {
    "logistic": lambda: C.LogisticRegression(maxIter=50), "forest": lambda: C.RandomForestClassifier(numTrees=20, seed=42), "boosting": lambda: C.GBTClassifier(maxIter=10, seed=42), "tree": lambda: C.DecisionTreeClassifier(seed=42), "svc": lambda: C.LinearSVC(maxIter=30), "bayes": lambda: C.NaiveBayes(modelType="gaussian"),
}
REGRESSORS = {
    "linear": lambda: R.LinearRegression(), "ridge": lambda: R.LinearRegression(regParam=1.0, elasticNetParam=0.0), "lasso": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=1.0), "forest": lambda: R.RandomForestRegressor(numTrees=20, seed=42), "boosting": lambda: R.GBTRegressor(maxIter=10, seed=42), "tree": lambda: R.DecisionTreeRegressor(seed=42),
}


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """The rows with is_test: of each class the rows with the smallest hashes of their keys, `test_share` of it rounded.

    Ranks are taken within (class, range of hashes): counts of ranges give each range's first rank, so a class
    with a third of all rows is not ordered by one task.
    """
    h = F.xxhash64(F.lit(seed), *key)
    d = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 54).cast("int"))
    counts = d.groupBy(F.col(label).alias("_l"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_l").orderBy("_b")
    starts = counts.select("_l", F.col("_b").alias("_c"), (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_s"), F.sum("_n").over(Window.partitionBy("_l")).alias("_t"))  # 1024 rows a class
    j = d.join(starts, d[label].eqNullSafe(starts["_l"]) & (d["_b"] == starts["_c"]))
    rank = F.col("_s") + F.row_number().over(Window.partitionBy("_l", "_b").orderBy("_h", *key))
    return j.withColumn("is_test", rank <= F.round(F.col("_t") * test_share)).drop("_h", "_b", "_l", "_c", "_s", "_t")


def pipeline(features: Sequence[str], model: object, scale: bool = True) -> Pipeline:
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="raw_features" if scale else "features", handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, model])


def train_classifier(df: DataFrame, label: str, features: Sequence[str], kind: str = "logistic") -> PipelineModel:
    model = CLASSIFIERS[kind]()
    return pipeline(features, model.setLabelCol(label).setFeaturesCol("features")).fit(df)


def train_regressor(df: DataFrame, label: str, features: Sequence[str], kind: str = "linear") -> PipelineModel:
    return pipeline(features, REGRESSORS[kind]().setLabelCol(label).setFeaturesCol("features")).fit(df)


def search(df: DataFrame, label: str, features: Sequence[str], kind: str, grid: dict[str, Sequence], folds: int = 3, task: str = "regression", sampled: int | None = None, seed: int = 42, parallelism: int = 2):
    """Grid search with cross validation, or a randomised one over `sampled` points of the grid; the fitted CrossValidatorModel."""
    model = (REGRESSORS if task == "regression" else CLASSIFIERS)[kind]().setLabelCol(label).setFeaturesCol("features")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    points = builder.build()
    if sampled is not None and sampled < len(points):
        points = random.Random(seed).sample(points, sampled)
    judge = RegressionEvaluator(labelCol=label) if task == "regression" else MulticlassClassificationEvaluator(labelCol=label)
    return CrossValidator(estimator=pipeline(features, model), estimatorParamMaps=points, evaluator=judge, numFolds=folds, seed=seed, parallelism=parallelism).fit(df)


def save(model: PipelineModel, path: str) -> str:
    """A fitted pipeline as a folder of the file system that the path names; overwrites."""
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importance(model: PipelineModel, features: Sequence[str], df: DataFrame, most: int = 20) -> DataFrame:
    """feature, importance: sizes of coefficients, or the trees' importances, the largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))[:most]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def pca(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """The rows with pc1 ... pck of their centred and scaled features; rows with a null feature are left out."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), PCA(k=k, inputCol="_std", outputCol="_pc")]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("_a", vector_to_array("_pc")).withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(k)}).drop("_raw", "_std", "_pc", "_a")
