"""Regressors on the log of resolution hours: candidates, comparison, refit, storage."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnaround import schema
from turnaround.functions.numbers import finite_or_null
from turnaround.operators.boosting import Boosted
from turnaround.operators.encoding import encode_split, with_split
from turnaround.operators.evaluation import best_model, compare_models, predictions_table, regression_metrics, tidy_metrics
from turnaround.operators.features import numeric_columns
from turnaround.operators.forest import Forest
from turnaround.operators.joins import quoted
from turnaround.sources.storage import materialize, new_path

KEY, TARGET = "unique_key", schema.TARGET
LINEAR, FOREST, BOOSTED = "Linear Regression", "Random Forest", "Boosted Trees"
SMALL_FOREST = "Random Forest (25 trees)"


def model_inputs(features: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows and columns a model may use.

    Text columns other than the two encoded ones go, infinity and NaN become null, rows without a
    target are dropped. Key and target stay beside the features.
    """
    columns = []
    for f in features.schema.fields:
        c = quoted(f.name)
        if f.name in (KEY, target):
            columns.append(c)
        elif f.name in schema.ENCODED:
            columns.append(F.coalesce(c, F.lit(schema.UNKNOWN)).alias(f.name))
        elif f.name == "resolution_hours" or not isinstance(f.dataType, T.NumericType):
            continue
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            columns.append(finite_or_null(c).alias(f.name))
        else:
            columns.append(c)
    known = finite_or_null(F.col(target)).isNotNull()
    return features.where(known).select(*columns)


def feature_columns(encoded: DataFrame) -> list[str]:
    """Numeric columns in table order, without key and target."""
    return [c for c in numeric_columns(encoded) if c not in (KEY, TARGET)]


def align(df: DataFrame, saved: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """The saved feature columns in saved order, encoded names mapped back to their raw columns; columns
    of `keep` stay before them."""
    raw = {encoded: name for name, encoded in schema.ENCODED.items()}
    return df.select(*map(quoted, keep), *[quoted(raw.get(c, c)) for c in saved])


def linear() -> LinearRegression:
    """Ordinary least squares by the normal equations: one distributed pass, no iterations."""
    return LinearRegression(labelCol=TARGET, regParam=0.0, solver="normal")


def forest(
    trees: int = 200, depth: int = 20, min_leaf: int = 5, bins: int = 256, bootstrap: bool = True, seed: int = 42
) -> Forest:
    return Forest(
        labelCol=TARGET, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=bins,
        bootstrap=bootstrap, keyCol=KEY, seed=seed,
    )


def boosted(
    rounds: int = 300, depth: int = 7, step: float = 0.05, bins: int = 256,
    row_share: float = 0.8, column_share: float = 0.8, seed: int = 42,
) -> Boosted:
    return Boosted(
        labelCol=TARGET, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=row_share,
        featureShare=column_share, maxBins=bins, keyCol=KEY, seed=seed,
    )


def small_forest(trees: int = 25, depth: int = 10, min_leaf: int = 50, seed: int = 42) -> Forest:
    return forest(trees, depth, min_leaf, seed=seed)


def baseline() -> PipelineModel:
    """Predicts a request's encoded problem type: what any real model must beat."""
    return PipelineModel([SQLTransformer(statement="SELECT *, problem_type_encoded AS prediction FROM __THIS__")])


def default_candidates() -> dict[str, Estimator]:
    return {LINEAR: linear(), FOREST: forest(), BOOSTED: boosted()}


def _set_checkpoint(spark: SparkSession) -> None:
    """Boosting cuts its lineage every few rounds where a checkpoint folder is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(new_path(spark, "checkpoint"))


def fit(estimator: Estimator, train: DataFrame, features: list[str]) -> PipelineModel:
    _set_checkpoint(train.sparkSession)
    # The assembler reads a dot as field access; such columns are handed over under plain names.
    plain = {c: f"feature_{i}" for i, c in enumerate(features) if "." in c}
    renamed = ", ".join(f"`{c}` AS {name}" for c, name in plain.items())
    rename = [SQLTransformer(statement=f"SELECT *, {renamed} FROM __THIS__")] if plain else []
    assembler = VectorAssembler(inputCols=[plain.get(c, c) for c in features], outputCol="features", handleInvalid="error")
    return Pipeline(stages=[*rename, assembler, estimator]).fit(train)


def fit_and_score(
    name: str, estimator: Estimator, train: DataFrame, evaluation: DataFrame, features: list[str], stage: str
) -> tuple[PipelineModel, DataFrame]:
    """Fit on one frame, score another: the model and its tidy metrics."""
    model = fit(estimator, train, features)
    return model, tidy_metrics(regression_metrics(model.transform(evaluation)), stage, name)


def prepared_split(inputs: DataFrame, train: list[str], evaluation: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encoded train and evaluation frames of the named splits, and the encoding."""
    split = with_split(inputs, KEY)
    part_train = split.where(F.col("split").isin(train)).drop("split")
    part_eval = split.where(F.col("split").isin(evaluation)).drop("split")
    return encode_split(part_train, part_eval)


def compare_candidates(
    inputs: DataFrame, candidates: dict[str, Estimator], prepared: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Tidy validation metrics of each candidate, all fitted on the same 60 % of the rows; on `prepared`, which
    `prepared_split` made of the inputs, where given.

    The fits run side by side over the one stored training frame, each in a scheduler pool of its own:
    levels of a deep tree and rounds of boosting leave cores free, which the others use.
    """
    spark = inputs.sparkSession
    train, validation, _ = prepared or prepared_split(inputs, ["train"], ["validation"])
    features = feature_columns(train)
    _set_checkpoint(spark)

    @inheritable_thread_target(spark)
    def run(name: str) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        tidy = fit_and_score(name, candidates[name], train, validation, features, "validation")[1]
        return materialize(tidy, "validation-metrics")

    with ThreadPoolExecutor(len(candidates)) as pool:
        return reduce(DataFrame.unionByName, pool.map(run, candidates))


def refit(inputs: DataFrame, estimator: Estimator, features: list[str] | None = None) -> dict:
    """Fit on train and validation together, on `features` where given, in that order, else on every feature
    column: the model, and `test`, the held-out rows encoded for it."""
    train, test, encoding = prepared_split(inputs, ["train", "validation"], ["test"])
    features = features or feature_columns(train)
    return {"model": fit(estimator, train, features), "features": features, "encoding": encoding, "test": test}


def score_test(refitted: dict, name: str) -> dict:
    """What `refit` returned with its held-out rows scored."""
    scored = refitted["model"].transform(refitted["test"])
    return {
        "model": refitted["model"],
        "features": refitted["features"],
        "encoding": refitted["encoding"],
        "scored": scored,
        "metrics": tidy_metrics(regression_metrics(scored), "test", name),
        "predictions": predictions_table(scored, KEY),
    }


def final_test(inputs: DataFrame, name: str, estimator: Estimator, features: list[str] | None = None) -> dict:
    """Refit on train and validation together, score the held-out rows once; on `features` where given,
    in that order, else on every feature column."""
    return score_test(refit(inputs, estimator, features), name)


def train_best(inputs: DataFrame, candidates: dict[str, Estimator]) -> dict:
    """Compare on validation, refit the winner, score it on test: metrics, model and predictions."""
    validation = compare_candidates(inputs, candidates)
    comparison = compare_models(validation, list(candidates))
    best = best_model(comparison)
    result = final_test(inputs, best, candidates[best])
    return {**result, "best": best, "comparison": comparison, "metrics": validation.unionByName(result["metrics"])}


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature, greatest first, with its percent. One row per feature column.

    A linear model has none; its table is empty.
    """
    fitted = model.stages[-1]
    values = fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else []
    rows = sorted(zip(features, map(float, values)), key=lambda r: (-r[1], r[0]))
    table = [(i, n, v, round(v * 100, 1)) for i, (n, v) in enumerate(rows, start=1)]
    return spark.createDataFrame(table, "rank int, feature string, importance double, pct double")


def save_model(path: str, model: PipelineModel, features: list[str], encoding: DataFrame) -> None:
    """Model, ordered feature list and encodings side by side."""
    spark = encoding.sparkSession
    model.write().overwrite().save(f"{path}/model")
    encoding.write.mode("overwrite").parquet(f"{path}/encoding")
    rows = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def saved_features(spark: SparkSession, path: str) -> list[str]:
    return [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], DataFrame]:
    return PipelineModel.load(f"{path}/model"), saved_features(spark, path), spark.read.parquet(f"{path}/encoding")
