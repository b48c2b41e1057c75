"""Estimators on pyspark.ml, with predictions as columns of the rows they are for."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics
from .profile import profile_rate
from .temporal import in_fold, rolling_origin_folds

#: Rows among which a feature's values change places.
SHUFFLED = 100_000


def scaling(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a constant one gets deviation 1."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in features}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"_z_{c}": (F.col(c) - m) / s for c, (m, s) in scale.items()})


def _assembler(features: list[str], prefix: str = "_z_") -> VectorAssembler:
    return VectorAssembler(inputCols=[prefix + c for c in features], outputCol="_x", handleInvalid="keep")


class Fitted:
    """A fitted pipeline that adds `prediction` to a frame, on standardised features where it has a scale."""

    def __init__(self, model: PipelineModel, scale: dict[str, tuple[float, float]], drop: list[str]):
        self.model, self.scale, self.drop = model, scale, drop

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(scaled(df, self.scale) if self.scale else df).drop(*self.drop)


class Classifier(Fitted):
    """A fitted binary classifier that adds `score` and `predicted`."""

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(scaled(df, self.scale)).withColumn("score", vector_to_array("_p")[1])
        return out.withColumn("predicted", F.col("score") >= 0.5).drop(*self.drop)


class Constant:
    """What a classifier is that has seen one class alone: it adds that class as `score` and `predicted`."""

    def __init__(self, score: float):
        self.score = score

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"score": F.lit(self.score), "predicted": F.lit(self.score >= 0.5)})


def save(fitted: Fitted | Constant, path: str) -> None:
    """A model with what it needs to know about its features, in place of what is at the path. Classifiers and constants too."""
    about = {"kind": type(fitted).__name__} | ({"score": fitted.score} if isinstance(fitted, Constant) else {"scale": fitted.scale, "drop": fitted.drop})
    if not isinstance(fitted, Constant):
        fitted.model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> Fitted | Constant:
    about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
    if about["kind"] == "Constant":
        return Constant(about["score"])
    return {"Fitted": Fitted, "Classifier": Classifier}[about["kind"]](PipelineModel.load(f"{path}/model"), {k: tuple(v) for k, v in about["scale"].items()}, about["drop"])


def ridge(train: DataFrame, features: list[str], y: str, alpha: float):
    """A function that adds `prediction`: least squares plus alpha times squared weights, on standardised features."""
    train = train.dropna(subset=[*features, y])
    scale = scaling(train, features)
    n, spread = train.agg(F.count("*"), F.stddev_pop(y)).first()
    fit = LinearRegression(featuresCol="_x", labelCol=y, predictionCol="prediction", solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / n * (spread or 1.0))
    model = Pipeline(stages=[_assembler(features), fit]).fit(scaled(train, scale))
    return Fitted(model, scale, ["_x", *[f"_z_{c}" for c in features]])


def boosted(train: DataFrame, features: list[str], y: str, trees: int = 160, depth: int = 3, rate: float = 0.045, share: float = 1.0, leaf: int = 1, seed: int = 42):
    """A function that adds `prediction` of gradient-boosted trees."""
    fit = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, minInstancesPerNode=leaf, seed=seed)
    model = Pipeline(stages=[_assembler(features, ""), fit]).fit(train.dropna(subset=[*features, y]))
    return Fitted(model, {}, ["_x"])


def logistic(train: DataFrame, features: list[str], y: str):
    """A function that adds `score` and `predicted`: balanced classes, unit penalty, on standardised features. One class gives its constant."""
    train = train.dropna(subset=[*features, y]).withColumn("_y", F.col(y).cast("double"))
    n, pos = train.agg(F.count("*"), F.sum("_y")).first()
    if not n or not 0 < pos < n:
        return Constant(float(bool(n and pos)))
    scale = scaling(train, features)
    weighted = train.withColumn("_w", F.when(F.col("_y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", standardization=False, elasticNetParam=0.0, regParam=1.0 / n, maxIter=1000, tol=1e-9)
    model = Pipeline(stages=[_assembler(features), fit]).fit(scaled(weighted, scale))
    return Classifier(model, scale, ["_x", "_p", "rawPrediction", "prediction", *[f"_z_{c}" for c in features]])


def calibrated(fit: DataFrame, calibration: DataFrame, test: DataFrame, features: list[str], y: str, grid: list[float], hour: str | None = None) -> DataFrame:
    """test with score, the threshold and predicted. A model of the fit rows alone scores the calibration rows, of which the best f1 chooses the threshold; one of both scores the test rows.

    With `hour`, rows of the hours 0 to 5 have a threshold of their own, chosen on the calibration rows of those hours.
    """
    found = logistic(fit, features, y)(calibration)
    scored = logistic(fit.unionByName(calibration), features, y)(test).drop("predicted")
    if hour is not None:
        return metrics.by_hour_threshold(scored, "score", hour, metrics.night_thresholds(found, y, "score", hour, grid))
    best = metrics.best_threshold(metrics.threshold_metrics(found, y, "score", grid)).select("threshold")
    return scored.crossJoin(F.broadcast(best)).withColumn("predicted", F.col("score") >= F.col("threshold"))


def persistence(df: DataFrame, now: str) -> DataFrame:
    return df.withColumns({"score": F.col(now).cast("double"), "predicted": F.col(now)})


def classifier_row(df: DataFrame, model: str, y: str) -> DataFrame:
    """One row: model, rows, accuracy, precision, recall, f1, brier and average_precision."""
    one = df.agg(*metrics.classification_metrics(y, "predicted"), metrics.brier(y, "score"))
    return one.crossJoin(F.broadcast(metrics.average_precision(df, y, "score"))).select(F.lit(model).alias("model"), "*")


def suite(train: DataFrame, test: DataFrame, features: list[str], y: str, now: str, profile_keys: list[str]) -> DataFrame:
    """Persistence, profile rate and logistic, a row each, best first by f1, then average precision, then name."""
    rates = profile_rate(train, test, profile_keys, y).withColumn("score", F.col("rate"))
    rows = [classifier_row(persistence(test, now), "persistence", y), classifier_row(rates, "profile", y), classifier_row(logistic(train, features, y)(test), "logistic", y)]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("f1"), F.desc("average_precision"), "model")


def ablation(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], y: str) -> DataFrame:
    rows = [classifier_row(logistic(train, f, y)(test), name, y) for name, f in sets.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("average_precision"), "model")


def rolling_audit(df: DataFrame, at: str, times: list, features: list[str], y: str, now: str, profile_keys: list[str], folds: int = 3) -> DataFrame | None:
    """The suite on each expanding fold; None when there are too few times."""
    rows = []
    for fold in rolling_origin_folds(times, folds):
        part = in_fold(df, at, fold)
        found = suite(part.where("split = 'train'"), part.where("split = 'test'"), features, y, now, profile_keys)
        rows.append(found.withColumn("fold", F.lit(fold[0])))
    return reduce(DataFrame.unionByName, rows) if rows else None


def scenarios(df: DataFrame, model, overrides: dict[str, dict[str, Column]]) -> DataFrame:
    """Mean prediction under each scenario, whose columns take the place of the rows' own."""
    rows = [model(df.withColumns(o) if o else df).agg(F.lit(name).alias("scenario"), F.avg(F.greatest("prediction", F.lit(0.0))).alias("mean_prediction")) for name, o in overrides.items()]
    return reduce(DataFrame.unionByName, rows)


def permutation_importance(df: DataFrame, model, features: list[str], y: str, key: str, repeats: int = 12, seed: int = 23) -> DataFrame:
    """(feature, importance, spread): mean and deviation, over repeats, of the rise of the mean absolute error when a feature's values change places.

    Values change places inside groups of about SHUFFLED rows, which the key's hash makes and no task needs to put all rows in order for. One
    window a repeat puts a group's rows in an order of its own; what each row is given are the features of the row at its place in that
    order, all at once. Then each row is scored once as it is and once for each feature and repeat, in one plan over one scan. Columns are kept
    apart, whatever their names. `model` adds `prediction`.
    """
    n = df.count()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(max(1, math.ceil(n / SHUFFLED)))))
    place = rows.withColumn("_at", F.row_number().over(_order(F.col("_key"))))
    values = F.struct(*[F.col(f"_row.`{f}`").alias(f) for f in features])
    given = rows.select("_group", values.alias("values"), *[F.row_number().over(_order(F.xxhash64(F.lit(seed + r), F.col("_key")))).alias(f"_at_{r}") for r in range(repeats)])
    donors = F.explode(F.array(*[F.struct(F.col(f"_at_{r}").alias("at"), F.lit(r).alias("r")) for r in range(repeats)]))
    given = given.select("_group", "values", donors.alias("d")).select("_group", "values", F.col("d.at").alias("_at"), "d.r")
    given = given.groupBy("_group", "_at").agg(F.map_from_entries(F.collect_list(F.struct("r", "values"))).alias("_given"))
    both = place.join(given, ["_group", "_at"])
    cases = [F.struct(F.lit(None).cast("string").alias("feature"), F.lit(-1).alias("repeat"), F.col("_row").alias("row"))]
    for f in features:
        for r in range(repeats):
            other = F.struct(*[(F.element_at("_given", F.lit(r)).getField(f) if c == f else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])
            cases.append(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), other.alias("row")))
    each = both.select(F.explode(F.array(*cases)).alias("_case")).select(F.col("_case.feature").alias("_feature"), F.col("_case.repeat").alias("_repeat"), "_case.row.*")
    maes = model(each).groupBy("_feature", "_repeat").agg(F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("mae"))
    base = maes.where("_repeat < 0").select(F.col("mae").alias("base"))
    rises = maes.where("_repeat >= 0").crossJoin(F.broadcast(base)).select(F.col("_feature").alias("feature"), (F.col("mae") - F.col("base")).alias("rise"))
    return rises.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("spread"))


def _order(column):
    return Window.partitionBy("_group").orderBy(column, "_key")
