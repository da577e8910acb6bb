"""Model fitting, search and persistence on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkworks.operators.metrics import classification_metrics, regression_metrics
from sparkworks.operators.prep import stratified_split
from sparkworks.operators.ranges import settle, with_rank_in
from sparkworks.operators.text import knn_join


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(df)


def weighed(df: DataFrame, label: str, columns: Sequence[str], name: str = "weight") -> DataFrame:
    """The distinct rows of label and columns, with their count: a fit with these weights is the fit of all rows, except where it draws rows."""
    return df.groupBy(label, *columns).agg(F.count("*").cast("double").alias(name))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly by a hash of the key: a fit that passes over them again and again keeps all cores busy, whatever the files' row groups."""
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def logistic_regression(n_rows: int, c: float = 1.0, **params) -> LogisticRegression:
    """L2 with strength 1 / C over the sum of losses, which is 1 / (C n) over their mean."""
    return LogisticRegression(regParam=1.0 / (c * n_rows), elasticNetParam=0.0, standardization=False, **params)


def linear_regression(**params) -> LinearRegression:
    return LinearRegression(regParam=0.0, **params)


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of one feature."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def linear_l1_gd(df: DataFrame, x: str, y: str, lr: float = 0.01, epochs: int = 200, weight: float = 0.0, bias: float = 0.0, every: int = 10) -> tuple[float, float, list[tuple[int, float]]]:
    """Subgradient descent on the mean absolute error: (weight, bias, [(epoch, loss)]).  One aggregate over a cached frame per epoch."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop().persist()
    trace = []
    try:
        for epoch in range(epochs):
            gap = F.lit(weight) * F.col("x") + F.lit(bias) - F.col("y")
            r = rows.agg(F.avg(F.abs(gap)).alias("loss"), F.avg(F.signum(gap) * F.col("x")).alias("dw"), F.avg(F.signum(gap)).alias("db")).first()
            if epoch % every == 0:
                trace.append((epoch, r["loss"]))
            weight, bias = weight - lr * r["dw"], bias - lr * r["db"]
    finally:
        rows.unpersist()
    return weight, bias, trace


def decision_tree(classifier: bool = True, impurity: str | None = None, **params):
    return DecisionTreeClassifier(impurity=impurity or "gini", **params) if classifier else DecisionTreeRegressor(**params)


def random_forest(classifier: bool = True, trees: int = 100, seed: int = 0, **params):
    return (RandomForestClassifier if classifier else RandomForestRegressor)(numTrees=trees, seed=seed, **params)


def gradient_boosting(rounds: int = 100, rate: float = 0.8, depth: int = 5, seed: int = 0, **params) -> GBTClassifier:
    """Binary only; deep trees cost much, so the depth has a modest default."""
    return GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, **params)


def importances(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """feature and importance, largest first: impurity of trees, or absolute coefficients of linear models."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(np.asarray(model.coefficients.toArray()))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def knn_classify(points: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    """Majority vote of the k nearest, the smallest class of equals."""
    near = knn_join(queries, points, k, key, key, vector)
    voted = near.join(points.select(key, label), key)
    return voted.groupBy(f"query_{key}").agg(F.mode(label, True).alias("pred"))


def knn_regress(points: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    near = knn_join(queries, points, k, key, key, vector)
    return near.join(points.select(key, label), key).groupBy(f"query_{key}").agg(F.avg(label).alias("pred"))


def k_distance(points: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """Mean distance to the nearest, second nearest, ... neighbour."""
    return knn_join(queries, points, k, key, key, vector).groupBy("rank").agg(F.avg("distance").alias("mean_distance"))


def bernoulli_nb(**params) -> NaiveBayes:
    return NaiveBayes(modelType="bernoulli", smoothing=1.0, **params)


def bernoulli_counts(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Smoothed log probabilities in long form: class, feature, log_prob (of a one), log_prior.

    Features are 0/1 columns; (ones + 1) / (rows + 2) for every class.
    """
    sums = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in features))
    total = df.agg(F.count("*").alias("all"))
    long = sums.unpivot(["class", "n"], list(features), "feature", "ones").crossJoin(F.broadcast(total))
    return long.select("class", "feature", F.log((F.col("ones") + 1) / (F.col("n") + 2)).alias("log_prob"), F.log(F.col("n") / F.col("all")).alias("log_prior"))


def bernoulli_terms(present: DataFrame, labels: DataFrame, terms: DataFrame, key: str, label: str) -> DataFrame:
    """A fitted model in long form: class, term, log_one, log_zero, log_prior for every class and each of the given terms.

    ``present`` has a row (key, term) for each different term of a document,
    and ``labels`` a row (key, label) for each document.  The classes are few
    and the terms as many as were chosen; their grid is broadcast by neither.
    """
    held = labels.select(key, F.col(label).alias("class"))
    sizes = held.groupBy("class").agg(F.count("*").alias("n"))
    total = held.agg(F.count("*").alias("all"))
    ones = present.join(held, key).groupBy("class", "term").agg(F.count("*").alias("ones"))
    grid = terms.select("term").crossJoin(F.broadcast(sizes.crossJoin(total)))
    p = (F.coalesce("ones", F.lit(0)) + 1) / (F.col("n") + 2)
    return grid.join(ones, ["class", "term"], "left").select("class", "term", F.log(p).alias("log_one"), F.log(1 - p).alias("log_zero"), F.log(F.col("n") / F.col("all")).alias("log_prior"))


def bernoulli_predict(present: DataFrame, keys: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, pred, score): the class of the highest log probability, the smallest of equals, for documents with no term too."""
    base = model.groupBy("class").agg((F.any_value("log_prior") + F.sum("log_zero")).alias("base"))
    gain = model.select("class", "term", (F.col("log_one") - F.col("log_zero")).alias("gain"))
    gains = present.join(gain, "term").groupBy(key, "class").agg(F.sum("gain").alias("gain"))
    scored = keys.select(key).crossJoin(F.broadcast(base)).join(gains, [key, "class"], "left").withColumn("score", F.col("base") + F.coalesce("gain", F.lit(0.0)))
    return scored.groupBy(key).agg(F.min_by("class", F.struct(-F.col("score"), F.col("class"))).alias("pred"), F.max("score").alias("score"))


def gaussian_nb(**params) -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", **params)


def gaussian_nb_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """class, feature, mean and population variance plus 1e-9 of the largest variance of a feature."""
    most = df.agg(F.greatest(*(F.var_pop(c) for c in features), F.lit(0.0)).alias("most"))
    wide = df.groupBy(F.col(label).alias("class")).agg(*(F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(c) for c in features))
    long = wide.unpivot(["class"], list(features), "feature", "s").crossJoin(F.broadcast(most))
    return long.select("class", "feature", F.col("s.mean").alias("mean"), (F.col("s.var") + F.col("most") * 1e-9).alias("var"))


def linear_svm(n_rows: int, c: float = 1.0, **params) -> LinearSVC:
    return LinearSVC(regParam=1.0 / (c * n_rows), standardization=False, **params)


#: Most Fourier features that are made a batch at a time; of more, a batch of rows would take up too much memory.
WAVES = 1000


def fourier_weights(gamma: float, dims: int, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n, dims) and shifts of random Fourier features."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (n, dims)), rng.uniform(0, 2 * np.pi, n)


def fourier_features(df: DataFrame, vector: str, gamma: float, dims: int, n: int = 100, seed: int = 0, name: str = "fourier") -> DataFrame:
    """Random Fourier features of the RBF kernel exp(-gamma |x - y|^2): sqrt(2 / n) cos(w x + b)."""
    w, b = fourier_weights(gamma, dims, n, seed)
    x = vector_to_array(vector)
    if n > WAVES:
        rows = F.array(*(F.array(*(F.lit(float(v)) for v in [*row, shift])) for row, shift in zip(w, b, strict=True)))
        wave = lambda r: F.cos(F.aggregate(F.zip_with(F.slice(r, 1, dims), x, lambda u, v: u * v), F.element_at(r, -1), lambda s, v: s + v))
        return df.withColumn(name, array_to_vector(F.transform(rows, lambda r: wave(r) * F.lit(float(np.sqrt(2 / n))))))

    @F.pandas_udf("array<double>")
    def waves(points: pd.Series) -> pd.Series:
        held = np.stack(points.to_list()) if len(points) else np.zeros((0, dims))
        angle = np.tile(b, (len(held), 1))
        for k in range(dims):
            angle += held[:, k : k + 1] * w[:, k]
        return pd.Series(list(np.cos(angle) * np.sqrt(2 / n)))

    return df.withColumn(name, array_to_vector(waves(x)))


def rbf_svm(n_rows: int, c: float = 1.0, features: str = "fourier", **params) -> LinearSVC:
    """A linear machine on ``fourier_features``: an approximation of the kernel machine."""
    return linear_svm(n_rows, c, featuresCol=features, **params)


#: Rows to a pack, and to a part of packs: what a task holds of the points at once.
PACK, PART = 32_768, 1_000_000


def packed(df: DataFrame, label: str, columns: Sequence[str], weight: str = "weight") -> DataFrame:
    """Rows of (label, fourier), each a pack of rows: weights with the label's sign, and the points of which features are made.

    A fit passes over them a hundred times; they are a few numbers a row, not a row's many features.
    """
    names = [*columns]

    def run(batches):
        for batch in batches:
            of, points = batch[label].to_numpy(False), np.stack([batch[c].to_numpy(False) for c in names], axis=1).astype(float)
            if np.isnan(points).any() or np.isnan(of.astype(float)).any():
                raise ValueError("a label or a point is null or NaN")
            signed = np.where(of > 0, 1.0, -1.0) * batch[weight].to_numpy(False)
            packs = [(signed[k : k + PACK].tobytes(), points[k : k + PACK].tobytes()) for k in range(0, len(signed), PACK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*packs, strict=True) if packs else ((), ()))], ["label", "fourier"])

    held = settle(df.select(label, weight, *names))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-held.count() // PART))
    return held.repartition(parts, *names).mapInArrow(run, "label binary, fourier binary")


class RbfMachine(Estimator):
    """The linear machine of ``rbf_svm``, fitted on packs of points; features are made anew, some rows at a time, for each pass.

    The objective is that of LinearSVC, the mean hinge loss plus 1 / (2 C n) times the squared weights (not the intercept),
    and so is the end: after 100 steps, or when 20 gain less than 1e-6.  Steps are those of L-BFGS.  Large tables
    are begun on ``first`` packs; the steps that count see all rows.  Passes use single precision, predictions double.
    """

    def __init__(self, columns: Sequence[str], gamma: float, n: int = 100, c: float = 1.0, seed: int = 0, steps: int = 100, tolerance: float = 1e-6, first: int = 16):
        super().__init__()
        self.columns, self.c, self.steps, self.tolerance, self.first = [*columns], c, steps, tolerance, first
        self.waves = fourier_weights(gamma, len(self.columns), n, seed)
        self.trace: list[tuple[float, int]] = []

    def _fit(self, dataset: DataFrame) -> RbfModel:
        packs = settle(dataset)
        at = np.zeros(len(self.waves[1]) + 1)
        if packs.count() > 4 * self.first:
            at = self._descend(settle(packs.limit(self.first).repartition(self.first)), at)
        return RbfModel(self.columns, self.waves, self._descend(packs, at))

    def _value(self, packs: DataFrame, at: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Rows, their sum of losses and its slope."""
        w, b = (x.astype(np.float32) for x in self.waves)
        v, c, dims = (at[:-1] * np.sqrt(2 / len(b))).astype(np.float32), float(at[-1]), len(self.columns)

        def run(batches):
            rows, loss, slope = 0.0, 0.0, np.zeros(len(b) + 1)
            for batch in batches:
                for k in range(batch.num_rows):
                    signed = np.frombuffer(batch["label"][k].as_py(), float)
                    points = np.frombuffer(batch["fourier"][k].as_py(), float).reshape(-1, dims).astype(np.float32)
                    for i in range(0, len(signed), 4096):
                        own = signed[i : i + 4096]
                        wave = points[i : i + 4096] @ w.T
                        wave += b
                        np.cos(wave, out=wave)
                        gap = 1 - np.sign(own) * (wave @ v + c)
                        pull = np.where(gap > 0, own, 0.0)
                        rows += float(np.abs(own).sum())
                        loss += float(np.abs(pull) @ gap)
                        slope[:-1] -= pull.astype(np.float32) @ wave
                        slope[-1] -= pull.sum()
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([loss]), pa.array([slope.tolist()], pa.list_(pa.float64()))], ["rows", "loss", "slope"])

        found = packs.mapInArrow(run, "rows double, loss double, slope array<double>").collect()
        slope = np.sum([r["slope"] for r in found], axis=0)
        slope[:-1] *= np.sqrt(2 / len(b))
        return sum(r["rows"] for r in found), sum(r["loss"] for r in found), slope

    def _descend(self, packs: DataFrame, at: np.ndarray) -> np.ndarray:
        def value(x):
            rows, loss, slope = self._value(packs, x)
            own = np.append(x[:-1], 0.0) / (self.c * max(rows, 1))
            self.trace.append((loss / max(rows, 1) + 0.5 * float(own @ x), int(rows)))
            return self.trace[-1][0], slope / max(rows, 1) + own

        now, slope = value(at)
        values, moves = [now], []
        for _ in range(self.steps):
            # The two loops of L-BFGS over the last ten moves.
            way, held = -slope, []
            for move, turn in reversed(moves):
                share = (move @ way) / (move @ turn)
                held.append(share)
                way = way - share * turn
            if moves:
                way = way * ((moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]))
            for (move, turn), share in zip(moves, reversed(held), strict=True):
                way = way + (share - (turn @ way) / (move @ turn)) * move
            fall = float(way @ slope)
            if fall >= 0:
                if not moves:
                    break
                moves = []
                continue
            # Bisection for a step that lessens the value enough and the slope along the way; the loss has kinks.
            low, high, step, best = 0.0, np.inf, 1.0 if moves else 1 / max(float(np.linalg.norm(slope)), 1e-12), None
            for _ in range(20):
                there, then = value(at + step * way)
                if there > now + 1e-4 * step * fall:
                    high = step
                else:
                    best = (step, there, then)
                    if float(way @ then) >= 0.9 * fall:
                        break
                    low = step
                step = (low + high) / 2 if np.isfinite(high) else 2 * low
            if best is None:
                if not moves:
                    break
                moves = []
                continue
            step, now, then = best
            move, turn = step * way, then - slope
            if move @ turn > 1e-12 * float(turn @ turn):
                moves = [*moves[-9:], (move, turn)]
            at, slope = at + move, then
            values.append(now)
            # As in LinearSVC, against the value at zero, which is 1.
            if len(values) > 20 and values[-21] - now <= self.tolerance:
                break
        return at


class RbfModel(Model):
    """Predictions 0 and 1 by the sign of the machine's sum, from the columns of the points."""

    def __init__(self, columns: list[str], waves: tuple[np.ndarray, np.ndarray], at: np.ndarray):
        super().__init__()
        self.columns, self.waves, self.coefficients, self.intercept = columns, waves, at[:-1], float(at[-1])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        (w, b), v, c = self.waves, self.coefficients * np.sqrt(2 / len(self.waves[1])), self.intercept

        @F.pandas_udf("double")
        def side(*points: pd.Series) -> pd.Series:
            held = np.stack(points, axis=1).astype(float)
            if np.isnan(held).any():
                raise ValueError("a point is null or NaN")
            return pd.Series((np.cos(held @ w.T + b) @ v + c > 0).astype(float))

        return dataset.withColumn("prediction", side(*self.columns))


def mlp_classifier(layers: Sequence[int], seed: int = 0, iterations: int = 100, **params) -> MultilayerPerceptronClassifier:
    """Sigmoid hidden units, fitted by L-BFGS."""
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=iterations, **params)


class CentredPca:
    """Principal components of mean-centred vectors, with the way back."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, variance: np.ndarray):
        self.mean, self.components, self.explained_variance = mean, components, variance

    def _apply(self, df: DataFrame, vector: str, name: str, matrix: np.ndarray, before: np.ndarray, after: np.ndarray) -> DataFrame:
        rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in matrix))
        x = F.zip_with(vector_to_array(vector), F.array(*(F.lit(float(v)) for v in before)), lambda a, m: a - m)
        dots = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, x, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v))
        return df.withColumn(name, array_to_vector(F.zip_with(dots, F.array(*(F.lit(float(v)) for v in after)), lambda a, m: a + m)))

    def transform(self, df: DataFrame, vector: str = "features", name: str = "pca") -> DataFrame:
        return self._apply(df, vector, name, self.components.T, self.mean, np.zeros(self.components.shape[1]))

    def inverse(self, df: DataFrame, vector: str = "pca", name: str = "restored") -> DataFrame:
        return self._apply(df, vector, name, self.components, np.zeros(self.components.shape[1]), self.mean)


def pca(df: DataFrame, k: int = 2, vector: str = "features") -> CentredPca:
    from pyspark.ml.stat import Summarizer

    fitted = PCA(k=k, inputCol=vector, outputCol="_pca").fit(df)
    mean = df.select(Summarizer.mean(df[vector]).alias("m")).first()["m"].toArray()
    matrix: DenseMatrix = fitted.pc
    return CentredPca(mean, matrix.toArray(), fitted.explainedVariance.toArray())


def grid_search(df: DataFrame, estimator: Estimator, grid: dict[str, Sequence], key: str, label: str, folds: int = 5, parallelism: int = 4) -> tuple[CrossValidatorModel, dict, float]:
    """Cross-validated accuracy over a grid on stratified folds: (model, best parameters, best score)."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    placed = with_folds(df, key, label, folds)
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    model = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(placed)
    best = int(np.argmax(model.avgMetrics))
    return model, {p.name: v for p, v in model.getEstimatorParamMaps()[best].items()}, float(model.avgMetrics[best])


def with_folds(df: DataFrame, key: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """A fold number per row: rank by a hash of the key within the label's class, modulo ``folds``.

    The folds' sizes in a class differ by one at most; the class of most rows
    is ranked over all partitions.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    return with_rank_in(hashed, label, ["_hash", key], "_rank").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_rank") % folds).cast("int").alias("fold"))


def compare_models(train: DataFrame, test: DataFrame, models: dict[str, Estimator], label: str) -> DataFrame:
    """Accuracy of each model on one split, best first."""
    train, test = train.persist(), test.persist()
    try:
        evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        rows = [(name, float(evaluator.evaluate(m.fit(train).transform(test)))) for name, m in models.items()]
    finally:
        train.unpersist()
        test.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, accuracy double").orderBy(F.desc("accuracy"), "model")


def fit_model(estimator: Estimator, train: DataFrame, test: DataFrame, label: str, classifier: bool, path: str | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """Fit, predict and score; saved where a path is given: (model, predictions, metrics)."""
    if not isinstance(estimator, Estimator):
        raise TypeError("the first argument is no estimator")
    model = estimator.fit(train)
    predicted = model.transform(test)
    metrics = (classification_metrics if classifier else regression_metrics)(predicted, label, "prediction")
    if path:
        save_model(model, path)
    return model, predicted, metrics


def model_path(base: str, sub: str, name: str) -> str:
    return f"{base.rstrip('/')}/{PurePosixPath(sub, name)}"


def save_model(model: Model, path: str) -> str:
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    pipeline.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Raises FileNotFoundError where no model lies at the path."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise FileNotFoundError(f"no model at {path}") from error


def pipeline(stages: Sequence) -> Pipeline:
    return Pipeline(stages=list(stages))


def loss_trace(spark: SparkSession, model: Model) -> DataFrame:
    """epoch and loss of an iteratively fitted model."""
    history = model.summary.objectiveHistory
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(history)], "epoch int, loss double")


def stratified_holdout(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    placed = stratified_split(df, key, label, test_size, seed)
    return placed.filter("not is_test").drop("is_test"), placed.filter("is_test").drop("is_test")
