"""Fitted models against numpy, brute force, or what must hold at an optimum."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkworks.operators import metrics, models, table
from sparkworks.sources import io


@pytest.fixture(scope="module")
def points(spark):
    """Two classes of two features, with noise."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 2)) * [1.0, 3.0] + [0.5, -1.0]
    y = (x @ [1.5, -0.4] + rng.normal(0, 0.8, 400) > 0.3).astype(float)
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, label double")
    return models.assemble(df, ["a", "b"]).persist(), x, y


def test_logistic_regression_against_newton(points):
    df, x, y = points
    model = models.logistic_regression(len(y), c=0.7, maxIter=200, tol=1e-12).fit(df)
    z, w = np.column_stack([x, np.ones(len(y))]), np.zeros(3)
    strength = np.array([1 / 0.7, 1 / 0.7, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(strength), z.T @ (p - y) + strength * w)
    assert model.coefficients.toArray() == pytest.approx(w[:2], abs=1e-4) and model.intercept == pytest.approx(w[2], abs=1e-4)


def test_linear_regression_against_least_squares(points):
    df, x, _ = points
    df = df.withColumn("target", 3 * F.col("a") - 0.5 * F.col("b") + F.sin("id"))
    model = models.linear_regression(labelCol="target").fit(df)
    t = 3 * x[:, 0] - 0.5 * x[:, 1] + np.sin(np.arange(len(x)))
    w = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), t, rcond=None)[0]
    assert [*model.coefficients.toArray(), model.intercept] == pytest.approx(w, abs=1e-8)
    line = models.ols_line(df, "a", "target").first()
    assert [line["slope"], line["intercept"]] == pytest.approx(np.polyfit(x[:, 0], t, 1), abs=1e-9)


def test_svm_is_at_its_optimum(points):
    df, x, y = points
    model = models.linear_svm(len(y), c=1.0, maxIter=300, tol=1e-10).fit(df)
    sign = 2 * y - 1

    def loss(w, b):
        return np.maximum(0, 1 - sign * (x @ w + b)).mean() + 0.5 / len(y) * (w @ w)

    w, b = model.coefficients.toArray(), model.intercept
    rng = np.random.default_rng(0)
    best = loss(w, b)
    for scale in (0.3, 0.1, 0.03):
        for d in rng.normal(0, scale, (300, 3)):
            assert loss(w + d[:2], b + d[2]) > best - 1e-3


def test_descent_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random(200)
    y = 0.7 * x + 0.3 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    weight, bias, trace = models.linear_l1_gd(df, "x", "y", lr=0.02, epochs=60, every=20)
    w = b = 0.0
    losses = []
    for epoch in range(60):
        gap = w * x + b - y
        if epoch % 20 == 0:
            losses.append((epoch, float(np.abs(gap).mean())))
        w, b = w - 0.02 * float((np.sign(gap) * x).mean()), b - 0.02 * float(np.sign(gap).mean())
    assert (weight, bias) == pytest.approx((w, b), abs=1e-9)
    assert [k for k, _ in trace] == [0, 20, 40] and [v for _, v in trace] == pytest.approx([v for _, v in losses])


def test_a_stump_takes_the_best_split(points):
    df, x, y = points
    model = models.decision_tree(maxDepth=1, maxBins=400).fit(df)
    best = min((sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (y[x[:, f] <= t], y[x[:, f] > t]) if len(s)), f) for f in range(2) for t in x[:, f])
    got = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    importances = {r["feature"]: r["importance"] for r in models.importances(df.sparkSession, model, ["a", "b"]).collect()}
    chosen = ("a", "b")[best[1]]
    assert importances[chosen] == pytest.approx(1.0)
    # The gini of the split that was taken is the least there is.
    sides = [y[np.array(got) == k] for k in (0.0, 1.0)]
    assert sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in sides) == pytest.approx(best[0], rel=1e-6)
    regressor = models.decision_tree(classifier=False, maxDepth=1).fit(df.withColumn("label", F.col("b")))
    assert len({r[0] for r in regressor.transform(df).select("prediction").distinct().collect()}) == 2


def test_many_trees_are_no_worse_than_one(points):
    df, _, y = points
    accuracy = lambda e: metrics.classification_metrics(e.fit(df).transform(df), "label", "prediction").first()["accuracy"]
    one = accuracy(models.decision_tree(maxDepth=2))
    assert accuracy(models.random_forest(trees=30)) >= one - 0.02
    assert accuracy(models.gradient_boosting(rounds=5)) >= one
    forest = models.random_forest(classifier=False, trees=10).fit(df.withColumn("label", F.col("a")))
    assert metrics.regression_metrics(forest.transform(df.withColumn("label", F.col("a"))), "label", "prediction").first()["r2"] > 0.9
    assert models.random_forest().getNumTrees() == 100


def test_kernel_machine_on_circles(spark):
    circles = io.make_circles(spark, 400, noise=0.05, factor=0.4, seed=1)
    df = models.fourier_features(models.assemble(circles, ["X1", "X2"]), "features", 1.0, 2, 100)
    hit = metrics.correct_counts(models.rbf_svm(400).fit(df).transform(df), "label", "prediction").first()
    assert hit["accuracy_pct"] > 97
    # Products of features are about the kernel.
    big = models.fourier_features(models.assemble(circles, ["X1", "X2"]), "features", 0.5, 2, 4000).limit(2).select("X1", "X2", vector_to_array("fourier").alias("f")).collect()
    a, b = big
    assert float(np.dot(a["f"], b["f"])) == pytest.approx(math.exp(-0.5 * ((a["X1"] - b["X1"]) ** 2 + (a["X2"] - b["X2"]) ** 2)), abs=0.06)
    w, shift = models.fourier_weights(0.5, 2, 4000)
    assert a["f"] == pytest.approx((np.cos(w @ [a["X1"], a["X2"]] + shift) * math.sqrt(2 / 4000)).tolist(), abs=1e-12)


def test_network_and_its_loss(spark, points):
    df, _, _ = points
    model = models.mlp_classifier([2, 5, 2], iterations=60).fit(df)
    assert metrics.correct_counts(model.transform(df), "label", "prediction").first()["accuracy_pct"] > 80
    logistic = models.logistic_regression(400).fit(df)
    trace = [r["loss"] for r in models.loss_trace(spark, logistic).orderBy("epoch").collect()]
    assert len(trace) > 1 and trace == sorted(trace, reverse=True)


def test_pca_against_eigenvectors(points):
    df, x, _ = points
    fitted = models.pca(df, 2)
    value, axes = np.linalg.eigh(np.cov(x.T))
    assert np.abs(fitted.components) == pytest.approx(np.abs(axes[:, ::-1]), abs=1e-9)
    assert fitted.explained_variance == pytest.approx(value[::-1] / value.sum(), abs=1e-9) and fitted.mean == pytest.approx(x.mean(axis=0))
    back = fitted.inverse(fitted.transform(df)).orderBy("id").select(vector_to_array("restored").alias("v")).collect()
    assert np.array([r["v"] for r in back]) == pytest.approx(x, abs=1e-9)


def test_search_takes_the_best_of_its_grid(points):
    df, _, _ = points
    model, best, score = models.grid_search(df, models.decision_tree(), {"maxDepth": [1, 3], "minInstancesPerNode": [1, 300]}, "id", "label", folds=3)
    assert len(model.avgMetrics) == 4 and score == max(model.avgMetrics) and best["minInstancesPerNode"] == 1
    # By hand on the same folds.
    placed = models.with_folds(df, "id", "label", 3).persist()
    scores = []
    for fold in range(3):
        fitted = models.decision_tree(maxDepth=best["maxDepth"]).fit(placed.filter(F.col("fold") != fold))
        scores.append(metrics.classification_metrics(fitted.transform(placed.filter(F.col("fold") == fold)), "label", "prediction").first()["accuracy"])
    assert np.mean(scores) == pytest.approx(score, abs=1e-9)


def test_compare_fit_save_load(spark, points, tmp_path):
    df, _, _ = points
    ranked = models.compare_models(df, df, {"stump": models.decision_tree(maxDepth=1), "tree": models.decision_tree(maxDepth=5)}, "label").collect()
    assert [r["model"] for r in ranked] == ["tree", "stump"]
    path = models.model_path(str(tmp_path), "sub", "one")
    model, predicted, scores = models.fit_model(models.decision_tree(), df, df, "label", True, path)
    again = models.load_model(path).transform(df)
    assert metrics.predictions_equal(predicted, again, "id") and scores.columns == ["accuracy", "precision", "recall", "f1"]
    assert not metrics.predictions_equal(predicted, again.withColumn("prediction", 1 - F.col("prediction")), "id")
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "none"))
    with pytest.raises(TypeError):
        models.fit_model(model, df, df, "label", True)


def test_bernoulli_terms_against_definition(spark):
    rng = random.Random(6)
    docs = {k: {f"t{j}" for j in range(8) if rng.random() < 0.3 + 0.4 * (k % 2) * (j < 3)} for k in range(60)}
    docs[60] = set()
    present = spark.createDataFrame([(k, w) for k, ws in docs.items() for w in sorted(ws)], "id long, term string")
    labels = spark.createDataFrame([(k, k % 2) for k in docs], "id long, y int")
    terms = spark.createDataFrame([(f"t{j}",) for j in range(9)], "term string")  # one that no document has
    model = models.bernoulli_terms(present, labels, terms, "id", "y")
    n = {c: sum(k % 2 == c for k in docs) for c in (0, 1)}
    p = {(c, f"t{j}"): (sum(f"t{j}" in ws for k, ws in docs.items() if k % 2 == c) + 1) / (n[c] + 2) for c in (0, 1) for j in range(9)}
    got = {(r["class"], r["term"]): r for r in model.collect()}
    assert got.keys() == p.keys() and all(math.exp(got[k]["log_one"]) == pytest.approx(v) for k, v in p.items())
    want = {}
    for k, ws in docs.items():
        score = {c: math.log(n[c] / len(docs)) + sum(math.log(v if w in ws else 1 - v) for (d, w), v in p.items() if d == c) for c in (0, 1)}
        want[k] = max(score, key=lambda c, s=score: (s[c], -c))
    assert {r["id"]: r["pred"] for r in models.bernoulli_predict(present, labels, model, "id").collect()} == want


def word_distance(a, b):
    return max(len(a), len(b)) if not a or not b else min(word_distance(a[1:], b) + 1, word_distance(a, b[1:]) + 1, word_distance(a[1:], b[1:]) + (a[0] != b[0]))


def test_word_error_rate_against_recursion(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 6)))) for _ in range(60)] + [("", "a"), ("a b", None), (None, "a")]
    df = spark.createDataFrame(rows, "r string, h string")
    want = np.mean([word_distance(r.split(), (h or "").split()) / len(r.split()) for r, h in rows if r])
    assert metrics.word_error_rates(df, "r", "h").first()["wer"] == pytest.approx(want)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "y int, p int")
    auto = metrics.evaluate_model(df, "y", "p", name="m", path=str(tmp_path / "report")).first()
    assert auto["type"] == "classifier" and auto["accuracy"] == 0.75
    written = io.read_csv(spark, str(tmp_path / "report")).first()
    assert written["model"] == "m" and written["accuracy"] == 0.75
    assert metrics.evaluate_model(df.union(spark.createDataFrame([(2, 2)], "y int, p int")), "y", "p").first()["type"] == "regressor"
    with pytest.raises(ValueError):
        metrics.evaluate_model(df, "y", "p", kind="other")
    assert [r["correct"] for r in metrics.correct_flags(df, "y", "p").collect()] == [True, False, True, True]
    with pytest.raises(ValueError, match="more than 2 classes"):
        metrics.confusion_matrix(df.union(spark.createDataFrame([(2, 2)], "y int, p int")), "y", "p", most=2)
    assert table.exists(df, F.col("y") == 1) and not table.exists(df, F.col("y") == 7)


def test_fits_of_distinct_rows_are_those_of_all(spark):
    """Weights stand for repeated rows: the same tree, machine and matrix, from as many rows as there are distinct ones."""
    rows = spark.range(4000).selectExpr("cast(id % 10 as double) as a", "cast(id % 7 as double) as b", "cast(id % 10 + id % 3 > 6 as double) as label")
    few = models.weighed(rows, "label", ["a", "b"])
    assert few.count() < 200 and few.agg(F.sum("weight")).first()[0] == 4000
    every, few = models.assemble(rows, ["a", "b"]), models.assemble(few, ["a", "b"])
    for make in (models.decision_tree, lambda **p: models.gradient_boosting(rounds=4, **p), lambda **p: models.logistic_regression(4000, **p)):
        one, two = make().fit(every), make(weightCol="weight").fit(few)
        whole = metrics.confusion_matrix(one.transform(every), "label", "prediction")
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, metrics.confusion_matrix(two.transform(few), "label", "prediction", weight="weight").collect()))


def test_fits_of_lines_take_distinct_ones(spark, monkeypatch):
    """Boosting is fitted on no more rows than there are values of the columns; a forest's rows are dealt to all cores."""
    from sparkworks.plans import learning  # noqa: F401  it registers the queries
    from sparkworks.plans.registry import QUERIES

    held = []

    def fit(estimator, train, test, *args, **kwargs):
        held.append((train.count(), train.rdd.getNumPartitions(), train.columns))
        return None, test.withColumn("prediction", F.col("label")), None

    monkeypatch.setattr(models, "fit_model", fit)
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    for name in ("boosting_model", "forest_model", "rbf_model"):
        QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert held[0][0] < 0.25 * lines.count() < 0.75 * lines.count() < held[1][0]
    assert held[1][1] >= spark.sparkContext.defaultParallelism and held[1][2] == ["label", "features"]
    assert held[2][1] >= spark.sparkContext.defaultParallelism and held[2][2] == ["label", "fourier"]


def test_kernel_machine_on_packs_against_that_on_features(spark, monkeypatch):
    """The same objective, at least as low; counts stand for repeated rows; a large table's fit, begun on a part, ends on all rows."""
    circles = io.make_circles(spark, 500, noise=0.35, factor=0.5, seed=1)
    rows = circles.unionAll(circles.filter("label = 1")).select("X1", "X2", F.col("label").cast("double").alias("label")).persist()
    packs = models.packed(models.weighed(rows, "label", ["X1", "X2"]), "label", ["X1", "X2"])
    n = rows.count()
    waves = models.fourier_features(models.assemble(rows, ["X1", "X2"]), "features", 1.0, 2, 100)
    held = waves.select("label", vector_to_array("fourier").alias("f")).collect()
    f, y = np.array([r["f"] for r in held]), np.array([2 * r["label"] - 1 for r in held])

    def value(w, c):
        return np.maximum(1 - y * (f @ w + c), 0).mean() + w @ w / (2 * n)

    machine = models.RbfMachine(["X1", "X2"], 1.0)
    model, old = machine.fit(packs), models.rbf_svm(n).fit(waves)
    assert machine.trace[-1][1] == n
    reached = value(model.coefficients, model.intercept)
    assert reached == pytest.approx(min(v for v, _ in machine.trace), abs=1e-5)
    assert reached <= value(old.coefficients.toArray(), old.intercept) + 1e-4
    # The slope is that of the value.
    at, way = np.append(model.coefficients, model.intercept) * 0.9, np.random.default_rng(1).normal(size=101)
    loss = lambda x: machine._value(packs, x)[1]
    assert (loss(at + 1e-3 * way) - loss(at - 1e-3 * way)) / 2e-3 == pytest.approx(machine._value(packs, at)[2] @ way, rel=2e-2)
    said = model.transform(rows).select("X1", "X2", "prediction").collect()
    w, b = models.fourier_weights(1.0, 2, 100)
    assert [r["prediction"] for r in said] == [float(np.cos(w @ [r["X1"], r["X2"]] + b) @ model.coefficients * np.sqrt(0.02) + model.intercept > 0) for r in said]
    monkeypatch.setattr(models, "PACK", 8)
    small = models.packed(models.weighed(rows, "label", ["X1", "X2"]), "label", ["X1", "X2"])
    begun = models.RbfMachine(["X1", "X2"], 1.0, first=2)
    begun.fit(small)
    seen = [k for _, k in begun.trace]
    assert seen[0] < n == seen[-1] and min(v for v, k in begun.trace if k == n) <= reached + 2e-3
    with pytest.raises(Exception, match="null or NaN"):
        models.packed(rows.selectExpr("label", "X1", "if(X2 > 0, X2, null) as X2", "1.0D as weight"), "label", ["X1", "X2"]).collect()


def test_kernel_machine_keeps_no_features(spark, monkeypatch):
    """What a fit passes over again and again is 24 bytes for each distinct row, not a hundred features of every row."""
    from sparkworks.plans import learning  # noqa: F401  it registers the queries
    from sparkworks.plans.registry import QUERIES

    held = []

    def fit(estimator, train, test, *args, **kwargs):
        held.append(train.selectExpr("sum(octet_length(label) + octet_length(fourier)) as size", "sum(octet_length(label)) / 8 as n").first())
        return None, test.withColumn("prediction", F.col("label")), None

    monkeypatch.setattr(models, "fit_model", fit)
    QUERIES["rbf_model"](spark, "/root/testdata/sf0.01").collect()
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert held[0]["size"] == 24 * held[0]["n"] and 0.75 * orders < held[0]["n"] < 0.85 * orders
