"""Queries on models and their evaluation (M)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkworks.operators import metrics, models, prep, text
from sparkworks.operators.ranges import settle
from sparkworks.plans.content import TERMS
from sparkworks.plans.registry import query

#: A rule that guesses the order status from the price.
GUESS = "(SELECT o_orderkey, o_orderstatus AS label, CASE WHEN o_totalprice > 120000 THEN 'F' WHEN o_totalprice > 60000 THEN 'O' ELSE 'P' END AS pred, o_totalprice FROM orders)"


def guess(t):
    pred = F.when(F.col("o_totalprice") > 120000, "F").when(F.col("o_totalprice") > 60000, "O").otherwise("P")
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("label"), pred.alias("pred"), "o_totalprice")


_SCORES = (
    f"g AS (SELECT label, pred FROM {GUESS}), c AS (SELECT label AS class FROM g UNION SELECT pred FROM g), "
    "s AS (SELECT class, (SELECT count(*) FROM g WHERE label = class) AS support, (SELECT count(*) FROM g WHERE pred = class) AS guessed, (SELECT count(*) FROM g WHERE label = class AND pred = class) AS hit FROM c), "
    "r AS (SELECT *, coalesce(hit * 1.0 / nullif(guessed, 0), 0) AS precision, coalesce(hit * 1.0 / nullif(support, 0), 0) AS recall FROM s), "
    "f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"
)


@query(f"WITH g AS (SELECT label, pred FROM {GUESS}), c AS (SELECT label AS class FROM g UNION SELECT pred FROM g) SELECT a.class AS label, b.class AS pred, (SELECT count(*) FROM g WHERE g.label = a.class AND g.pred = b.class) AS n FROM c a, c b")
def confusion(t):
    return metrics.confusion_matrix(guess(t), "label", "pred")


@query(f"WITH {_SCORES} SELECT round(sum(hit) * 1.0 / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM f")
def cls_metrics(t):
    return metrics.classification_metrics(guess(t), "label", "pred").select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(
    f"WITH {_SCORES} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f "
    "UNION ALL SELECT 'accuracy', round(sum(hit) * 1.0 / sum(support), 6), round(sum(hit) * 1.0 / sum(support), 6), round(sum(hit) * 1.0 / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"
)
def cls_report(t):
    return metrics.classification_report(guess(t), "label", "pred").select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


_LINE = "(SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)"


@query(f"SELECT round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(power(y - p, 2)), 0) AS mse, round(avg(abs(y - p)), 3) AS mae FROM {_LINE}")
def reg_metrics(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return metrics.regression_metrics(rows, "y", "p").select(F.round("r2", 6).alias("r2"), F.round("mse", 0).alias("mse"), F.round("mae", 3).alias("mae"))


@query(f"WITH {_SCORES} SELECT 'price rule' AS model, 'classifier' AS type, round(sum(hit) * 1.0 / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM f")
def evaluate(t):
    out = metrics.evaluate_model(guess(t), "label", "pred", kind="classifier", name="price rule")
    return out.select("model", "type", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * 1500.0, 4) AS residual FROM lineitem")
def residuals(t):
    rows = t.lineitem.withColumn("p", F.col("l_quantity") * 1500.0)
    return metrics.residuals(rows, "l_extendedprice", "p").select("l_orderkey", "l_linenumber", F.round("residual", 4).alias("residual"))


@query(f"SELECT count(*) FILTER (WHERE label = pred) AS correct, count(*) FILTER (WHERE label <> pred) AS incorrect, round(100.0 * count(*) FILTER (WHERE label = pred) / count(*), 6) AS accuracy_pct FROM {GUESS}")
def correct_counts(t):
    return metrics.correct_counts(guess(t), "label", "pred").withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("SELECT round(avg(levenshtein(p_type, p_name) * 1.0 / length(p_name)), 8) AS cer FROM part WHERE length(p_name) > 0")
def cer(t):
    return metrics.error_rates(t.part, "p_name", "p_type").withColumn("cer", F.round("cer", 8))


@query()
def wer(t):
    """Word error rate of every conversation turn against the one before; SQL has no distance of word lists."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return metrics.word_error_rates(t.conversations.withColumn("before", before).filter("before is not null"), "text", "before").withColumn("wer", F.round("wer", 8))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def ols_line(t):
    return models.ols_line(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(
    " UNION ALL ".join(
        f"SELECT quality AS class, '{w}' AS feature, round(ln((count(*) FILTER (WHERE contains(lower(text), '{w}')) + 1) / (count(*) + 2)), 6) AS log_prob, round(ln(count(*) / (SELECT count(*) FROM documents JOIN labels USING (doc_id))), 6) AS log_prior FROM documents JOIN labels USING (doc_id) GROUP BY quality"
        for w in (" the ", "###", "!!", "|")
    )
)
def bernoulli_nb(t):
    words = (" the ", "###", "!!", "|")
    text = F.lower("text")
    rows = t.documents.join(t.labels, "doc_id").select("quality", *(text.contains(w).cast("int").alias(w) for w in words))
    return models.bernoulli_counts(rows, "quality", words).select("class", "feature", F.round("log_prob", 6).alias("log_prob"), F.round("log_prior", 6).alias("log_prior"))


@query(
    "WITH v AS (SELECT greatest(var_pop(l_quantity), var_pop(l_discount)) * 1e-9 AS e FROM lineitem) "
    + " UNION ALL ".join(f"SELECT l_returnflag AS class, '{c}' AS feature, round(avg({c}), 6) AS mean, round(var_pop({c}) + (SELECT e FROM v), 6) AS var FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_discount"))
)
def gaussian_nb_stats(t):
    return models.gaussian_nb_stats(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"]).select("class", "feature", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


_CODES = f"(SELECT CASE label WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS a, CASE pred WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS b FROM {GUESS})"


@query(f"SELECT round(avg((a - b) * (a - b)), 8) AS mse, round(avg(abs(a - b)), 8) AS mae FROM {_CODES}")
def code_errors(t):
    """Errors on class codes."""
    code = lambda c: prep.map_values(F.col(c), {"F": 0, "O": 1, "P": 2}).alias(c)
    return metrics.code_errors(guess(t).select(code("label"), code("pred")), "label", "pred").select(F.round("mse", 8).alias("mse"), F.round("mae", 8).alias("mae"))


def _spam(t):
    """Different terms of labelled documents, their labels, and the 2000 most frequent terms."""
    docs = t.documents.join(t.labels, "doc_id")
    counts = settle(text.term_counts(docs, "doc_id", "text"))
    return counts.select("doc_id", "term"), docs.select("doc_id", "quality"), settle(counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(2000).select("term"))


_NB = (
    f"d AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)), w AS (SELECT doc_id, term, count(*) AS tf FROM ({TERMS}) WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY 1, 2), top AS (SELECT term FROM w GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 2000), "
    "c AS (SELECT quality AS class, count(*) AS n FROM d GROUP BY 1), o AS (SELECT quality AS class, term, count(*) AS ones FROM w JOIN d USING (doc_id) GROUP BY 1, 2), "
    "p AS (SELECT class, term, (coalesce(ones, 0) + 1) / (n + 2) AS p, ln(n / (SELECT count(*) FROM d)) AS prior FROM c CROSS JOIN top LEFT JOIN o USING (class, term))"
)


@query(f"WITH {_NB} SELECT class, term, round(ln(p), 6) AS log_one, round(ln(1 - p), 6) AS log_zero, round(prior, 6) AS log_prior FROM p")
def bernoulli_nb_terms(t):
    """Naive Bayes on whether a document has each of the 2000 most frequent terms."""
    present, labels, terms = _spam(t)
    return models.bernoulli_terms(present, labels, terms, "doc_id", "quality").select("class", "term", *(F.round(c, 6).alias(c) for c in ("log_one", "log_zero", "log_prior")))


@query(
    f"WITH {_NB}, b AS (SELECT class, any_value(prior) + sum(ln(1 - p)) AS base FROM p GROUP BY 1), g AS (SELECT doc_id, class, sum(ln(p) - ln(1 - p)) AS gain FROM w JOIN p USING (term) GROUP BY 1, 2), "
    "s AS (SELECT doc_id, class, base + coalesce(gain, 0) AS score FROM d CROSS JOIN b LEFT JOIN g USING (doc_id, class)) SELECT doc_id, arg_max(class, score) AS pred, round(max(score), 3) AS score FROM s GROUP BY 1"
)
def bernoulli_nb_predict(t):
    present, labels, terms = _spam(t)
    model = settle(models.bernoulli_terms(present, labels, terms, "doc_id", "quality"))
    return models.bernoulli_predict(present, labels, model, "doc_id").withColumn("score", F.round("score", 3))


_WAVES = models.fourier_weights(0.5, 3, 8, seed=2)


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(0.5 * cos({w[0]!r} * l_quantity / 50 + {w[1]!r} * l_discount * 10 + {w[2]!r} * l_tax * 10 + {b!r}), 6) + 0.0 AS f{k}" for k, (w, b) in enumerate(zip(_WAVES[0].tolist(), _WAVES[1].tolist(), strict=True))) + " FROM lineitem")
def fourier_features(t):
    """The features on which the machine with the radial kernel is fitted."""
    rows = models.assemble(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c")), ["a", "b", "c"])
    wave = vector_to_array("fourier")
    return models.fourier_features(rows, "features", 0.5, 3, 8, seed=2).select("l_orderkey", "l_linenumber", *((F.round(wave[k], 6) + 0.0).alias(f"f{k}") for k in range(8)))


@query()
def rbf_model(t):
    """Orders inside a ring of price and date, which no line parts, told by Fourier features and a linear machine."""
    a, b = (F.col("o_totalprice") / 100000 - 1.5) * 2, F.pmod(F.col("o_orderkey"), F.lit(100)) / 25 - 2
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("key"), a.alias("a"), b.alias("b")).withColumn("label", (F.col("a") * F.col("a") + F.col("b") * F.col("b") < 1.5).cast("double"))
    # Distinct points with their counts, and no waves: a pass over the rows makes them anew.
    train, test = prep.train_test_split(rows, "key", 0.2, seed=4)
    train = models.packed(models.weighed(train, "label", ["a", "b"]), "label", ["a", "b"])
    test = models.weighed(test, "label", ["a", "b"])
    _, predicted, _ = models.fit_model(models.RbfMachine(["a", "b"], 0.7), train, test, "label", classifier=True)
    return metrics.confusion_matrix(predicted, "label", "prediction", weight="weight")


@query()
def boosting_model(t):
    return _accuracy(t, lambda train: models.gradient_boosting(rounds=20, weightCol="weight"))


@query()
def l1_descent_prices(t):
    """Price by quantity, both scaled, by subgradient descent."""
    rows = t.lineitem.select((F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"))
    weight, bias, trace = models.linear_l1_gd(rows, "x", "y", lr=0.05, epochs=40)
    return t.spark.createDataFrame([(k, float(v), float(weight), float(bias)) for k, v in trace], "epoch int, loss double, weight double, bias double")


@query()
def l1_descent(t):
    """Slope and intercept by subgradient descent on scaled prices."""
    rows = t.part.select((F.col("p_size") / 50.0).alias("x"), (F.col("p_size") / 50.0 * 0.7 + 0.3).alias("y"))
    weight, bias, trace = models.linear_l1_gd(rows, "x", "y", lr=0.05, epochs=60)
    return t.spark.createDataFrame([(k, float(v), float(weight), float(bias)) for k, v in trace], "epoch int, loss double, weight double, bias double")


_LINE = ["l_quantity", "l_discount", "l_tax"]


def _accuracy(t, estimator, bags: bool = False):
    """Fitted on distinct lines with their counts as weights, which is the same and bounded by the columns' values; ``bags`` are drawn from single lines.

    Rows to predict are distinct ones with their counts in any case.
    """
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), (F.col("l_extendedprice") > 35000).cast("double").alias("label"), *_LINE)
    train, test = prep.train_test_split(rows, "key", 0.2, seed=4)
    if bags:
        train = settle(models.assemble(models.dealt(train, "key"), _LINE).select("label", "features"))
    else:
        train = settle(models.assemble(models.weighed(train, "label", _LINE), _LINE))
    test = models.assemble(models.weighed(test, "label", _LINE), _LINE)
    _, predicted, _ = models.fit_model(estimator(train), train, test, "label", classifier=True)
    return metrics.confusion_matrix(predicted, "label", "prediction", weight="weight")


def _lines(train):
    """How many lines the distinct ones of ``train`` stand for."""
    return train.agg(F.sum("weight")).first()[0]


@query()
def logistic_model(t):
    return _accuracy(t, lambda train: models.logistic_regression(_lines(train), weightCol="weight"))


@query()
def tree_model(t):
    return _accuracy(t, lambda train: models.decision_tree(maxDepth=4, weightCol="weight"))


@query()
def forest_model(t):
    return _accuracy(t, lambda train: models.random_forest(), bags=True)


@query()
def svm_model(t):
    return _accuracy(t, lambda train: models.linear_svm(_lines(train), weightCol="weight"))


@query()
def linear_model(t):
    rows = models.assemble(t.lineitem.select(F.col("l_extendedprice").alias("label"), "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return metrics.regression_metrics(models.linear_regression().fit(rows).transform(rows), "label", "prediction")


@query()
def pca_variance(t):
    """Variances of the two first components of three columns."""
    rows = models.assemble(t.lineitem.select("l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])
    x = vector_to_array("pca")
    return models.pca(rows, 2).transform(rows).agg(F.round(F.var_pop(x[0]), 6).alias("first"), F.round(F.var_pop(x[1]), 6).alias("second"))


@query("SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-0'), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def exact_folds(t):
    return models.with_folds(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 5)


@query(
    "WITH c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, avg(x) AS mx, avg(y) AS my FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)), e AS (SELECT *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS v, (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) AS w FROM c) "
    "SELECT l_orderkey, l_linenumber, round(abs((b * (l_quantity - mx) + (v - a) * (l_extendedprice / 1000 - my)) / sqrt(b * b + power(v - a, 2))), 6) AS first, round(v / (v + w), 8) AS share FROM lineitem, e"
)
def pca_pair(t):
    """The first principal component of two columns, up to its sign, and its share of the variance, which have a closed form."""
    rows = models.assemble(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price")), ["l_quantity", "price"])
    fitted = models.pca(rows, 2)
    first = vector_to_array("pca")[0]
    return fitted.transform(rows).select("l_orderkey", "l_linenumber", F.round(F.abs(first), 6).alias("first"), F.round(F.lit(float(fitted.explained_variance[0])), 8).alias("share"))
