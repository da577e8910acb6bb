"""Worked examples and edge cases of the table, statistics and preparation operators."""

import math

import pytest
from pyspark.sql import functions as F

from sparkworks.functions import scalar
from sparkworks.operators import finance, metrics, models, prep, quality, stats, table, text
from sparkworks.sources import io


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_interest(spark):
    loan = spark.createDataFrame([(1000.0, 10.0, 2.0, 1)], "p double, r double, t double, n int")
    assert rows(finance.simple_interest(loan, "p", "r", "t").select("interest", "total")) == [(200.0, 1200.0)]
    amount = finance.compound_interest(loan, "p", "r", "t", "n").first()
    assert amount["amount"] == pytest.approx(1210.0) and amount["interest"] == pytest.approx(210.0)
    assert spark.range(1).select(finance.roi(F.lit(0.0), F.lit(5.0))).first()[0] is None


def test_chunk_list(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(finance.chunk_list(F.col("a"), 3, F.lit(0))).collect()] == [[[1, 2, 3], [4, 5, 0]], []]
    assert df.select(finance.chunk_list(F.col("a"), 2)).first()[0] == [[1, 2], [3, 4], [5]]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 1.0, 1.1, 9.0, None)], "x double")
    got = [r[0] for r in df.select(prep.cut(F.col("x"), [0, 1, 2, math.inf], ["a", "b", "c"])).collect()]
    assert got == [None, "a", "a", "b", "c", None]


def test_standard_scale_uses_population_std(spark):
    df = spark.createDataFrame([(float(x), 7.0) for x in range(1, 6)], "x double, flat double")
    got = rows(prep.standard_scale(df, ["x", "flat"]), "x")
    assert [g[0] for g in got] == pytest.approx([-math.sqrt(2), -math.sqrt(0.5), 0, math.sqrt(0.5), math.sqrt(2)])
    assert {g[1] for g in got} == {0.0}
    assert [g[0] for g in rows(prep.minmax_scale(df, ["x"]), "x")] == [0, 0.25, 0.5, 0.75, 1]


def test_knn_on_four_points(spark):
    points = spark.createDataFrame([(1, [2.0, 4.0], "Red"), (2, [4.0, 2.0], "Red"), (3, [4.0, 6.0], "Blue"), (4, [6.0, 4.0], "Blue")], "id long, v array<double>, label string")
    query = spark.createDataFrame([(9, [5.0, 3.0])], "id long, v array<double>")
    near = rows(text.knn_join(query, points, 3, "id", "id", "v").select("id", "rank"), "rank")
    assert near == [(2, 1), (4, 2), (1, 3)]  # 1 and 3 are equally far: the smaller id
    assert rows(models.knn_classify(points, query, 3, "id", "v", "label")) == [(9, "Red")]


def test_naive_bayes_counts(spark):
    mail = spark.createDataFrame([(1, 0, 1), (0, 1, 0), (1, 1, 1), (0, 0, 0)], "offer int, win int, spam int")
    got = {(r["class"], r["feature"]): math.exp(r["log_prob"]) for r in models.bernoulli_counts(mail, "spam", ["offer", "win"]).collect()}
    assert got == pytest.approx({(1, "offer"): 0.75, (1, "win"): 0.5, (0, "offer"): 0.25, (0, "win"): 0.5})


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [r[3] for r in rows(stats.histogram(df, "x", 5), "bin")] == [2, 2, 2, 2, 3]
    assert sum(r[3] for r in rows(stats.histogram(df.filter("x = 3"), "x", 4))) == 1


def test_modes_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "x string")
    assert stats.mode(df, "x").first()[0] == "a" and stats.least_common(df, "x").first()[0] == "c"
    assert rows(stats.value_counts(df, "x", normalize=True))[0] == ("a", 2, 2 / 6)


def test_positions_and_slices(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert rows(table.with_position(df, ["k"]).select("k", "position"), "k") == [(k, k) for k in range(100)]
    assert [r[0] for r in rows(table.slice_rows(df, 3, 5, ["k"]).select("k"), "k")] == [3, 4]
    assert [r[0] for r in rows(table.slice_rows(df, 3, 5, ["k"], inclusive=True).select("k"), "k")] == [3, 4, 5]
    assert [r[0] for r in table.tail(df, 2, ["k"]).collect()] == [98, 99]


def test_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in table.sort_values(df, ["x"]).collect()] == [1, 2, None]
    assert [r[0] for r in table.sort_values(df, ["x"], False).collect()] == [2, 1, None]


def test_fill_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (4.0, "a"), (2.0, "b")], "x double, s string")
    assert sorted(r[0] for r in prep.fill_missing(df, "median").collect()) == [1.0, 2.0, 2.0, 4.0]
    assert prep.fill_missing(df, "mode").filter("s is null").count() == 0
    assert prep.fill_missing(df, "drop").count() == 3
    for wrong in (("sum", None), ("mean", ["none"])):
        with pytest.raises(ValueError):
            prep.fill_missing(df, *wrong)


def test_fill_split_touches_nulls_only(spark):
    df = spark.createDataFrame([(k, "S" if k < 6 else "C" if k < 8 else None) for k in range(18)], "k int, e string")
    got = {r["k"]: r["e"] for r in prep.fill_split(df, "e", "k").collect()}
    assert all(got[k] == "S" for k in range(6)) and [got[k] for k in (6, 7)] == ["C", "C"]
    assert [got[k] for k in range(8, 18)].count("S") == 8


def test_splits_partition_rows(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    for pair in (prep.train_test_split(df, "id", 0.2), prep.train_test_split(df, "id", 0.25, exact=True), prep.sequential_split(df, ["id"], 0.8)):
        a, b = ({r["id"] for r in p.collect()} for p in pair)
        assert not a & b and len(a | b) == 1000
    assert prep.train_test_split(df, "id", 0.25, exact=True)[1].count() == 250
    test = prep.stratified_split(df, "id", "g", 0.2).filter("is_test").groupBy("g").count().collect()
    assert sorted(r["count"] for r in test) == [67, 67, 67]


def test_label_encoding_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    codes = prep.label_codes(df, "x")
    encoded = prep.label_encode(df, "x", "code")
    assert rows(encoded.select("x", "code"), "code") == [(None, -1), ("a", 0), ("b", 1), ("c", 2)]
    assert {r["x"] for r in prep.label_decode(encoded.select("code"), codes, "code").collect()} == {None, "a", "b", "c"}


def test_reorder_keeps_every_column_once(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert table.reorder_columns(df, "c", 0).columns == ["c", "a", "b"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    grid = {(r["label"], r["pred"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert grid[("c", "b")] == 1 and grid[("c", "c")] == 0 and len(grid) == 9
    m = metrics.classification_metrics(df, "y", "p").first()
    assert m["accuracy"] == 0.5 and m["precision"] == pytest.approx(0.5 * 1 + 0.25 / 3) and m["recall"] == 0.5
    line = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "y double, p double")
    r = metrics.regression_metrics(line, "y", "p").first()
    assert (r["mse"], r["mae"], r["r2"]) == (0.5, 0.5, -1.0)
    assert metrics.word_error_rates(spark.createDataFrame([("a b c d", "a x c")], "r string, h string"), "r", "h").first()[0] == 0.5


def test_rules(spark):
    df = spark.createDataFrame([("1234",), ("12",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(quality.pattern(F.col("c"), "^[0-9]{4,8}$")).collect()] == [True, False, True, True]
    failed = quality.compose(df, {"required": quality.required(F.col("c")), "pattern": quality.pattern(F.col("c"), "^[0-9]{4,8}$")})
    assert [r["failed"] for r in failed.collect()] == [[], ["pattern"], ["required"], ["required"]]


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalar.modulo(F.lit(-7), F.lit(3))) == 2 and value(scalar.modulo(F.lit(7), F.lit(-3))) == -2
    assert value(scalar.modulo(F.lit(7), F.lit(0))) is None and value(scalar.half_even(F.lit(2.5))) == 2
    assert value(scalar.capitalize(F.lit("hELLO wORLD"))) == "Hello world"
    a = F.array(*(F.lit(x) for x in range(6)))
    assert value(scalar.array_slice(a, 1, -1)) == [1, 2, 3, 4] and value(scalar.array_slice(a, None, None, 2)) == [0, 2, 4]
    assert value(scalar.item(a, -2)) == 4 and value(scalar.item(a, 9)) is None
    assert value(scalar.identity(2)) == [[1, 0], [0, 1]]


def test_descent_finds_the_line(spark):
    df = spark.range(50).select((F.col("id") * 0.02).alias("x"), (F.col("id") * 0.014 + 0.3).alias("y"))
    weight, bias, trace = models.linear_l1_gd(df, "x", "y", lr=0.05, epochs=100)
    assert abs(weight - 0.7) < 0.2 and abs(bias - 0.3) < 0.1 and trace[-1][1] < 0.06 < trace[0][1]


def test_csv_quotes_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", line\nend'), (2, None)], "k int, s string")
    io.write_csv(df, str(tmp_path / "c"))
    assert rows(io.read_csv(spark, str(tmp_path / "c"), "k int, s string"), "k") == [(1, 'a "quoted", line\nend'), (2, None)]
    coded = io.encode_json(df, F.col("s"))
    assert rows(io.decode_json(coded, "message string").select("k", "message"), "k") == [(1, 'a "quoted", line\nend'), (2, None)]


def test_extract_elements_minds_nesting(spark):
    df = spark.createDataFrame([(1, '<div class="x y"> a <div>b</div></div><div>c</div>'), (2, None)], "k int, html string")
    assert [r["elements"] for r in io.extract_elements(df, "html", "div", "x", limit=5, prefix="- ").orderBy("k").collect()] == [["- a b"], []]


def test_chunks_cover_the_text(spark):
    words = " ".join(f"word{k}" for k in range(400)) + "\n\n" + "x" * 2500
    pieces = text.split_text(words, 1000, 200)
    assert all(len(p) <= 1000 for p in pieces)
    assert set(words.split()) - {"x" * 2500} <= {w for p in pieces for w in p.split()} and sum(p.count("x") for p in pieces) >= 2500


def test_models_save_and_load(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") / 200).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") >= 100).cast("double").alias("label"))
    data = models.assemble(df, ["a", "b"])
    train, test = prep.train_test_split(data, "id", 0.25)
    for estimator in (models.logistic_regression(150), models.decision_tree(maxDepth=3), models.random_forest(trees=5), models.gradient_boosting(rounds=3), models.linear_svm(150, maxIter=20), models.mlp_classifier([2, 4, 2], iterations=60)):
        model, predicted, m = models.fit_model(estimator, train, test, "label", True, str(tmp_path / type(estimator).__name__))
        assert m.first()["accuracy"] > 0.8, type(estimator).__name__
        again = models.load_model(str(tmp_path / type(estimator).__name__)).transform(test)
        assert metrics.predictions_equal(predicted, again, "id")
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "none"))


def test_pca_is_centred_and_uncorrelated(spark):
    df = models.assemble(spark.range(100).select((F.col("id") + 5.0).alias("a"), (F.sin("id") * 3).alias("b"), (F.col("id") * 2 + F.cos("id")).alias("c")), ["a", "b", "c"])
    fitted = models.pca(df, 3)
    from pyspark.ml.functions import vector_to_array

    out = fitted.inverse(fitted.transform(df)).select(vector_to_array("features").alias("x"), vector_to_array("pca").alias("p"), vector_to_array("restored").alias("r"))
    stats_row = out.agg(F.avg(F.col("p")[0]).alias("m"), F.corr(F.col("p")[0], F.col("p")[1]).alias("c"), F.max(F.abs(F.col("x")[2] - F.col("r")[2])).alias("d")).first()
    assert abs(stats_row["m"]) < 1e-9 and abs(stats_row["c"]) < 1e-6 and stats_row["d"] < 1e-6


def test_grid_search_and_comparison(spark):
    df = spark.range(120).select("id", (F.col("id") / 120).alias("a"), (F.col("id") >= 60).cast("double").alias("label"))
    data = models.assemble(df, ["a"])
    _, best, score = models.grid_search(data, models.decision_tree(), {"maxDepth": [1, 2]}, "id", "label", folds=3)
    assert score > 0.9 and best["maxDepth"] in (1, 2)
    ranked = models.compare_models(data, data, {"tree": models.decision_tree(), "line": models.logistic_regression(120)}, "label")
    assert ranked.count() == 2


def test_sentiment_features_have_idf_weights(spark):
    """The features are those of tfidf: counts times ln((1 + n) / (1 + df)) + 1, at unit length."""
    rows = [(k, t, float(k % 2)) for k, t in enumerate(["apple apple pear", "apple plum", "pear plum plum quince", "apple apple"])]
    df = spark.createDataFrame(rows, "id long, body string, label double")
    model = text.sentiment_pipeline("body", "label", n_rows=4).fit(df)
    terms = model.stages[2].vocabulary
    got = {(r["id"], terms[k]): v for r in model.transform(df).collect() for k, v in enumerate(r["features"].toArray()) if v}
    want = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(df, "id", "body").collect()}
    assert got == pytest.approx(want)


def test_repeated_changes_raise(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    once = spark.createDataFrame([(2, None), (9, "z"), (None, "x"), (None, "y")], "k int, v string")
    assert sorted(rows(table.update_rows(df, once, "k")), key=repr) == [(1, "a"), (2, None), (None, "c")]
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string")
    with pytest.raises(Exception, match="more than one change of key 2"):
        table.update_rows(df, twice, "k").collect()
    assert table.delete_all(df).count() == 0


def test_a_null_rule_is_failed(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    rules = {"positive": F.col("v") > 0, "any": quality.max_length(F.col("v").cast("string"), 5)}
    assert rows(quality.rule_report(df, rules), "rule") == [("any", 0), ("positive", 2)]
    assert [r["failed"] for r in quality.compose(df, rules).collect()] == [[], ["positive"], ["positive"]]


def test_too_many_classes_raise(spark):
    df = spark.range(30).withColumn("c", F.col("id") % 3)
    assert prep.classes(df, "c") == [0, 1, 2]
    with pytest.raises(ValueError, match="more than 20"):
        prep.classes(df, "id", most=20)


def test_slice_numbers_the_first_rows_alone(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("v"))
    assert [r["v"] for r in table.slice_rows(df, 3, 6, ["v"]).orderBy("v").collect()] == [3, 4, 5]
    assert [r["v"] for r in table.slice_rows(df, 48, 60, ["v"], inclusive=True).orderBy("v").collect()] == [48, 49]
    assert table.slice_rows(df, 0, 0, ["v"]).count() == 0
