import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from precinct.operators import boosting, evaluation, features, models
from precinct.operators.relational import class_names
from precinct.operators.splits import with_split
from precinct.plans import model_queries
from precinct.plans.model_queries import encoded
from precinct.sources.testviews import TRAIN_END, VALIDATION_END, incidents
from conftest import SF, rows_of


@pytest.fixture(scope="module")
def made(spark):
    rows, classes, encoder = encoded(spark, SF)
    return rows.cache(), classes, encoder


def train_of(made):
    return made[0].filter("split = 'train'")


def test_vector_width_is_levels_plus_one_per_column(spark, tiny):
    rows = models.model_rows(tiny, (41.85, -87.65))
    train = rows.filter("unique_key <= 6")
    encoder = models.fit_encoder(train)
    levels = sum(train.select(c).distinct().count() + 1 for c in models.CATEGORICAL)
    sizes = {r[0] for r in encoder.transform(rows).select(F.size(vector_to_array("features"))).collect()}
    assert sizes == {levels + len(models.NUMERIC)}


def test_labels_by_name_and_unseen_error(spark, tiny):
    labels = models.fit_labels(tiny.filter("primary_type <> 'ARSON'"), "primary_type")
    got = dict(rows_of(models.attach_labels(tiny, labels, "primary_type").select("primary_type", "label").distinct()))
    assert got == {"BATTERY": 0.0, "ROBBERY": 1.0, "THEFT": 2.0, "ARSON": -1.0}
    with pytest.raises(ValueError):
        models.attach_labels(tiny, labels, "primary_type", unseen="error")
    assert dict(rows_of(models.fit_labels(tiny, "primary_type", "frequency")))["THEFT"] == 0.0


def test_scaling_leaves_the_one_hot_block_alone(spark, tiny):
    rows = models.model_rows(tiny, (41.85, -87.65))
    scaled = models.fit_encoder(rows, scale_numeric=True).transform(rows)
    plain = models.fit_encoder(rows).transform(rows)
    width, n = scaled.select(F.size(vector_to_array("features"))).first()[0], len(models.NUMERIC)
    cut = lambda df: [r[0] for r in df.orderBy("unique_key").select(F.slice(vector_to_array("features"), 1, width - n)).collect()]
    assert cut(scaled) == cut(plain)
    mean = scaled.select(F.avg(vector_to_array("features")[width - n + 2])).first()[0]
    assert mean == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("fit", [
    lambda t, c: models.fit_logistic(t, c, max_iter=20), lambda t, c: models.fit_tree(t, c, max_depth=4),
    lambda t, c: models.fit_forest(t, c, trees=3, max_depth=4), lambda t, c: models.fit_boosted(t, c, rounds=2, max_depth=2)])
def test_classifiers_give_probabilities_that_sum_to_one(made, fit, tmp_path, spark):
    fitted = fit(train_of(made), made[1])
    scored = fitted.transform(made[0].filter("split = 'test'")).select("unique_key", "probability", "predicted")
    sums = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x), F.size("probability")).distinct()
    assert all(r[0] == pytest.approx(1) and r[1] == len(made[1]) for r in sums.collect())
    models.save_state(spark, str(tmp_path / "state"), fitted, made[2], {"labels": spark.createDataFrame([("a", 0.0)], "c string, l double")},
                      {"on_hour": 0.4})
    again, _, tables, facts = models.load_state(spark, str(tmp_path / "state"))
    back = again.transform(made[0].filter("split = 'test'")).select("unique_key", "probability", "predicted")
    assert back.exceptAll(scored).isEmpty() and tables["labels"].count() == 1 and facts == {"on_hour": 0.4}


def test_convergence_flag(made):
    assert models.fit_logistic(train_of(made), made[1], max_iter=1).converged is False
    assert models.fit_logistic(train_of(made), made[1], max_iter=300, tol=0.1).converged is True


def boosted(made, **settings):
    return models.fit_boosted(train_of(made), made[1], max_depth=2, validation=made[0].filter("split = 'validation'"), **settings)


def test_early_stopping_keeps_the_best_round(made, spark):
    fitted = boosted(made, rounds=12, patience=3)
    facts = fitted.facts
    held = [v for _, v in facts["losses"]]
    assert [m.getNumTrees for m in fitted.models] == [facts["best_round"]] * len(made[1])
    assert facts["best_round"] == held.index(min(held)) + 1 and len(held) == facts["rounds"]
    assert facts["rounds"] == 12 or facts["rounds"] - facts["best_round"] == 3
    assert [r["kept"] for r in boosting.loss_table(spark, facts).collect()].index(True) + 1 == facts["best_round"]


def test_patience_ends_the_run(made):
    """A rate that overshoots: the validation loss rises soon, and the rounds behind the best one are left out."""
    facts = boosted(made, rounds=30, rate=3.0, patience=2).facts
    assert facts["rounds"] == facts["best_round"] + 2 < 30


def test_carried_margins_are_those_of_the_model(made):
    """Losses of the loop (margins carried, stored every two rounds) against losses of the finished model."""
    fitted = boosted(made, rounds=5, patience=9, store_every=2)
    for split, place in (("train", 0), ("validation", 1)):
        rows = fitted.margins(made[0].filter(F.col("split") == split))
        loss = rows.agg(F.avg(boosting.log_loss(F.col("margins"), F.col("label")))).first()[0]
        assert loss == pytest.approx(fitted.facts["losses"][fitted.facts["best_round"] - 1][place], abs=1e-9)
    assert [a for a, _ in fitted.facts["losses"]] == sorted((a for a, _ in fitted.facts["losses"]), reverse=True)


def test_margins_follow_a_plain_version(spark):
    """One class decided by a number: the first round's leaves are Newton steps computed by hand."""
    rows = [(float(x >= 5), Vectors.dense([float(x)])) for x in range(10)]
    df = spark.createDataFrame(rows, ["label", "features"])
    run = boosting.boost(df, 2, rounds=1, max_depth=1, rate=0.5)
    share = 0.5  # (5 + 1) / (10 + 2)
    step = (1 - share) / (share * (1 - share))  # gradient / curvature of a row of the class
    got = run.add(df.withColumn("margins", F.array(*[F.lit(m) for m in run.prior])), 0, 1).collect()
    for r in got:
        sign = 1 if r["label"] == 1 else -1
        assert r["margins"] == pytest.approx([run.prior[0] - sign * 0.5 * step, run.prior[1] + sign * 0.5 * step])


def test_importance_names_features(made):
    table = models.importance(models.fit_tree(train_of(made), made[1], max_depth=4), made[0], k=5).collect()
    assert 0 < len(table) <= 5 and all(r["importance"] > 0 for r in table) and not table[0]["feature"].isdigit()


def test_grid_points_cover_the_grid():
    assert len(models.grid_points(models.GRIDS["Decision_Tree"])) == 8
    assert [len(models.grid_points(g)) for g in models.GRIDS.values()] == [4, 8, 8, 4]


def test_batch_prediction_of_raw_rows(spark, made):
    inc = with_split(incidents(spark, SF), TRAIN_END, VALIDATION_END)
    medians = features.fit_medians(inc.filter("split = 'train'"))
    fitted = models.fit_tree(train_of(made), made[1], max_depth=4)
    raw = inc.filter("split = 'test'").drop("primary_type", "arrest", "split")
    got = models.predict_raw(raw, fitted, made[2], medians)
    assert got.count() == raw.count() and {r[0] for r in got.select("predicted").distinct().collect()} <= set(made[1])


def test_tuning_keeps_fitted_candidates(made):
    train, val = models.balanced(train_of(made), "primary_type"), made[0].filter("split = 'validation'")
    results, fitted = models.tune(train, val, made[1], "primary_type", "e", grids={
        "Decision_Tree": {"max_depth": [2], "weight": [None, "weight"]}, "Random_Forest": {"max_depth": [2], "trees": [2]}},
        baselines={"Decision_Tree": {"max_depth": 3}, "Random_Forest": {"max_depth": 3, "trees": 2}})
    assert results.count() == len(fitted) == 5
    assert {r["tag"] for r in results.collect()} == {"baseline", "tuned_01", "tuned_02"}


def test_trees_read_the_shares_and_do_not_make_them_again(made, monkeypatch):
    """A tree takes a pass per level: the softmax of a round belongs to the pass that makes the margins."""
    plans = []

    class Seen(boosting.RandomForestRegressor):
        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(rows)

    monkeypatch.setattr(boosting, "RandomForestRegressor", Seen)
    boosting.boost(train_of(made), len(made[1]), rounds=1, max_depth=1, rate=0.1)
    assert len(plans) == len(made[1]) and not any("exp(" in p.lower() for p in plans)


def test_trees_order_the_levels_of_one_hot_entries(made):
    """Declared as a set of levels, each entry was looked up in a set of such features at every node."""
    train = train_of(made)
    groups = models.ordered_levels(train).schema["features"].metadata["ml_attr"]["attrs"]
    assert "binary" not in groups and {a["num_vals"] for a in groups["nominal"]} == {models.ORDERED}
    names = {a["idx"]: a["name"] for part in groups.values() for a in part}
    assert names == {a["idx"]: a["name"] for part in train.schema["features"].metadata["ml_attr"]["attrs"].values() for a in part}
    few = train.limit(models.ORDERED - 1)
    assert models.ordered_levels(few).schema == few.schema
    fitted = models.fit_tree(train, made[1], max_depth=6)
    plain = models.DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=10, seed=models.SEED).fit(train)
    assert fitted.models[0].numNodes == plain.numNodes


def test_forest_grows_in_groups_of_trees(made, spark):
    """A task a core sent all nodes' counts; now few rows are one task, and groups of trees fill the cores."""
    train, seen = train_of(made), []

    class Watched(models.RandomForestClassifier):
        def _fit(self, rows):
            seen.append((self.getNumTrees(), rows.rdd.getNumPartitions()))
            return super()._fit(rows)

    plain, models.RandomForestClassifier = models.RandomForestClassifier, Watched
    try:
        fitted = models.fit_forest(train, made[1], trees=9, max_depth=3)
    finally:
        models.RandomForestClassifier = plain
    assert sorted(seen) == [(2, 1), (2, 1), (2, 1), (3, 1)] and fitted.models[0].getNumTrees == 9
    assert len({t.toDebugString.split("\n", 1)[1] for t in fitted.models[0].trees}) > 4


def test_answers_behind_class_scores_are_stored(made):
    """The model's answers were made anew for every use of them."""
    fitted = models.fit_tree(train_of(made), made[1], max_depth=3)
    plan = model_queries._class_scores(fitted, made[0].filter("split = 'validation'"))._jdf.queryExecution().toString()
    assert "UDF" not in plan and "FileScan parquet" in plan
