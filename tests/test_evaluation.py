import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct.operators import evaluation, models, selection
from precinct.schema import UNSEEN
from precinct.plans.feature_queries import predictions
from precinct.session import store
from conftest import SF

CLASSES = ["a", "b", "c"]


def scored(spark, n=400, seed=3, unseen=0):
    random = np.random.default_rng(seed)
    truth = [CLASSES[i] for i in random.choice(3, n, p=[0.7, 0.2, 0.1])] + ["z"] * unseen
    probability = random.dirichlet([3, 2, 1], n + unseen)
    df = spark.createDataFrame([(t, [float(x) for x in p]) for t, p in zip(truth, probability)],
                               "actual string, probability array<double>")
    return models.with_predicted(df, CLASSES), np.array(truth), probability


def f1_of(truth, guess, names):
    out = []
    for c in names:
        hits = np.sum((truth == c) & (guess == c))
        total = np.sum(truth == c) + np.sum(guess == c)
        out.append(2 * hits / total if total else 0.0)
    return np.array(out)


@pytest.mark.parametrize("unseen", [0, 5])
def test_metrics_match_numpy(spark, unseen):
    pred, truth, p = scored(spark, unseen=unseen)
    guess = np.array(CLASSES)[p.argmax(1)]
    conf = evaluation.confusion(pred, CLASSES)
    marked = np.where(np.isin(truth, CLASSES), truth, UNSEEN)
    for include in (True, False):
        names = CLASSES + ([UNSEEN] if unseen and include else [])
        f1, support = f1_of(marked, guess, names), np.array([np.sum(marked == c) for c in names])
        row = evaluation.overall(conf, include_unseen=include).first()
        assert row["accuracy"] == pytest.approx(np.mean(truth == guess))
        assert row["macro_f1"] == pytest.approx(f1.mean())
        assert row["weighted_f1"] == pytest.approx(np.sum(f1 * support) / support.sum())
    known = np.isin(truth, CLASSES)
    top = np.argsort(-p, axis=1)[:, :2]
    want = np.mean([t in np.array(CLASSES)[k] for t, k in zip(truth[known], top[known])])
    assert evaluation.topk_accuracy(pred, CLASSES, 2).first()[0] == pytest.approx(want)


def test_confusion_fills_the_axis_and_sums_to_rows(spark):
    pred, truth, _ = scored(spark, n=20)
    conf = evaluation.confusion(pred.withColumn("predicted", F.lit("a")), CLASSES)
    rows = conf.collect()
    assert len(rows) == 9 and sum(r["n"] for r in rows) == 20
    scores = {r["class"]: r for r in evaluation.per_class(conf).collect()}
    assert scores["c"]["precision"] == scores["c"]["f1"] == 0.0
    shares = evaluation.normalise_rows(evaluation.confusion(pred.filter("actual = 'a'"), CLASSES)).collect()
    assert sum(r["share"] for r in shares if r["actual"] == "b") == 0.0


def test_equal_probabilities_choose_the_first_class(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "probability array<double>")
    assert models.with_predicted(df, CLASSES).first()["predicted"] == "a"
    tops = evaluation.top_probabilities(df, CLASSES, 5).first()["top"]
    assert [t["category"] for t in tops] == ["a", "b", "c"]


def test_interpretation_and_error_pairs(spark):
    conf = spark.createDataFrame([("a", "a", 5), ("a", "b", 2), ("b", "a", 3), ("b", "b", 0)], "actual string, predicted string, n long")
    row = evaluation.interpret(evaluation.per_class(conf), conf).first()
    assert (row["best_class"], row["worst_class"], row["error_actual"], row["error_predicted"], row["error_rows"]) == ("a", "b", "b", "a", 3)


def brute_weights(truth, p, passes, multipliers):
    w = np.ones(3)
    macro = lambda: f1_of(truth, np.array(CLASSES)[(p * w).argmax(1)], CLASSES).mean()
    best = macro()
    for it in range(passes):
        for k in range(3):
            base, chosen = w[k], w[k]
            for g in multipliers:
                w[k] = base * g if it else g
                value = macro()
                if value > best + 1e-5:
                    best, chosen = value, w[k]
            w[k] = chosen
    return w, best


def test_class_weights_equal_a_direct_search(spark):
    pred, truth, p = scored(spark, n=300, seed=5)
    weights, best = models.tune_class_weights(pred, CLASSES, passes=2)
    want, value = brute_weights(truth, p, 2, models.MULTIPLIERS)
    assert weights == pytest.approx(list(want)) and best == pytest.approx(value)
    guess = [r["predicted"] for r in models.apply_class_weights(pred, CLASSES, weights).collect()]
    assert f1_of(truth, np.array(guess), CLASSES).mean() == pytest.approx(best)


RESULT = "model string, tag string, experiment_id string, macro_f1 double, weighted_f1 double, training_seconds double, converged boolean"
ROWS = [("lr", "baseline", "e", 0.30, 0.5, 9.0, True), ("dt", "baseline", "e", 0.30, 0.5, 2.0, True),
        ("lr", "tuned_01", "e", 0.35, 0.5, 9.0, False), ("dt", "tuned_01", "e", 0.32, 0.4, 3.0, True)]


def test_ranking_and_winner(spark):
    results = spark.createDataFrame(ROWS, RESULT)
    ranked = [(r["model"], r["tag"]) for r in selection.rank_results(results).orderBy("position").collect()]
    assert ranked == [("lr", "tuned_01"), ("dt", "tuned_01"), ("dt", "baseline"), ("lr", "baseline")]
    winner = selection.select_winner(results).first()
    assert (winner["model"], winner["tag"]) == ("dt", "tuned_01") and winner["macro_f1_change"] == pytest.approx(0.02)


def test_comparison_refuses_mixed_snapshots(spark):
    mixed = spark.createDataFrame([ROWS[0], (*ROWS[1][:2], "other", *ROWS[1][3:])], RESULT)
    with pytest.raises(ValueError, match="snapshots"):
        selection.comparison(mixed)


def test_test_period_is_evaluated_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(0.5,)], "accuracy double")

    for _ in range(2):
        assert selection.evaluate_once(spark, str(tmp_path / "m"), compute).first()[0] == 0.5
    assert calls == [1]


def test_leakage_check():
    evaluation.assert_no_leakage(["beat"])
    with pytest.raises(ValueError, match="arrest"):
        evaluation.assert_no_leakage(["beat", "arrest"])


def test_leakage_report_sees_through_derived_names():
    found = dict(evaluation.leakage_report(["latitude", "arrest_idx", "case_number_freq"]))
    assert found["arrest"] and found["case_number"] and not found["iucr"]


def test_overall_uses_its_cells_once(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("z", "a")], "actual string, predicted string")
    conf = evaluation.confusion(pred, ["a", "b"])
    plan = evaluation.overall(conf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Subquery" not in plan
    row = evaluation.overall(conf, include_unseen=False).first()
    assert row["accuracy"] == 0.5 and row["macro_recall"] == 0.75


def test_weights_need_a_scan_per_move(spark, monkeypatch):
    """Three passes over three classes: as many scans as moves, one per pass, one for the start, and not one per step."""
    pred, _, _ = scored(spark, n=300, seed=5)
    scans, step = [], models._step_scores
    monkeypatch.setattr(models, "_step_scores", lambda *a: (scans.append(a[2]), step(*a))[1])
    models.tune_class_weights(pred, CLASSES, passes=3)
    moves = sum(a != b for a, b in zip(scans[1:], scans[2:]))
    assert len(scans) <= moves + 1 + 1 + 3


def test_steps_of_all_classes_compile(spark):
    """The steps of six classes and eleven weights, on rows of the view: no stage is too large to be compiled."""
    pred, classes = predictions(spark, SF, split="validation")
    pred = store(pred.select("actual", "probability"))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        tried = {k: sorted(models.MULTIPLIERS) for k in range(len(classes))}
        found = models._step_scores(pred, classes, [1.0] * len(classes), tried)
        assert {k: len(v) for k, v in found.items()} == {k: 11 for k in range(6)}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
