"""Encoding and model queries over the incident view.

Settings are the operators' defaults, but for the families of the search (see README for all of them).  A fit is made once per session and state of the files, and serves every query that
looks at it; the bench forgets it before each run.
"""
from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators import boosting, evaluation, export, features, models, quality, scoring, search
from precinct.operators.relational import class_names
from precinct.operators.selection import rank_results
from precinct.operators.splits import time_split, with_split
from precinct.plans.common import SPLIT, over, query, r6
from precinct.plans.feature_queries import predictions
from precinct.plans.quality_queries import AREA_GROUP, MEDIANS
from precinct.plans.scoring_queries import _resolved
from precinct.schema import LEAKAGE_COLUMNS
from precinct.session import shared_path, store
from precinct.sources.tables import snapshot_digest
from precinct.sources.testviews import TRAIN_END, VALIDATION_END, incidents

TARGET = "primary_type"
_FITS: dict = {}


def _state(spark, folder) -> tuple:
    """Names, sizes and times of the files that the incident view reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in ("orders", "customer", "nation"):
        place = path(f"{folder}/{name}.parquet")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files.listStatus(place)]
    return tuple(found)


def once(build):
    """Keep what a fit returns for the session and the state of the files."""
    @functools.wraps(build)
    def kept(spark, folder):
        key = (spark.sparkContext.applicationId, build.__name__, _state(spark, folder))
        if key not in _FITS:
            _FITS[key] = build(spark, folder)
        return _FITS[key]
    return kept


def forget() -> None:
    """Drop all kept fits."""
    _FITS.clear()


SUPPORT = ("SELECT primary_type AS class, count(*) AS support, count(*) AS agreeing, true AS better_than_majority "
           "FROM sp WHERE split = '{}' GROUP BY 1")


def facts(fitted, rows: DataFrame, train: DataFrame) -> DataFrame:
    """Per true class: rows scored, and rows whose answer follows from the exported tables too; and whether the model does
    better on its training rows than the largest class."""
    pred = fitted.transform(rows).select("unique_key", F.col(TARGET).alias("actual"), "predicted")
    own = fitted.transform(train).agg(F.avg((F.col("predicted") == F.col(TARGET)).cast("double")).alias("v")).first()["v"]
    counts = train.groupBy(TARGET).count()
    majority = counts.agg(F.max("count") / F.sum("count")).first()[0]
    return export.agreement(pred, export.score_by_tables(fitted, rows, "unique_key"), fitted.classes, "unique_key").withColumn(
        "better_than_majority", F.lit(own > majority))


def encoded(spark, folder, scale: bool = False):
    """(encoded rows with split and label, classes, encoder)."""
    inc = store(with_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END), partition_by="split")
    medians = features.fit_medians(inc.filter(F.col("split") == "train"))
    rows = models.model_rows(inc, medians)
    fit_on = rows.filter(F.col("split") == "train")
    encoder = models.fit_encoder(fit_on, scale_numeric=scale)
    labels = models.fit_labels(fit_on, TARGET)
    made = models.attach_labels(encoder.transform(rows), labels, TARGET)
    return made.select("unique_key", "date", TARGET, "split", "label", "features"), class_names(fit_on, TARGET), encoder


def prepared(spark, folder, scale: bool = False):
    """``encoded`` with its rows stored by split: the fit and all that looks at its answers read them, and none encodes them again."""
    made, classes, encoder = encoded(spark, folder, scale)
    return store(made, partition_by="split"), classes, encoder


def _split(made: DataFrame, name: str) -> DataFrame:
    return made.filter(F.col("split") == name)


def _validation_scores(fitted, made: DataFrame) -> DataFrame:
    return _class_scores(fitted, _split(made, "validation"))


def _class_scores(fitted, rows: DataFrame) -> DataFrame:
    """Scores per class; the answers are stored, as every use of them would run the model over all rows again."""
    pred = store(fitted.transform(rows).select(F.col(TARGET).alias("actual"), "predicted"))
    return evaluation.per_class(evaluation.confusion(pred, fitted.classes))


LEVELS = " + ".join(f"(SELECT count(DISTINCT {c}) + 1 FROM z WHERE split = 'train')" for c in
                    ("coalesce(location_description, 'Unknown')", "beat", "district", "coalesce(ward, -1)",
                     "coalesce(community_area, -1)", "area_group"))


@query("encode_assemble", over(
    f'SELECT split, count(*) AS "rows", CAST(12 + {LEVELS} AS INT) AS min_size, CAST(12 + {LEVELS} AS INT) AS max_size, '
    "CAST(0 AS BIGINT) AS missing_labels FROM z GROUP BY 1", sp=SPLIT, m=MEDIANS,
    z=f"SELECT *, {AREA_GROUP} AS area_group FROM sp, m"))
def encode_assemble(spark, folder):
    return models.split_summary(encoded(spark, folder)[0])


@query("leakage_check", "SELECT *, false AS among_features FROM (VALUES " + ", ".join(f"('{c}')" for c in LEAKAGE_COLUMNS) + ") AS t(column_name)")
def leakage_check(spark, folder):
    """The excluded columns, and whether one is among the names behind the encoded vector's entries."""
    made = encoded(spark, folder)[0]
    groups = made.schema["features"].metadata["ml_attr"]["attrs"].values()
    names = [a["name"] for group in groups for a in group]
    sources = {n for n in names} | {n.split("_ohe_")[0] for n in names}
    return spark.createDataFrame(evaluation.leakage_report(sources), "column_name string, among_features boolean")


@query("preprocessing_metadata", over(
    f"SELECT {r6('la')} AS training_median_latitude, {r6('lo')} AS training_median_longitude, CAST(12 + {LEVELS} AS INT) AS feature_vector_size, "
    "(SELECT count(DISTINCT primary_type) FROM z WHERE split = 'train') AS number_of_target_classes, "
    "(SELECT count(*) FROM z WHERE split = 'train') AS training_rows, (SELECT count(*) FROM z WHERE split = 'validation') AS validation_rows, "
    "(SELECT count(*) FROM z WHERE split = 'test') AS test_rows FROM m", sp=SPLIT, m=MEDIANS,
    z=f"SELECT *, {AREA_GROUP} AS area_group FROM sp, m"))
def preprocessing_metadata(spark, folder):
    made = encoded(spark, folder)[0]
    sizes = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}  # three rows
    medians = features.fit_medians(time_split(incidents(spark, folder), TRAIN_END, VALIDATION_END)[0])
    named = {"training": sizes["train"], "validation": sizes["validation"], "test": sizes["test"]}
    return models.metadata(_split(made, "train"), medians, named)


@once
def logistic_regression_fit(spark, folder):
    made, classes, encoder = prepared(spark, folder, scale=True)
    return models.fit_logistic(_split(made, "train"), classes), made, encoder


@query("logistic_regression")
def logistic_regression(spark, folder):
    return _validation_scores(*logistic_regression_fit(spark, folder)[:2])


@query("logistic_regression_facts", over(SUPPORT.format("validation"), sp=SPLIT))
def logistic_regression_facts(spark, folder):
    fitted, made, _ = logistic_regression_fit(spark, folder)
    return facts(fitted, _split(made, "validation"), _split(made, "train"))


@once
def decision_tree_fit(spark, folder):
    made, classes, encoder = prepared(spark, folder)
    return models.fit_tree(_split(made, "train"), classes), made, encoder


@query("decision_tree")
def decision_tree(spark, folder):
    return _validation_scores(*decision_tree_fit(spark, folder)[:2])


@query("decision_tree_facts", over(SUPPORT.format("validation"), sp=SPLIT))
def decision_tree_facts(spark, folder):
    fitted, made, _ = decision_tree_fit(spark, folder)
    return facts(fitted, _split(made, "validation"), _split(made, "train"))


@once
def random_forest_fit(spark, folder):
    made, classes, encoder = prepared(spark, folder)
    return models.fit_forest(_split(made, "train"), classes), made, encoder


@query("random_forest")
def random_forest(spark, folder):
    return _validation_scores(*random_forest_fit(spark, folder)[:2])


@query("random_forest_facts", over(SUPPORT.format("validation"), sp=SPLIT))
def random_forest_facts(spark, folder):
    fitted, made, _ = random_forest_fit(spark, folder)
    return facts(fitted, _split(made, "validation"), _split(made, "train"))


@once
def interim_fit(spark, folder):
    inc = incidents(spark, folder, spread=True)
    medians = features.fit_medians(inc)
    return *models.fit_interim(inc, medians), medians


@query("interim_forest_facts", over(
    "SELECT primary_type AS class, CAST(round(0.2 * count(*)) AS BIGINT) AS support, CAST(round(0.2 * count(*)) AS BIGINT) AS agreeing FROM inc GROUP BY 1 "
    "HAVING round(0.2 * count(*)) > 0"))
def interim_forest_facts(spark, folder):
    """The interim model's answers on its test part against its exported nodes."""
    fitted, _, test, _ = interim_fit(spark, folder)
    rows = test.select("unique_key", TARGET, "features")
    pred = fitted.transform(rows).select("unique_key", F.col(TARGET).alias("actual"), "predicted")
    return export.agreement(pred, export.score_by_tables(fitted, rows, "unique_key"), fitted.classes, "unique_key")


@query("interim_forest")
def interim_forest(spark, folder):
    fitted, _, test, _ = interim_fit(spark, folder)
    return _class_scores(fitted, test)


@once
def boosted_fit(spark, folder):
    made, classes, encoder = prepared(spark, folder)
    return models.fit_boosted(_split(made, "train"), classes), made, encoder


@query("boosted_trees")
def boosted_trees(spark, folder):
    return _validation_scores(*boosted_fit(spark, folder)[:2])


@query("boosted_trees_facts", over(SUPPORT.format("validation"), sp=SPLIT))
def boosted_trees_facts(spark, folder):
    fitted, made, _ = boosted_fit(spark, folder)
    return facts(fitted, _split(made, "validation"), _split(made, "train"))


@once
def final_model(spark, folder) -> models.FinalModel:
    """Fitted, written, and read back: what is scored with is the saved model."""
    train, validation, _ = time_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END)
    path = shared_path(spark)
    models.fit_final_model(train, validation).save(path)
    return models.FinalModel.load(spark, path)


def _test(spark, folder) -> DataFrame:
    return time_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END)[2]


@query("boosted_trees_final")
def boosted_trees_final(spark, folder):
    model = final_model(spark, folder)
    pred = model.transform(_test(spark, folder)).select(F.col(TARGET).alias("actual"), "predicted", "probability")
    return evaluation.topk_accuracy(pred, model.fitted.classes)


@query("final_model_facts", over(SUPPORT.format("test"), sp=SPLIT))
def final_model_facts(spark, folder):
    model = final_model(spark, folder)
    train = time_split(incidents(spark, folder), TRAIN_END, VALIDATION_END)[0]
    return facts(model.fitted, store(model.encoded(_test(spark, folder))), store(model.encoded(train)))


@query("final_model_rounds", over(
    "SELECT (SELECT count(*) FROM sp WHERE split = 'validation' AND primary_type IN (SELECT primary_type FROM sp WHERE split = 'train')) AS validation_rows, "
    "true AS losses_agree, true AS best_is_least, true AS ended_as_told", sp=SPLIT))
def final_model_rounds(spark, folder):
    """The loss that the saved model has on raw validation rows, against the one that boosting carried along."""
    model = final_model(spark, folder)
    told = model.fitted.facts
    held = [v for _, v in told["losses"]]
    labels = F.array(*[F.lit(c) for c in model.fitted.classes])
    place = F.array_position(labels, F.col(TARGET)).cast("int") - 1
    rows = model.transform(time_split(incidents(spark, folder), TRAIN_END, VALIDATION_END)[1]).filter(place >= 0)
    seen = rows.agg(F.count("*").alias("validation_rows"), F.avg(-F.log(F.get("probability", place))).alias("loss"))
    return seen.select("validation_rows", (F.abs(F.col("loss") - F.lit(held[told["best_round"] - 1])) < 1e-9).alias("losses_agree"),
                       F.lit(held[told["best_round"] - 1] == min(held)).alias("best_is_least"),
                       F.lit(told["rounds"] in (2000, told["best_round"] + 50)).alias("ended_as_told"))


@query("boosting_losses")
def boosting_losses(spark, folder):
    """Training and validation loss of the final model after every round."""
    return boosting.loss_table(spark, final_model(spark, folder).fitted.facts)


@query("previous_and_final")
def previous_and_final(spark, folder):
    """All metrics of the previous booster and of the final model on validation and test, the final one also with
    decision weights tuned on validation and applied once to test."""
    model, (previous, made, _) = final_model(spark, folder), boosted_fit(spark, folder)
    _, validation, test = time_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END)
    results = []

    def measured(name: str, basis: str, pred: DataFrame, classes: list[str]) -> None:
        cells = evaluation.confusion(pred.select("actual", "predicted"), classes)
        top3 = evaluation.topk_accuracy(pred, classes).select("top3_accuracy").scalar().alias("top3_accuracy")
        results.append(evaluation.overall(cells).select(F.lit(name).alias("model"), F.lit(basis).alias("basis"), *evaluation.METRICS, top3))

    for basis, raw in (("validation", validation), ("test", test)):
        measured("previous", basis, previous.transform(_split(made, basis)).withColumnRenamed(TARGET, "actual"), previous.classes)
        scored = store(model.transform(raw).select(F.col(TARGET).alias("actual"), "predicted", "probability"))
        measured("final", basis, scored, model.fitted.classes)
        if basis == "validation":
            weights, _ = models.tune_class_weights(scored, model.fitted.classes)
        else:
            measured("final weighted", basis, models.apply_class_weights(scored, model.fitted.classes, weights), model.fitted.classes)
    return reduce(DataFrame.unionByName, results)


@query("score_requests_final")
def score_requests_final(spark, folder):
    """Requests expanded over dates and minutes, scored by the saved final model, averaged per request.

    The known locations and the share of full hours come with the model: no training row is read.
    """
    model = final_model(spark, folder)
    known = quality.keep_known(_resolved(spark, folder), model.known("location_description"), "location_description")
    scored = scoring.score_distinct(scoring.expand_requests(known, F.lit(model.on_hour)), model)
    return scoring.long_probabilities(scoring.average_probabilities(scored, model.fitted.classes), model.fitted.classes)


@query("score_requests_interim")
def score_requests_interim(spark, folder):
    """Requests scored once each by the interim model."""
    fitted, encoder, _, _ = interim_fit(spark, folder)
    rows = scoring.interim_features(_resolved(spark, folder))
    scored = fitted.transform(encoder.transform(rows)).select("request_id", "probability")
    return scoring.long_probabilities(scored, fitted.classes)


FAMILIES = ("Logistic_Regression", "Decision_Tree", "Random_Forest")


@query("tuned_selection")
def tuned_selection(spark, folder):
    """Baselines of three families, then the grids of the best two, side by side, as rows of a trial table."""
    made, classes, _ = encoded(spark, folder, scale=True)
    train, validation = store(models.balanced(_split(made, "train"), TARGET)), store(_split(made, "validation"))
    digest = snapshot_digest(train.select("unique_key", TARGET), ["unique_key", TARGET]).first()["digest"]
    trials = search.Trials(spark, shared_path(spark), digest)
    results, _ = models.tune(train, validation, classes, TARGET, digest, baselines={name: {} for name in FAMILIES}, runner=trials)
    return rank_results(results)


@query("convergence", "SELECT * FROM (VALUES (3, false), (600, true)) AS t(max_iter, converged)")
def convergence(spark, folder):
    """A fit that is cut off, and the one at default settings."""
    fitted, made, _ = logistic_regression_fit(spark, folder)
    cut = models.fit_logistic(_split(made, "train"), fitted.classes, max_iter=3)
    return spark.createDataFrame([(3, cut.converged), (600, fitted.converged)], "max_iter int, converged boolean")


@query("class_decision_weights")
def class_decision_weights(spark, folder):
    pred, classes = predictions(spark, folder, split="validation")
    weights, best = models.tune_class_weights(pred, classes)
    return spark.createDataFrame(list(zip(classes, weights)), "class string, weight double").withColumn(
        "validation_macro_f1", F.lit(best))


@query("decision_weights_checked", "SELECT true AS value_is_reached, true AS not_worse_than_equal")
def decision_weights_checked(spark, folder):
    """The macro F1 that the search reports, against that of the rows answered with its weights."""
    pred, classes = predictions(spark, folder, split="validation")
    pred = store(pred.select("actual", "predicted", "probability"))
    weights, best = models.tune_class_weights(pred, classes)

    def macro(answers: DataFrame) -> float:
        found = evaluation.per_class(evaluation.confusion(answers.select("actual", "predicted"), classes))
        return found.filter(F.col("class").isin(*classes)).agg(F.avg("f1")).first()[0]

    reached = macro(models.apply_class_weights(pred, classes, weights))
    return spark.createDataFrame([(abs(reached - best) < 1e-12, best >= macro(pred))], "value_is_reached boolean, not_worse_than_equal boolean")


@query("feature_importance")
def feature_importance(spark, folder):
    fitted, made, _ = decision_tree_fit(spark, folder)
    return models.importance(fitted, made)


@query("boosted_importance")
def boosted_importance(spark, folder):
    """The final model's largest features."""
    model = final_model(spark, folder)
    return models.importance(model.fitted, model.encoded(_test(spark, folder)))


@query("importance_by_nodes", "SELECT * FROM (VALUES ('decision tree', true), ('final model', true)) AS t(model, same)")
def importance_by_nodes(spark, folder):
    """Importances recomputed from the exported nodes against those that the models report."""
    rows = []
    for name, fitted in (("decision tree", decision_tree_fit(spark, folder)[0]), ("final model", final_model(spark, folder).fitted)):
        own: dict[int, float] = {}
        for model in fitted.models:
            for i, v in zip(model.featureImportances.indices, model.featureImportances.values):
                own[int(i)] = own.get(int(i), 0.0) + float(v) / len(fitted.models)
        found = {r["feature"]: r["importance"] for r in export.importance_from_nodes(export.node_table(fitted, spark), per_tree=False).collect()}  # one row per feature
        rows.append((name, all(abs(own.get(i, 0.0) - found.get(i, 0.0)) < 1e-9 for i in {*own, *found})))
    return spark.createDataFrame(rows, "model string, same boolean")


@query("batch_prediction_facts", over(
    "SELECT primary_type AS class, count(*) AS support, count(*) AS agreeing FROM sp WHERE split = 'test' GROUP BY 1", sp=SPLIT))
def batch_prediction_facts(spark, folder):
    """Answers to raw rows against the exported nodes."""
    fitted, made, _ = decision_tree_fit(spark, folder)
    test = _split(made, "test")
    pred = batch_prediction(spark, folder).join(test.select("unique_key", F.col(TARGET).alias("actual")), "unique_key")
    return export.agreement(pred, export.score_by_tables(fitted, test, "unique_key"), fitted.classes, "unique_key")


@query("batch_prediction")
def batch_prediction(spark, folder):
    fitted, _, encoder = decision_tree_fit(spark, folder)
    train, _, test = time_split(incidents(spark, folder), TRAIN_END, VALIDATION_END)
    return models.predict_raw(test, fitted, encoder, features.fit_medians(train)).select("unique_key", "predicted")
