"""Encoding, classifiers, tuning and persistence on Spark ML.

Defaults are the settings the results are compared under; every one is a parameter.
Boosting is softmax boosting with carried margins, see ``boosting``.
"""
from __future__ import annotations

import itertools
import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel,
    RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.predicates import parse_bool
from precinct.functions.scalars import norm_text
from precinct.operators import boosting
from precinct.operators.evaluation import METRICS, assert_no_leakage, confusion, overall, per_class
from precinct.operators.features import (
    MixTables, add_area_group, add_cyclic, add_domestic_int, add_mix_features, add_temporal, apply_frequencies, final_features,
    fit_frequencies, fit_mix, handle_missing, mix_keys, on_the_hour_share, with_predicted)
from precinct.operators.histograms import BoostedModel
from precinct.operators.relational import (
    class_names, class_weights, keep_top_classes, label_by_frequency, label_by_name, lookup)
from precinct.operators.splits import stratified_split
from precinct.schema import INCIDENTS, Roles
from precinct.session import TASK_ROWS, dealt, settle, store

CATEGORICAL = ("location_description", "beat", "district", "ward", "community_area", "area_group")
NUMERIC = ("latitude", "longitude", "year", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin",
           "month_cos", "is_weekend", "domestic_int", "coordinates_missing")
SEED = 42
ORDERED = 6  # levels from which on a tree of 32 bins (the default) orders them
# A row keeps the node it has reached in each tree: no pass walks down from the roots again.  Nothing of it is written.
PASSES_KEEP = dict(cacheNodeIds=True, checkpointInterval=-1)

# ------------------------------------------------------------- encoded features

def model_rows(df: DataFrame, medians: tuple[float, float], roles: Roles = INCIDENTS) -> DataFrame:
    """Row features of the baseline models: calendar, quadrant, flag, filled gaps, codes as text."""
    made = add_domestic_int(add_cyclic(add_temporal(df, roles.ts)), roles.flag)
    made = made.withColumn("year", F.year(roles.ts))
    made = handle_missing(add_area_group(made, *medians, roles), medians, roles)
    return made.withColumns({c: F.col(c).cast("string") for c in roles.codes})


def encoder_stages(categorical=CATEGORICAL, numeric=NUMERIC, scale_numeric: bool = False) -> list:
    """Index, one-hot (a level training lacks keeps its own slot), optional scaling, assembly.

    Scaling touches the numeric block only, so the one-hot part stays sparse.
    """
    assert_no_leakage([*categorical, *numeric])
    index, hot = [f"{c}_idx" for c in categorical], [f"{c}_ohe" for c in categorical]
    stages = [StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"),
              OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep")]
    if scale_numeric:
        stages += [VectorAssembler(inputCols=list(numeric), outputCol="numbers", handleInvalid="keep"),
                   StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
                   VectorAssembler(inputCols=[*hot, "scaled"], outputCol="features", handleInvalid="keep")]
    else:
        stages.append(VectorAssembler(inputCols=[*hot, *numeric], outputCol="features", handleInvalid="keep"))
    return stages


def fit_encoder(train: DataFrame, **kwargs) -> PipelineModel:
    return Pipeline(stages=encoder_stages(**kwargs)).fit(train)


def median_imputer(cols) -> Imputer:
    return Imputer(inputCols=list(cols), outputCols=list(cols), strategy="median")


def fit_labels(train: DataFrame, target: str, by: str = "name") -> DataFrame:
    """Label table (class, ordinal label) by name or by frequency."""
    return settle({"name": label_by_name, "frequency": label_by_frequency}[by](train, target))


def attach_labels(df: DataFrame, labels: DataFrame, target: str, unseen: str = "minus_one") -> DataFrame:
    """Add ``label``; a class training lacks gets -1, or is an error."""
    out = lookup(df, labels, [target], {"label": -1.0})
    if unseen == "error" and not out.filter(F.col("label") < 0).isEmpty():
        raise ValueError(f"{target} holds classes that training never shows")
    return out


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, vector sizes and missing labels per split."""
    size = F.size(vector_to_array("features"))
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.min(size).alias("min_size"), F.max(size).alias("max_size"),
                                   F.count(F.when(F.col("label").isNull(), 1)).alias("missing_labels"))


def metadata(train: DataFrame, medians: tuple[float, float], sizes: dict[str, int], roles: Roles = INCIDENTS) -> DataFrame:
    """One row of facts about the prepared data, all of them computed."""
    width = train.select(F.size(vector_to_array("features")).alias("n")).limit(1)
    return train.agg(F.count_distinct(roles.target).alias("number_of_target_classes")).select(
        F.lit(medians[0]).alias("training_median_latitude"), F.lit(medians[1]).alias("training_median_longitude"),
        width.scalar().alias("feature_vector_size"), "number_of_target_classes",
        *[F.lit(n).cast("long").alias(f"{k}_rows") for k, n in sizes.items()])

# ------------------------------------------------------------------ classifiers


@dataclass
class Fitted:
    """A fitted classifier: ``transform`` adds ``probability`` (array by class) and ``predicted``."""

    models: list
    classes: list[str]
    converged: bool = True
    seconds: float = 0.0
    facts: dict = field(default_factory=dict)

    @property
    def boosted(self) -> bool:
        return isinstance(self.models[0], GBTRegressionModel)

    def margins(self, df: DataFrame) -> DataFrame:
        """Add ``margins`` of a boosted model: its starting margins and the sum of each class's trees."""
        return boosting.with_margins(df, self.models, [F.lit(m) for m in self.facts["prior"]])

    def transform(self, df: DataFrame) -> DataFrame:
        if self.boosted:
            scored = self.margins(df).withColumn("probability", boosting.softmax(F.col("margins"))).drop("margins")
        else:
            scored = self.models[0].transform(df).withColumn("probability", vector_to_array("probability"))
        return with_predicted(scored, self.classes)


def _timed(estimator, rows: DataFrame, classes: list[str]) -> Fitted:
    start = time.perf_counter()
    model = estimator.fit(dealt(rows))  # a row of some hundred binned features is far larger in memory than in a file
    return Fitted([model], classes, seconds=time.perf_counter() - start)


def ordered_levels(train: DataFrame) -> DataFrame:
    """``train`` with the 0/1 entries of ``features`` declared as levels that trees order, not as a set of which they try all subsets.

    Two values have one split either way.  For subsets Spark ML looks each entry of each row up in a set of such features, at every
    node of every tree, which takes most of a forest's time.  A table with fewer rows than levels stays as it is.
    """
    about = train.schema["features"].metadata
    groups = about.get("ml_attr", {}).get("attrs", {})
    if not groups.get("binary") or train.limit(ORDERED).count() < ORDERED:
        return train
    levels = [{k: v for k, v in a.items() if k in ("idx", "name")} | {"type": "nominal", "num_vals": ORDERED} for a in groups["binary"]]
    declared = {k: v for k, v in groups.items() if k != "binary"} | {"nominal": [*groups.get("nominal", []), *levels]}
    return train.withMetadata("features", about | {"ml_attr": about["ml_attr"] | {"attrs": declared}})


def _common(weight: str | None) -> dict:
    names = dict(featuresCol="features", labelCol="label", probabilityCol="probability", predictionCol="", rawPredictionCol="")
    return {**names, "weightCol": weight} if weight else names


def fit_logistic(train: DataFrame, classes: list[str], c: float = 1.0, max_iter: int = 600, tol: float = 1e-3,
                 weight: str | None = None) -> Fitted:
    """Multinomial logistic regression with an L2 penalty of 1 / (C n)."""
    estimator = LogisticRegression(family="multinomial", maxIter=max_iter, tol=tol, regParam=1.0 / (c * train.count()),
                                   standardization=False, **_common(weight))
    fitted = _timed(estimator, train, classes)
    rounds = fitted.models[0].summary.totalIterations
    fitted.converged, fitted.facts = rounds < max_iter, {"iterations": rounds}
    return fitted


def fit_tree(train: DataFrame, classes: list[str], max_depth: int = 16, min_leaf: int = 10,
             weight: str | None = None) -> Fitted:
    return _timed(DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=SEED, **PASSES_KEEP, **_common(weight)),
                  ordered_levels(train), classes)


def fit_forest(train: DataFrame, classes: list[str], trees: int = 100, max_depth: int = 20, min_leaf: int = 5,
               features: str = "sqrt", weight: str | None = None) -> Fitted:
    """A random forest, grown in groups of trees side by side where its rows fill few tasks.

    Every task of a pass sends its counts for all nodes of the pass, so a forest of few rows cut into a task a core mostly
    moves counts; the rows are cut by their number instead and the groups (each with a seed of its own) keep the cores busy.
    """
    start, spark = time.perf_counter(), train.sparkSession
    rows = ordered_levels(train)
    parts = max(1, -(-rows.count() // TASK_ROWS))
    rows = rows.coalesce(parts) if rows.rdd.getNumPartitions() > parts else rows.repartition(parts)
    groups = max(1, min(-(-spark.sparkContext.defaultParallelism // parts), trees // 2))

    def grow(group: int) -> RandomForestClassificationModel:
        estimator = RandomForestClassifier(numTrees=len(range(group, trees, groups)), maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=SEED + group,
                                           featureSubsetStrategy=features, **PASSES_KEEP, **_common(weight))
        return estimator.fit(rows)

    with ThreadPoolExecutor(groups) as threads:
        grown = list(threads.map(inheritable_thread_target(spark)(grow), range(groups)))
    return Fitted([joined_forest(grown)], classes, seconds=time.perf_counter() - start)


def joined_forest(forests: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of several that were grown on the same rows."""
    first, context = forests[0], SparkContext._active_spark_context
    if len(forests) == 1:
        return first
    found = [tree._java_obj for forest in forests for tree in forest.trees]
    trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(found))
    for i, tree in enumerate(found):
        trees[i] = tree
    made = RandomForestClassificationModel(context._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        first.uid, trees, first.numFeatures, first.numClasses))
    made._java_obj.set(made._java_obj.getParam("numTrees"), len(found))
    return (made.setFeaturesCol(first.getFeaturesCol()).setPredictionCol(first.getPredictionCol())
            .setProbabilityCol(first.getProbabilityCol()).setRawPredictionCol(first.getRawPredictionCol()))


def fit_boosted(train: DataFrame, classes: list[str], rounds: int = 100, max_depth: int = 5, rate: float = 0.1,
                subsample: float = 0.8, columns: str = "0.8", min_leaf: int = 1, weight: str | None = None,
                validation: DataFrame | None = None, patience: int = 50, max_bins: int = 32, **settings) -> Fitted:
    """Softmax boosting with carried margins; with validation rows it ends ``patience`` rounds after the best one, which is kept.

    ``min_leaf`` bounds rows per leaf, not their curvature, and there is no penalty on leaf values.
    """
    models, facts, seconds = boosting.fit(
        train, classes, rounds=rounds, max_depth=max_depth, rate=rate, subsample=subsample, columns=columns, min_leaf=min_leaf,
        weight=weight, validation=validation, patience=patience, max_bins=max_bins, seed=SEED, **settings)
    return Fitted(models, classes, seconds=seconds, facts=facts)


def fit_final(train: DataFrame, validation: DataFrame, classes: list[str], rounds: int = 2000, max_depth: int = 7,
              rate: float = 0.06, **kwargs) -> Fitted:
    """The final model: slower, deeper boosting stopped early on the validation period."""
    settings = dict(subsample=0.8, columns="0.7", min_leaf=5) | kwargs
    return fit_boosted(train, classes, rounds, max_depth, rate, validation=validation, **settings)


FINAL_NUMERIC = ("hour", "minute", "day_of_week", "month", "day", "is_midnight", "on_the_hour", "first_of_month", "is_weekend",
                 "domestic_int", "latitude", "longitude", "rot45_a", "rot45_b", "coordinates_missing", "beat_num",
                 "district_num", "ward_num", "community_area_num", "location_description_freq", "beat_freq")
FINAL_GAPS = ("latitude", "longitude", "rot45_a", "rot45_b", "beat_num", "district_num", "ward_num", "community_area_num")
FINAL_LEVELS = ("location_description", "district")


@dataclass
class FinalModel:
    """Everything the final model needs to score raw rows with the feature code of training."""

    frequencies: dict[str, DataFrame]
    mix: MixTables
    encoder: PipelineModel
    fitted: Fitted
    on_hour: float  # share of training records logged at minute 0
    roles: Roles = INCIDENTS

    def known(self, column: str) -> DataFrame:
        """The values of ``column`` (one with frequencies) that training shows."""
        return self.frequencies[column].select(column)

    def encoded(self, df: DataFrame) -> DataFrame:
        """Raw rows with ``features``."""
        return self.encoder.transform(_final_inputs(df, self.frequencies, self.mix, None, self.roles))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.transform(self.encoded(df))

    def save(self, path: str) -> None:
        """Write everything that scoring needs under ``path``."""
        mix = self.mix
        tables = {"mix": mix.table} | {f"frequency_{c}": t for c, t in self.frequencies.items()}
        facts = dict(classes=mix.classes, prior=mix.prior, tags=mix.tags, folds=mix.folds, sizes=mix.sizes,
                     frequencies=list(self.frequencies), on_hour=self.on_hour, roles=asdict(self.roles))
        save_state(mix.table.sparkSession, path, self.fitted, self.encoder, tables, facts)

    @classmethod
    def load(cls, spark, path: str) -> "FinalModel":
        fitted, encoder, tables, facts = load_state(spark, path)
        mix = MixTables(tables["mix"], facts["classes"], facts["prior"], facts["tags"], facts["folds"], facts["sizes"])
        roles = Roles(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts["roles"].items()})
        return cls({c: tables[f"frequency_{c}"] for c in facts["frequencies"]}, mix, encoder, fitted, facts["on_hour"], roles)


def _final_inputs(df: DataFrame, shares: dict[str, DataFrame], mix: MixTables, in_training, roles: Roles) -> DataFrame:
    return add_mix_features(apply_frequencies(final_features(df, roles), shares), mix, in_training, roles)


def fit_final_model(train: DataFrame, validation: DataFrame, roles: Roles = INCIDENTS, **settings) -> FinalModel:
    """Row features, frequencies and mix tables from training rows, then boosting stopped on the validation rows.

    Training rows take their out-of-fold mix; validation rows the full training tables.
    """
    base = final_features(train, roles)
    shares, mix = fit_frequencies(base, ["location_description", "beat"]), fit_mix(base, mix_keys(roles), roles)
    own = store(_final_inputs(train, shares, mix, F.lit(True), roles))
    held = store(_final_inputs(validation, shares, mix, None, roles))
    mixed = [f"mix_{t}_{c}" for t in mix.tags for c in mix.classes]
    index = [f"{c}_idx" for c in FINAL_LEVELS]
    inputs = [*FINAL_NUMERIC, *mixed, *index]
    assert_no_leakage(inputs)
    stages = [median_imputer(FINAL_GAPS), StringIndexer(inputCols=list(FINAL_LEVELS), outputCols=index, handleInvalid="keep"),
              VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]
    encoder = Pipeline(stages=stages).fit(own)
    labels = fit_labels(own, roles.target)
    encoded = [store(attach_labels(encoder.transform(part), labels, roles.target).select("label", "features"))
               for part in (own, held)]
    levels = max(own.select(c).distinct().count() for c in FINAL_LEVELS) + 1
    fitted = fit_final(*encoded, class_names(own, roles.target), **{"max_bins": max(32, levels), **settings})
    return FinalModel(shares, mix, encoder, fitted, on_the_hour_share(train, roles.ts).first()[0], roles)


INTERIM_NUMERIC = ("hour", "month", "day_of_week", "is_weekend", "domestic", "community_area", "district", "ward", "beat",
                   "latitude", "longitude")


def interim_rows(df: DataFrame, medians: tuple[float, float], roles: Roles = INCIDENTS) -> DataFrame:
    """The twelve inputs of the interim model (absent codes and flag are 0, absent location OTHER).

    Rows without a date or a class are no training rows.
    """
    usable = df.filter(F.col(roles.ts).isNotNull() & F.col(roles.target).isNotNull())
    filled = handle_missing(add_temporal(usable, roles.ts), medians, roles, codes=roles.codes, preset="interim")
    return filled.withColumns({roles.flag: parse_bool(F.col(roles.flag)).cast("int"), roles.context: norm_text(F.col(roles.context))})


def fit_interim(df: DataFrame, medians: tuple[float, float], top: int = 15, trees: int = 100, max_depth: int = 18,
                min_leaf: int = 4, roles: Roles = INCIDENTS) -> tuple[Fitted, PipelineModel, DataFrame]:
    """Interim forest on the most frequent classes with a stratified 80 / 20 split.

    Returns the model, its encoder and the encoded test part.
    """
    kept = keep_top_classes(interim_rows(df, medians, roles), roles.target, top)
    rows = stratified_split(kept, roles.target, 0.2, roles.id)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    encoder = fit_encoder(train, categorical=(roles.context,), numeric=INTERIM_NUMERIC, scale_numeric=True)
    labels = fit_labels(train, roles.target)
    encoded = store(attach_labels(encoder.transform(train), labels, roles.target).select("label", "features"))
    model = fit_forest(encoded, class_names(train, roles.target), trees, max_depth, min_leaf)
    # Stored: every use of the test part would join, split and encode all rows again.
    return model, encoder, store(attach_labels(encoder.transform(test), labels, roles.target))

# ----------------------------------------------------------- tuning and results

FAMILIES = {"Logistic_Regression": fit_logistic, "Decision_Tree": fit_tree, "Random_Forest": fit_forest,
            "Boosted_Trees": fit_boosted}

# The search grids.
GRIDS = {
    "Logistic_Regression": {"c": [0.1, 1.0], "weight": [None, "weight"], "max_iter": [1200]},
    "Decision_Tree": {"max_depth": [12, 20], "min_leaf": [5, 20], "weight": [None, "weight"]},
    "Random_Forest": {"max_depth": [16, 24], "min_leaf": [5, 15], "weight": [None, "weight"]},
    "Boosted_Trees": {"max_depth": [4, 6], "rate": [0.05, 0.1], "rounds": [150]},
}

RESULT_SCHEMA = ("model string, tag string, experiment_id string, basis string, training_seconds double, "
                 "evaluation_seconds double, train_macro_f1 double, converged boolean, "
                 + ", ".join(f"{m} double" for m in METRICS))


def balanced(train: DataFrame, target: str) -> DataFrame:
    """Add the balanced class weight as column ``weight``."""
    return lookup(train, settle(class_weights(train, target).select(target, "weight")), [target], {"weight": 1.0})


def scores(fitted: Fitted, rows: DataFrame, target: str) -> dict[str, float]:
    """Metrics of one model on one split: a single pass into class x class cells, then five numbers."""
    pred = fitted.transform(rows).select(F.col(target).alias("actual"), "predicted")
    cells = settle(confusion(pred, fitted.classes))
    return overall(cells).first().asDict()


def run_candidate(name: str, tag: str, train: DataFrame, validation: DataFrame, classes: list[str], target: str,
                  experiment: str, **params) -> tuple[Fitted, tuple]:
    fitted = FAMILIES[name](train, classes, **params)
    own = scores(fitted, train, target)["macro_f1"]
    start = time.perf_counter()
    held = scores(fitted, validation, target)
    row = (name, tag, experiment, "validation", fitted.seconds, time.perf_counter() - start, own, fitted.converged,
           *[held[m] for m in METRICS])
    return fitted, row


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def _standing(row: dict) -> tuple:
    return -row["macro_f1"], -row["weighted_f1"], row["training_seconds"], row["model"]


def one_by_one(candidates: list[tuple[str, str, dict]], run) -> list[tuple[Fitted, tuple]]:
    return [run(*candidate) for candidate in candidates]


def tune(train: DataFrame, validation: DataFrame, classes: list[str], target: str, experiment: str,
         baselines: dict[str, dict], grids: dict[str, dict] = GRIDS, families: int = 2, runner=one_by_one
         ) -> tuple[DataFrame, dict[tuple[str, str], Fitted]]:
    """Baselines first, then the grids of the best converged families, all on the fixed validation period.

    Returns the result rows (one per candidate) and the fitted candidates; none is refitted.  ``runner`` runs the
    candidates of a step: one by one, or ``search.Trials``, which takes up a search that was interrupted.
    """
    columns = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    fitted: dict[tuple[str, str], Fitted] = {}

    def run(name: str, tag: str, params: dict) -> tuple[Fitted, tuple]:
        return run_candidate(name, tag, train, validation, classes, target, experiment, **params)

    def evaluated(candidates: list[tuple[str, str, dict]]) -> list[dict]:
        rows = []
        for (name, tag, _), (model, row) in zip(candidates, runner(candidates, run)):
            fitted[name, tag] = model
            rows.append(dict(zip(columns, row)))
        return rows

    first = evaluated([(name, "baseline", params) for name, params in baselines.items()])
    leading = sorted((row for row in first if row["converged"]), key=_standing)
    if len(leading) < min(families, 2):
        raise RuntimeError("Tuning needs two baselines that converged")
    second = evaluated([(row["model"], f"tuned_{i:02d}", params) for row in leading[:families]
                        for i, params in enumerate(grid_points(grids[row["model"]]), start=1)])
    return train.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in first + second], RESULT_SCHEMA), fitted


def importance(fitted: Fitted, encoded: DataFrame, k: int = 15) -> DataFrame:
    """Largest feature importances with the feature names of the assembled vector."""
    attrs = encoded.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    total: dict[int, float] = {}
    for model in fitted.models:
        vector = model.featureImportances
        for i, v in zip(vector.indices, vector.values):
            total[int(i)] = total.get(int(i), 0.0) + float(v) / len(fitted.models)
    rows = sorted(((names.get(i, str(i)), v) for i, v in total.items()), key=lambda r: (-r[1], r[0]))[:k]
    return encoded.sparkSession.createDataFrame(rows, "feature string, importance double")

# ------------------------------------------------------------- decision weights

# Multipliers tried per class, passes, smallest gain that counts.
MULTIPLIERS = (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0)
PASSES, MIN_GAIN = 3, 1e-5


def _weighted(weights: list[float]) -> list:
    return [F.col("probability")[i] * F.lit(w) for i, w in enumerate(weights)]


def _step_scores(pred: DataFrame, classes: list[str], weights: list[float], tried: dict[int, list[float]]) -> dict[int, list[float]]:
    """For each class in ``tried`` the macro F1 of each of its tried weights, all others fixed; one scan for all of them.

    Raising the weight of a class can only turn a row's answer into that class, so for it a row is
    described by its true class, its best other class and how many of the tried weights
    flip it.  The rows collapse map-side into those few cells; the candidates are then
    scored on the cells, not on the rows.
    """
    product = _weighted(weights)
    names = F.array(*[F.lit(c) for c in classes])

    def step(k: int) -> Column:
        others = F.array(*[F.lit(float("-inf")) if i == k else p for i, p in enumerate(product)])
        return F.struct(F.lit(k).alias("k"), F.col("probability")[k].alias("own"), others.alias("others"), F.array(*[F.lit(float(w)) for w in tried[k]]).alias("tried"))

    # One small expression per row and class: written out for all classes in one row, it outgrows what a JVM method may hold.
    width = len(next(iter(tried.values())))
    steps = pred.select("actual", F.explode(F.array(*[step(k) for k in tried])).alias("s")).select("actual", "s.*").withColumn("best", F.array_max("others"))
    placed = steps.withColumn("rival", F.array_position("others", F.col("best")).cast("int"))
    raised = [F.col("own") * F.col("tried")[i] for i in range(width)]
    wins = [((r > F.col("best")) | ((r == F.col("best")) & (F.col("k") < F.col("rival") - 1))).cast("int") for r in raised]
    cells = placed.select("actual", "k", "rival", sum(wins[1:], wins[0]).alias("hits")).groupBy("actual", "k", "rival", "hits").agg(F.count("*").alias("n"))
    # The ``hits`` largest tried weights flip the row (weights are tried in ascending order).
    trials = F.array(*[F.lit(i) for i in range(width)])
    cell = cells.withColumn("trial", F.explode(trials))
    answer = F.element_at(names, F.when(F.col("trial") >= width - F.col("hits"), F.col("k") + 1).otherwise(F.col("rival")))
    conf = cell.groupBy("k", "trial", "actual", answer.alias("predicted")).agg(F.sum("n").alias("n"))
    axis = (pred.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in tried])).alias("k")).withColumn("trial", F.explode(trials))
            .withColumn("actual", F.explode(names)).withColumn("predicted", F.col("actual"))
            .withColumn("n", F.lit(0).cast("long")))
    macro = (per_class(conf.unionByName(axis), ["k", "trial"]).filter(F.col("class").isin(*classes))
             .groupBy("k", "trial").agg(F.avg("f1").alias("f1")).collect())  # one row per class and tried weight
    found: dict[int, list[float]] = {k: [0.0] * width for k in tried}
    for r in macro:
        found[r["k"]][r["trial"]] = r["f1"]
    return found


@dataclass(frozen=True)
class Ascent:
    """State of the search for decision weights: the weights so far and the macro F1 they reach."""

    weights: tuple[float, ...]
    value: float

    def step(self, k: int, tried: list[float], values: list[float], min_gain: float) -> "Ascent":
        """The best of the tried weights of class ``k``, if it gains enough (the smallest among equals)."""
        reached = self
        for weight, value in zip(tried, values):
            if value > reached.value + min_gain:
                reached = Ascent(self.weights[:k] + (weight,) + self.weights[k + 1:], value)
        return reached

    def sweep(self, rows: DataFrame, classes: list[str], tried: dict[int, list[float]], min_gain: float) -> "Ascent":
        """One pass of the coordinate ascent over all classes in turn.

        A scan scores the steps of all classes still to come; they hold up to the first class that moves, so there are
        as many scans as classes that move, and one.
        """
        state, left = self, dict(tried)
        while left:
            values = _step_scores(rows, classes, list(state.weights), left)
            for k in list(left):
                moved = state.step(k, left.pop(k), values[k], min_gain)
                if moved != state:
                    state = moved
                    break
        return state


def tune_class_weights(pred: DataFrame, classes: list[str], passes: int = PASSES, multipliers=MULTIPLIERS,
                       min_gain: float = MIN_GAIN) -> tuple[list[float], float]:
    """Per-class decision weights by coordinate ascent on macro F1.

    ``pred`` holds ``actual`` and ``probability``; it is stored once.  The first pass tries the multipliers themselves,
    later ones multiples of the weight reached; a pass that moves nothing is the last one.
    """
    rows, factors = store(pred.select("actual", "probability")), sorted(multipliers)
    equal = [1.0] * len(classes)
    state = Ascent(tuple(equal), _step_scores(rows, classes, equal, {0: [1.0]})[0][0])
    for number in range(passes):
        before = state
        state = state.sweep(rows, classes, {k: [f * before.weights[k] if number else f for f in factors] for k in range(len(classes))}, min_gain)
        if state == before:
            break
    return list(state.weights), state.value


def apply_class_weights(pred: DataFrame, classes: list[str], weights: list[float]) -> DataFrame:
    return with_predicted(pred.withColumn("probability", F.array(*_weighted(weights))), classes)

# ------------------------------------------------------------------ persistence

_LOADERS = {m.__name__: m for m in (LogisticRegressionModel, DecisionTreeClassificationModel,
                                     RandomForestClassificationModel, BoostedModel)} | {"GBTRegressionModel": BoostedModel}
WRITERS = 8  # models written or read at the same time


def _side_by_side(spark, work, items) -> list:
    with ThreadPoolExecutor(WRITERS) as threads:
        return list(threads.map(inheritable_thread_target(spark)(work), items))


def save_state(spark, path: str, fitted: Fitted, encoder: PipelineModel, tables: dict[str, DataFrame] | None = None,
               facts: dict | None = None) -> None:
    """Write the encoder, the models and the fitted tables under ``path``; the description comes last."""
    encoder.write().overwrite().save(f"{path}/encoder")
    writes = [model.write().overwrite().save for model in fitted.models] + [table.write.mode("overwrite").parquet for table in (tables or {}).values()]
    places = [f"{path}/models/{i}" for i in range(len(fitted.models))] + [f"{path}/tables/{name}" for name in tables or {}]
    _side_by_side(spark, lambda w: w[0](w[1]), list(zip(writes, places)))
    about = dict(classes=fitted.classes, kind=type(fitted.models[0]).__name__, models=len(fitted.models),
                 converged=fitted.converged, seconds=fitted.seconds, fitted=fitted.facts, facts=facts or {}, tables=sorted(tables or {}))
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_state(spark, path: str) -> tuple[Fitted, PipelineModel, dict[str, DataFrame], dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    models = _side_by_side(spark, lambda i: _LOADERS[about["kind"]].load(f"{path}/models/{i}"), range(about["models"]))
    fitted = Fitted(models, about["classes"], about["converged"], about["seconds"], about["fitted"])
    tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in about["tables"]}
    return fitted, PipelineModel.load(f"{path}/encoder"), tables, about["facts"]


def predict_raw(df: DataFrame, fitted: Fitted, encoder: PipelineModel, medians: tuple[float, float],
                roles: Roles = INCIDENTS) -> DataFrame:
    """Predicted class name of raw incident rows."""
    encoded = encoder.transform(model_rows(df, medians, roles))
    return fitted.transform(encoded).select(roles.id, "predicted", "probability")
