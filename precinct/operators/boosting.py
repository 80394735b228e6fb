"""Softmax boosting that carries its margins.

A round looks at one table: label, features and the margins reached so far (one number per class).  From the margins come
each row's gradient and curvature per class; one Spark ML regression tree per class is fitted on gradient / curvature,
weighted by the curvature, so that a leaf's mean is the Newton step of its rows; the trees' answers are added to the
margins in one projection.  Training and validation rows are one table, so both losses come from the pass that makes the
new margins.  Every few rounds the table is stored in the shared folder: a lost executor costs the rounds since then.
Nothing is ever fitted twice: the best round's model is a prefix of the trees that are there.
"""
from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.operators import histograms
from precinct.session import store

POOL = 6  # classes whose trees are fitted at the same time
STORE_EVERY = 10  # rounds between two stored tables of margins
TASK_ROWS = 10_000  # rows of a task at least
LEAST_CURVATURE, LARGEST_STEP = 1e-6, 4.0  # bounds on one row's curvature and on gradient / curvature


def softmax(margins: Column) -> Column:
    """Probabilities of an array of margins."""
    shifted = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def log_loss(margins: Column, label: Column) -> Column:
    """Minus the log probability of the label (null for a label that training lacks)."""
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda a, m: a + F.exp(m - top))
    return F.when(label >= 0, top + F.log(total) - F.get(margins, label.cast("int")))


@dataclass
class Rounds:
    """What a run of boosting leaves: the trees of every round, starting margins, losses per round."""

    prior: list[float]
    rate: float
    trees: list[list[DecisionTreeRegressionModel]] = field(default_factory=list)
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    @property
    def best(self) -> int:
        """Number of rounds with the lowest validation loss; all of them without validation rows."""
        held = [v for _, v in self.losses]
        return len(held) if not held or held[-1] is None else min(range(len(held)), key=held.__getitem__) + 1

    def ensembles(self, spark, first: int = 0, last: int | None = None) -> list[GBTRegressionModel]:
        """Per class the trees of some rounds (up to the best one) as one Spark ML model, which scores, saves and explains them."""
        context = spark.sparkContext
        made = []
        for k in range(len(self.prior)):
            chosen = [r[k]._java_obj for r in self.trees[first:self.best if last is None else last]]
            trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(chosen))
            rates = context._gateway.new_array(context._jvm.double, len(chosen))
            for i, tree in enumerate(chosen):
                trees[i], rates[i] = tree, self.rate
            made.append(GBTRegressionModel(context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boosted_{k}", trees, rates)))
        return made

    def add(self, rows: DataFrame, first: int, last: int) -> DataFrame:
        """``rows`` with the answers of the rounds from ``first`` to before ``last`` added to the margins."""
        return with_margins(rows, self.ensembles(rows.sparkSession, first, last), [F.col("margins")[k] for k in range(len(self.prior))])


def with_margins(rows: DataFrame, models: list[GBTRegressionModel], start: list[Column]) -> DataFrame:
    """Set ``margins``: per class a start and the sum of the class's trees."""
    kept = [c for c in rows.columns if c != "margins"]
    for k, model in enumerate(models):
        rows = model.setPredictionCol(f"__t{k}").transform(rows)
    return rows.select(*kept, F.array(*[m + F.col(f"__t{k}") for k, m in enumerate(start)]).alias("margins"))


def _prior(train: DataFrame, classes: int, weight: str | None) -> list[float]:
    mass = F.sum(weight) if weight else F.count("*")
    found = {int(r["label"]): float(r["n"]) for r in train.groupBy("label").agg(mass.alias("n")).collect()}  # one row per class
    total = sum(found.values()) + classes
    return [math.log((found.get(k, 0.0) + 1.0) / total) for k in range(classes)]


def _losses(rows: DataFrame) -> tuple[float, float | None]:
    loss = F.avg(log_loss(F.col("margins"), F.col("label")))
    found = {r["training"]: r["loss"] for r in rows.groupBy("training").agg(loss.alias("loss")).collect()}
    return found[True], found.get(False)


def boost(train: DataFrame, classes: int, rounds: int, max_depth: int, rate: float, subsample: float = 1.0, columns: str = "all",
          min_leaf: int = 1, weight: str | None = None, validation: DataFrame | None = None, patience: int = 50, max_bins: int = 32,
          seed: int = 42, pool: int = POOL, store_every: int = STORE_EVERY) -> Rounds:
    """Boost until ``rounds`` are done or ``patience`` of them brought no lower validation loss.

    ``train`` and ``validation`` hold label (0 to ``classes`` - 1, -1 for a class that training lacks) and features.
    """
    def part(df: DataFrame, training: bool) -> DataFrame:
        mass = F.col(weight).cast("double") if weight and training else F.lit(1.0)
        return df.select(F.col("label").cast("double").alias("label"), "features", mass.alias("mass"), F.lit(training).alias("training"))

    run = Rounds(_prior(train, classes, weight), rate)
    rows = part(train, True)
    if validation is not None:
        rows = rows.unionByName(part(validation, False))
    # Fits of few rows are bound by the number of their tasks.
    found = rows.count()
    rows = rows.coalesce(max(1, -(-found // TASK_ROWS)))
    base = now = store(rows.withColumn("margins", F.array(*[F.lit(m) for m in run.prior])).withColumn("p", softmax(F.col("margins"))))
    stored, kept = 0, None

    def fit(k: int) -> DecisionTreeRegressionModel:
        share = F.col("p")[k]
        curve = F.greatest(share * (1 - share), F.lit(LEAST_CURVATURE))
        step = ((F.col("label") == k).cast("double") - share) / curve
        learn = graded.select("features", F.greatest(F.lit(-LARGEST_STEP), F.least(F.lit(LARGEST_STEP), step)).alias("step"), (curve * F.col("mass")).alias("curve"))
        tree = RandomForestRegressor(numTrees=1, bootstrap=False, subsamplingRate=subsample, featureSubsetStrategy=columns, maxDepth=max_depth,
                                     minInstancesPerNode=min_leaf, maxBins=max_bins, labelCol="step", weightCol="curve", seed=seed + number * classes + k)
        return tree.fit(learn).trees[0]

    with ThreadPoolExecutor(min(pool, classes)) as threads:
        fit_in_thread = inheritable_thread_target(train.sparkSession)(fit)
        for number in range(rounds):
            graded = now.where("training")
            trees = list(threads.map(fit_in_thread, range(classes)))
            run.trees.append(trees)
            # A short plan, however many rounds there were.  The shares are kept with the margins: every pass of every tree reads them.
            made = run.add(base.drop("p"), stored, number + 1).withColumn("p", softmax(F.col("margins")))
            if number + 1 - stored == store_every:
                base = made = store(made)
                stored, cached = number + 1, None
            else:
                cached = made = made.persist(StorageLevel.MEMORY_AND_DISK)
            run.losses.append(_losses(made))
            if kept is not None:
                kept.unpersist()
            now, kept = made, cached
            if validation is not None and len(run.losses) - run.best >= patience:
                break
    if kept is not None:
        kept.unpersist()
    return run


def fit(train: DataFrame, classes: list[str], rate: float, weight: str | None = None, **settings):
    """(per-class models, facts): the best round's trees, starting margins, losses of all rounds, seconds."""
    start = time.perf_counter()
    run = Rounds(_prior(train, len(classes), weight), rate)
    models, run.losses = histograms.grow(train, len(classes), run.prior, rate=rate, weight=weight, **settings)
    facts = {"best_round": run.best, "rounds": len(run.losses), "prior": run.prior, "losses": [list(v) for v in run.losses]}
    return models, facts, time.perf_counter() - start


def loss_table(spark, facts: dict) -> DataFrame:
    """One row per round: training and validation loss after it, and whether the model ends there."""
    rows = [(i, a, b, i == facts["best_round"]) for i, (a, b) in enumerate(facts["losses"], 1)]
    return spark.createDataFrame(rows, "round int, training_loss double, validation_loss double, kept boolean")
