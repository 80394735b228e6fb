"""Classification metrics from confusion counts.

Rows are counted once into (actual, predicted) cells; everything else works on those
class x class cells.  ``by`` lists columns that keep several models or splits apart.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.operators.relational import class_prior
from precinct.schema import LEAKAGE_COLUMNS, UNSEEN

METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


def confusion(pred: DataFrame, classes: list[str], by=(), full_axis: bool = True) -> DataFrame:
    """Counts per (actual, predicted); an actual class outside ``classes`` is marked unseen.

    With ``full_axis`` every pair of the known classes appears, absent ones with zero.
    """
    known = F.col("actual").isin(*classes)
    counts = (pred.groupBy(*by, F.when(known, F.col("actual")).otherwise(UNSEEN).alias("actual"), "predicted")
              .agg(F.count("*").alias("n")))
    if not full_axis:
        return counts
    # The label axis: classes x classes entries made from a literal.
    names = F.array(*[F.lit(c) for c in classes])
    groups = counts.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    axis = (groups.withColumn("actual", F.explode(names)).withColumn("predicted", F.explode(names))
            .withColumn("n", F.lit(0).cast("long")))
    return (counts.unionByName(axis).groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n")))


def normalise_rows(conf: DataFrame, by=()) -> DataFrame:
    """Share of each cell in its row (a row without records divides by one)."""
    total = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return conf.withColumn("share", F.col("n") / F.greatest(total, F.lit(1).cast("long")))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _class_sums(conf: DataFrame, by) -> DataFrame:
    """Rows, answers and hits per class, each cell counted once on either side."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), zero.alias("guessed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("guessed"), zero.alias("hits")))
    return (conf.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "class")
            .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")))


def _scores() -> dict[str, Column]:
    return {"precision": _ratio(F.col("hits"), F.col("guessed")), "recall": _ratio(F.col("hits"), F.col("support")),
            "f1": _ratio(2.0 * F.col("hits"), F.col("support") + F.col("guessed"))}


def per_class(conf: DataFrame, by=(), include_unseen: bool = True) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives zero."""
    sums = _class_sums(conf, by)
    if not include_unseen:
        sums = sums.filter(F.col("class") != UNSEEN)
    return sums.select(*by, "class", *[v.alias(name) for name, v in _scores().items()], "support")


def overall(conf: DataFrame, by=(), include_unseen: bool = True) -> DataFrame:
    """Accuracy over all rows; macro scores over all classes; F1 weighted by support.  All from one use of the cells."""
    by = list(by)
    sums = _class_sums(conf, by).withColumns(_scores())
    counted = F.lit(True) if include_unseen else F.col("class") != UNSEEN
    kept = lambda c: F.when(counted, c)
    return sums.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(kept(F.col("precision"))).alias("macro_precision"),
        F.avg(kept(F.col("recall"))).alias("macro_recall"), F.avg(kept(F.col("f1"))).alias("macro_f1"),
        (F.sum(kept(F.col("f1") * F.col("support"))) / F.sum(kept(F.col("support")))).alias("weighted_f1"))


def top_probabilities(df: DataFrame, classes: list[str], k: int = 5, keep=()) -> DataFrame:
    """The k most probable classes per row, largest first, first class among equals."""
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.zip_with("probability", names, lambda p, c: F.struct((-p).alias("minus"), c.alias("category")))
    ranked = F.slice(F.sort_array(pairs), 1, k)
    tops = F.transform(ranked, lambda x: F.struct(x["category"].alias("category"), (-x["minus"]).alias("probability")))
    return df.select(*keep, tops.alias("top"))


def topk_accuracy(pred: DataFrame, classes: list[str], k: int = 3, by=()) -> DataFrame:
    """Share of rows of known classes whose class is among the k most probable."""
    tops = top_probabilities(pred, classes, k, keep=[*by, "actual"])
    known = tops.filter(F.col("actual").isin(*classes))
    inside = F.exists("top", lambda t: t["category"] == F.col("actual"))
    return known.groupBy(*by).agg(F.avg(inside.cast("double")).alias(f"top{k}_accuracy"), F.count("*").alias("rows"))


def majority_accuracy(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Accuracy on test rows of always answering the commonest training class."""
    majority = class_prior(train, target).filter(F.col("rank") == 1).select(target).scalar()
    return test.agg(F.avg((F.col(target) == majority).cast("double")).alias("majority_accuracy"))


def generalisation_gap(train_scores: DataFrame, validation_scores: DataFrame) -> DataFrame:
    a, b = train_scores.select("macro_f1").scalar(), validation_scores.select("macro_f1").scalar()
    return train_scores.sparkSession.range(1).select(
        a.alias("train_macro_f1"), b.alias("validation_macro_f1"), (a - b).alias("gap"))


def error_pairs(conf: DataFrame, k: int = 1) -> DataFrame:
    """Largest off-diagonal cells."""
    wrong = conf.filter((F.col("actual") != F.col("predicted")) & (F.col("n") > 0))
    return wrong.orderBy(F.desc("n"), "actual", "predicted").limit(k)


def interpret(classes: DataFrame, conf: DataFrame) -> DataFrame:
    """One row: best and worst supported class and the largest error pair."""
    backed = classes.filter(F.col("support") > 0)
    ends = backed.agg(F.max(F.struct("f1", "class")).alias("best"), F.min(F.struct("f1", "class")).alias("worst"))
    pair = error_pairs(conf).select(F.struct("actual", "predicted", "n").alias("pair")).scalar()
    return ends.select(F.col("best.class").alias("best_class"), F.col("best.f1").alias("best_f1"),
                       F.col("worst.class").alias("worst_class"), F.col("worst.f1").alias("worst_f1"), pair.alias("pair")) \
        .select("best_class", "best_f1", "worst_class", "worst_f1", F.col("pair.actual").alias("error_actual"),
                F.col("pair.predicted").alias("error_predicted"), F.col("pair.n").alias("error_rows"))


def compare_models(scores: DataFrame, columns) -> DataFrame:
    """Metric by (model, basis) table: ``scores`` has model, basis and the metric columns."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = (scores.select(F.concat_ws(" ", "model", "basis").alias("side"), F.explode(entries).alias("e"))
            .select("side", "e.*"))
    return long.groupBy("metric").pivot("side", list(columns)).agg(F.first("value"))


def leakage_report(cols, excluded=LEAKAGE_COLUMNS) -> list[tuple[str, bool]]:
    """Every excluded column, and whether it is among ``cols`` (or among what they were made from)."""
    made = {c.removesuffix(end) for c in cols for end in ("", "_idx", "_ohe", "_num", "_freq", "_int")}
    return [(c, c in made) for c in excluded]


def assert_no_leakage(cols, excluded=LEAKAGE_COLUMNS) -> None:
    found = sorted(set(cols) & set(excluded))
    if found:
        raise ValueError(f"Excluded columns among the features: {found}")
