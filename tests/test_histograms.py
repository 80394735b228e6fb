import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from precinct.operators import boosting, export, histograms, models, trees
from precinct.plans import model_queries

ATTRS = {"ml_attr": {"attrs": {"numeric": [{"idx": 0, "name": "a"}, {"idx": 1, "name": "b"}], "nominal": [{"idx": 2, "name": "c", "vals": ["u", "v", "w", "x"]}],
                               "binary": [{"idx": i, "name": f"d_{i}"} for i in (3, 4, 5)]}, "num_attrs": 6}}


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes decided by numbers, levels and 0/1 entries; vectors are sparse and dense, the last rows are held back."""
    draw = random.Random(5)
    made = []
    for i in range(600):
        a, b, c, d = draw.gauss(0, 3), draw.randrange(6), draw.randrange(4), draw.randrange(4)
        label = (a > 1) + (c in (0, 3) and d == 2) if draw.random() < 0.8 else draw.randrange(3)
        values = [a, float(b), float(c), *[float(d == j) for j in range(3)]]
        vector = Vectors.dense(values) if i % 2 else Vectors.sparse(6, [(j, v) for j, v in enumerate(values) if v])
        made.append((i, float(label), 1.0 + i % 3, vector))
    df = spark.createDataFrame(made, ["i", "label", "w", "features"]).withMetadata("features", ATTRS).cache()
    return df.filter("i < 450"), df.filter("i >= 450")


def fitted(rows, rounds=4, **settings):
    return models.fit_boosted(rows[0], ["p", "q", "r"], rounds=rounds, max_depth=3, validation=rows[1], patience=99, **settings)


@pytest.mark.parametrize("weight", [None, "w"])
def test_rounds_equal_those_of_spark_ml_trees(rows, weight):
    """On all rows and features every tree is that of a Spark ML fit (numbers have few values: Spark ML cuts them by weights otherwise)."""
    few = [r.withColumn("features", F.col("features")) for r in rows]
    plain = boosting.boost(few[0], 3, rounds=3, max_depth=3, rate=0.1, min_leaf=5, validation=few[1], weight=weight, max_bins=1000)
    mine = fitted(few, rounds=3, min_leaf=5, subsample=1.0, columns="all", weight=weight, max_bins=1000).facts["losses"]
    assert [a for a, _ in mine] == pytest.approx([a for a, _ in plain.losses], abs=1e-9)
    assert [b for _, b in mine] == pytest.approx([b for _, b in plain.losses], abs=1e-9)


def test_blocks_over_tasks_grow_the_trees_of_one_task(rows, spark):
    """Rows are drawn by their numbers and features by the node, so it does not matter where a tree grows."""
    one, other = fitted(rows), fitted((rows[0].repartition(1).sortWithinPartitions("i"), rows[1]), whole_bytes=0, store_every=2)
    again = fitted((rows[0].repartition(1).sortWithinPartitions("i"), rows[1]))
    assert np.array(again.facts["losses"]) == pytest.approx(np.array(other.facts["losses"]), abs=1e-9)
    assert [m.totalNumNodes for m in again.models] == [m.totalNumNodes for m in other.models]
    assert one.facts["losses"][-1][0] < one.facts["losses"][0][0]


def test_a_round_is_one_job(rows, spark):
    """Each tree was a fit of some ten jobs of its own."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs

    def taken(rounds):
        before = jobs()
        fitted(rows, rounds=rounds)
        return jobs() - before

    assert taken(9) - taken(4) <= 5


def test_exported_models_hold_levels_flags_and_numbers(rows, spark):
    """Losses that the loop carried are those of the loaded Spark ML models, and the nodes tell all kinds of splits."""
    model = fitted(rows, rounds=6)
    for part, place in zip(rows, (0, 1)):
        loss = model.margins(part).agg(F.avg(boosting.log_loss(F.col("margins"), F.col("label")))).first()[0]
        assert loss == pytest.approx(model.facts["losses"][model.facts["best_round"] - 1][place], abs=1e-9)
    nodes = export.node_table(model, spark).filter("left >= 0").collect()
    assert {r["feature"] for r in nodes} >= {0, 2, 5}
    assert all((r["categories"] is None) == (r["feature"] < 2) for r in nodes)
    assert all(r["gain"] > 0 and r["mass"] > 0 for r in nodes)


def test_model_makes_no_python_model_of_each_tree(rows, tmp_path):
    """Listing the settings of a loaded model took some ten milliseconds a tree."""
    model = fitted(rows, rounds=2).models[0]
    model.save(str(tmp_path / "m"))
    again = histograms.BoostedModel.load(str(tmp_path / "m"))
    assert "trees" not in vars(model) and "trees" not in vars(again)
    assert len(again.trees) == 2 and again.trees[1].numNodes == model.trees[1].numNodes and again.treeWeights == [0.1, 0.1]


def test_labels_that_are_no_class_count_as_other(rows):
    """Rows without a class may come with a label of their own, or none: no tree pulls towards it, and they have no loss."""
    odd = [r.withColumn("label", F.when(F.col("i") % 50 == 7, 3.0).otherwise(F.col("label"))) for r in rows]
    held = odd[1].withColumn("label", F.when(F.col("i") % 50 != 9, F.col("label")))
    plain = boosting.boost(odd[0], 3, rounds=2, max_depth=2, rate=0.1, validation=held, max_bins=1000)
    mine = models.fit_boosted(odd[0], ["p", "q", "r"], rounds=2, max_depth=2, subsample=1.0, columns="all", validation=held, max_bins=1000)
    assert np.array(mine.facts["losses"]) == pytest.approx(np.array(plain.losses), abs=1e-9)


def test_a_level_beyond_the_known_ones_is_an_error(rows):
    wrong = rows[0].sparkSession.createDataFrame([(0.0, Vectors.dense([0.0, 0.0, 7.0, 0.0, 0.0, 0.0]))], ["label", "features"]).withMetadata("features", ATTRS)
    layout = histograms.layout_of(rows[0], 32)
    with pytest.raises(Exception, match="beyond its 4 levels"):
        histograms.binned(wrong.withColumns({"mass": F.lit(1.0), "training": F.lit(True)}), layout)


def test_thresholds_and_counts():
    assert trees.thresholds(np.array([0.0, 1.0, 4.0]), np.ones(3), 5).tolist() == [0.5, 2.5]
    values, counts = trees.counted_values(np.arange(5000.0) % 4000, np.ones(5000))
    assert counts.sum() == 5000 and len(values) <= trees.POINTS and values[-1] == 3999
    cuts = trees.thresholds(np.arange(100.0), np.ones(100), 3)
    assert len(cuts) == 3 and abs(np.diff([0, *cuts, 100]) - 25).max() <= 1.5


def test_registered_boosters_run_all_their_rounds(spark, monkeypatch):
    """The previous booster was registered with 40 of its 100 rounds, the final one with at most 40 of 2000."""
    asked = []

    class Asked(Exception):
        pass

    def fit(train, classes, **settings):
        asked.append((settings["rounds"], settings["patience"], settings["max_depth"]))
        raise Asked

    monkeypatch.setattr(boosting, "fit", fit)
    monkeypatch.setattr(model_queries, "_FITS", {})
    for build in (model_queries.boosted_fit, model_queries.final_model):
        with pytest.raises(Asked):
            build(spark, "/root/testdata/sf0.001")
    assert asked == [(100, 50, 5), (2000, 50, 7)]
