import pytest
from pyspark.sql import functions as F

from precinct.operators import features, models, scoring
from precinct.operators.quality import keep_known
from precinct.operators.splits import time_split
from precinct.plans.scoring_queries import _resolved, expanded_requests
from precinct.sources.testviews import TRAIN_END, VALIDATION_END, incidents
from conftest import SF


@pytest.fixture(scope="module")
def parts(spark):
    return [p.cache() for p in time_split(incidents(spark, SF), TRAIN_END, VALIDATION_END)]


@pytest.fixture(scope="module")
def saved(spark, parts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("final") / "model")
    fitted = models.fit_final_model(parts[0], parts[1], rounds=2, max_depth=2, patience=5)
    fitted.save(path)
    return fitted, models.FinalModel.load(spark, path)


def test_a_saved_model_scores_raw_rows_alike(parts, saved):
    one, other = (m.transform(parts[2]).select("unique_key", "predicted", "probability") for m in saved)
    assert one.exceptAll(other).isEmpty() and other.count() == parts[2].count()
    assert saved[1].fitted.facts == saved[0].fitted.facts


def test_the_saved_model_knows_what_requests_need(spark, parts, saved):
    """Known locations and the share of full hours come from the saved state, not from training rows."""
    train = parts[0]
    want = {r[0] for r in features.normalise_raw(train).select("location_description").distinct().collect()}
    assert {r[0] for r in saved[1].known("location_description").collect()} == want
    assert saved[1].on_hour == train.agg(F.avg((F.minute("date") == 0).cast("double"))).first()[0]
    rows = scoring.expand_requests(keep_known(_resolved(spark, SF), saved[1].known("location_description"), "location_description"), F.lit(saved[1].on_hour))
    key = lambda df: {(r["request_id"], r["date"], round(r["weight"], 12)) for r in df.select("request_id", "date", "weight").collect()}
    assert key(rows) == key(expanded_requests(spark, SF))


def test_distinct_scoring_equals_scoring_every_row(spark, saved):
    rows = expanded_requests(spark, SF).filter("request_id % 5 = 0")
    classes = saved[1].fitted.classes
    plain, once = ({r["request_id"]: r["probability"] for r in scoring.average_probabilities(f(rows, saved[1]), classes).collect()} for f in (scoring.score, scoring.score_distinct))
    assert plain.keys() == once.keys() and all(once[i] == pytest.approx(plain[i], abs=1e-12) for i in plain)
