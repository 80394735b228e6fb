from functools import reduce

import pytest
from pyspark.sql import functions as F

from precinct.operators import scoring
from precinct.schema import area_dimension
from test_quality import GOOD, frame
from precinct.operators.quality import validate_requests

CLASSES = ["ASSAULT", "OTHER OFFENSE", "THEFT"]


def resolved(spark, **change):
    return scoring.resolve_requests(validate_requests(frame(spark, {**GOOD, **change}))[0], area_dimension(spark))


def test_defaults_come_from_the_area(spark):
    row = resolved(spark).first()
    assert (row["district"], row["latitude"], row["longitude"]) == (7, 41.7753, -87.6416)
    assert str(row["date"]) == "2026-07-04 23:00:00"
    assert resolved(spark, district=3, latitude=41.9).first()["district"] == 3


def test_weights_of_a_request_sum_to_one(spark):
    for month, dates in ((7, 4), (8, 5)):
        rows = scoring.expand_requests(resolved(spark, month=month), F.lit(0.4)).collect()
        assert len(rows) == dates * 6 and sum(r["weight"] for r in rows) == pytest.approx(1)
        assert {r["date"].minute for r in rows} == {0, 10, 20, 30, 40, 50} and {r["date"].hour for r in rows} == {23}
        assert sum(r["weight"] for r in rows if r["date"].minute == 0) == pytest.approx(0.4)


def answer(spark, first, second):
    rows = scoring.expand_requests(resolved(spark), F.lit(0.4))
    p = F.when(F.minute("date") == 0, F.array(*[F.lit(x) for x in first])).otherwise(F.array(*[F.lit(x) for x in second]))
    averaged = scoring.average_probabilities(rows.withColumn("probability", p), CLASSES, keep=scoring.RESOLVED)
    return scoring.summarise(averaged, CLASSES)


def test_average_summary_and_advice(spark):
    summary = answer(spark, (1.0, 0.0, 0.0), (0.2, 0.3, 0.5))
    row = summary.first()
    assert (row["predicted"], row["confidence"], row["severity"]) == ("ASSAULT", 0.52, "High")
    assert [t["probability"] for t in row["top"]] == [0.52, 0.3, 0.18]
    lines = scoring.recommend(summary).first()["recommendations"]
    assert len(lines) == 3 and "Englewood: Assault (52%)" in lines[0] and "23:00" in lines[1]


def test_low_confidence_adds_a_line(spark):
    lines = scoring.recommend(answer(spark, (0.3, 0.35, 0.35), (0.3, 0.36, 0.34))).first()["recommendations"]
    assert len(lines) == 3 and "Theft, Assault" in lines[2]


def test_scoring_is_deterministic(spark):
    assert answer(spark, (0.5, 0.2, 0.3), (0.2, 0.3, 0.5)).first() == answer(spark, (0.5, 0.2, 0.3), (0.2, 0.3, 0.5)).first()


def test_interim_inputs(spark):
    row = scoring.interim_features(resolved(spark)).first()
    assert (row["ward"], row["beat"], row["is_weekend"]) == (0, 711, 1)


def test_two_requests_with_one_id_are_an_error(spark):
    rows = scoring.expand_requests(resolved(spark).unionAll(resolved(spark)), F.lit(0.4)).withColumn("probability", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    with pytest.raises(Exception, match="request_id is not unique"):
        scoring.average_probabilities(rows, CLASSES).collect()


def test_times_in_words(spark):
    row = answer(spark, (1.0, 0.0, 0.0), (1.0, 0.0, 0.0)).first()
    assert row["averaged_over"].startswith("every Saturday in July 2026 at 23:00-23:59") and row["model_name"] == "final" and row["area"].endswith(")")


class Sums:
    """A model that looks at every input and counts the rows it is shown."""

    def __init__(self):
        self.shown = 0

    def transform(self, df):
        self.shown = df.count()
        mark = F.xxhash64(F.hour("date"), F.minute("date"), F.dayofmonth("date"), F.month("date"), F.weekday("date"), *scoring.SCORED_ON) % 100 / 100
        return df.withColumn("probability", F.array(mark, 1 - mark))


def test_distinct_inputs_are_scored_once(spark):
    requests = [{**GOOD, "requestId": i, "request_id": i, "month": 7 if i % 3 else 8, "ward": None if i % 2 else 4} for i in range(12)]
    parts = [resolved(spark, month=r["month"], ward=r["ward"]).withColumn("request_id", F.lit(r["request_id"])) for r in requests]
    rows = scoring.expand_requests(reduce(lambda a, b: a.unionByName(b), parts), F.lit(0.4))
    plain, once = Sums(), Sums()
    key = lambda df: sorted((r["request_id"], [round(p, 9) for p in r["probability"]]) for r in scoring.average_probabilities(df, ["A", "B"]).collect())
    assert key(scoring.score(rows, plain)) == key(scoring.score_distinct(rows, once))
    assert plain.shown == rows.count() and once.shown == 2 * (4 + 5) * 6  # two wards, four dates in July and five in August
