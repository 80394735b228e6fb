import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from precinct.functions.scalars import fold_of
from precinct.operators import features
from precinct.operators.splits import with_split


def test_temporal_and_cyclic(tiny):
    row = features.add_cyclic(features.add_temporal(tiny)).filter("unique_key = 9").first()
    assert (row["hour"], row["month"], row["day_of_week"], row["is_weekend"]) == (18, 6, 6, 1)
    assert row["hour_sin"] == pytest.approx(-1) and row["month_cos"] == pytest.approx(math.cos(2 * math.pi * 5 / 12))


def test_quadrants(tiny):
    got = {r["unique_key"]: r["area_group"] for r in features.add_area_group(tiny, 41.85, -87.65).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[6]) == (
        "North-West", "North-East", "South-West", "South-East", "Unknown", "Unknown")
    assert got[10] == "North-East"  # on both thresholds


@pytest.mark.parametrize("preset, ward, place", [("indexed", -1, "Unknown"), ("text", "Unknown", "UNKNOWN"), ("interim", 0, "OTHER")])
def test_missing_presets(tiny, preset, ward, place):
    rows = {r["unique_key"]: r for r in features.handle_missing(tiny, (1.0, 2.0), preset=preset).collect()}
    assert rows[5]["ward"] == ward and rows[4]["location_description"] == place
    assert (rows[5]["latitude"], rows[5]["longitude"], rows[5]["coordinates_missing"]) == (1.0, 2.0, 1)
    assert rows[6]["coordinates_missing"] == 1


def test_leakage_columns_are_dropped(tiny):
    assert {"case_number", "arrest"}.isdisjoint(features.drop_leakage(tiny).columns)


def test_normalised_rows(tiny):
    rows = {r["unique_key"]: r for r in features.normalise_raw(tiny).collect()}
    assert rows[3]["location_description"] == "STREET" and rows[4]["location_description"] == "UNKNOWN"
    assert (rows[5]["ward"], rows[5]["ward_num"], rows[5]["domestic_int"]) == ("Unknown", None, 0)


def test_reporting_flags(tiny):
    row = features.add_reporting_flags(tiny).filter("unique_key = 1").first()
    assert (row["is_midnight"], row["on_the_hour"], row["first_of_month"], row["minute"], row["day"]) == (1, 1, 1, 0, 1)
    assert features.on_the_hour_share(tiny).first()[0] == pytest.approx(7 / 12)


def test_frequencies_of_unseen_values_are_zero(tiny):
    rows = features.normalise_raw(tiny)
    train = rows.filter("unique_key <= 4")
    got = {r["unique_key"]: r["beat_freq"] for r in features.frequency_encode(train, rows, ["beat"]).collect()}
    assert got[1] == 0.5 and got[7] == 0.0


def brute_force(rows, key, own=None, alpha=20):
    """Smoothed share per class of the training rows with this key, leaving rows of fold ``own`` out."""
    prior = Counter(r["primary_type"] for r in rows)
    kept = [r for r in rows if r["key"] == key and r["fold"] != own]
    mine = Counter(r["primary_type"] for r in kept)
    return {c: (mine[c] + alpha * prior[c] / len(rows)) / (len(kept) + alpha) for c in prior}


@pytest.fixture(scope="module")
def mixed(tiny):
    rows = features.normalise_raw(with_split(tiny, "2025-06-01", "2025-07-01"))
    train = rows.filter("split = 'train'")
    keys = {"loc": F.col("location_description"), "locdist": features.mix_keys()["locdist"]}
    mix = features.fit_mix(train, keys, folds=3)
    plain = [r.asDict() for r in rows.select("unique_key", "primary_type", "split", F.col("location_description").alias("key"),
                                              fold_of(F.col("unique_key"), 3).alias("fold")).collect()]
    return rows, mix, keys, plain


def test_mix_equals_brute_force_in_and_out_of_training(mixed):
    rows, mix, keys, plain = mixed
    train = [r for r in plain if r["split"] == "train"]
    got = {r["unique_key"]: r for r in features.add_mix_features(rows, mix, F.col("split") == "train", keys=keys).collect()}
    for r in plain:
        want = brute_force(train, r["key"], r["fold"] if r["split"] == "train" else None)
        for c, v in want.items():
            assert got[r["unique_key"]][f"mix_loc_{c}"] == pytest.approx(v)


def test_mix_of_a_row_ignores_its_own_label(mixed, tiny):
    rows, mix, keys, _ = mixed
    changed = rows.withColumn("primary_type", F.when(F.col("unique_key") == 1, "BATTERY").otherwise(F.col("primary_type")))
    other = features.fit_mix(changed.filter("split = 'train'"), keys, folds=3)
    raw = lambda m: features.attach_mix(rows.filter("unique_key = 1"), m, keys, features.training_fold(m, F.lit(True))) \
        .select([features.mix_column("loc", i) for i in range(len(m.classes))]).first()
    # Only the prior may differ, because it is the share over all of training.
    before = dict(zip(mix.classes, raw(mix)))
    after = dict(zip(other.classes, raw(other)))
    prior_a, prior_b = dict(zip(mix.classes, mix.prior)), dict(zip(other.classes, other.prior))
    n = [before[c] - after[c] for c in before]
    shift = [(prior_a[c] - prior_b[c]) for c in before]
    ratios = {round(a / b, 9) for a, b in zip(n, shift) if abs(b) > 1e-12}
    assert len(ratios) == 1  # all differences are alpha / (n + alpha) times the change of the prior


def test_unseen_key_gets_the_prior_without_broadcast_too(spark, mixed):
    rows, mix, keys, _ = mixed
    odd = rows.limit(1).withColumn("location_description", F.lit("NOWHERE"))
    for sizes in (mix.sizes, {t: 10**9 for t in mix.tags}):
        other = features.MixTables(mix.table, mix.classes, mix.prior, mix.tags, mix.folds, sizes)
        row = features.attach_mix(odd, other, keys, F.lit(-1)).first()
        assert [row[features.mix_column("loc", i)] for i in range(len(mix.classes))] == pytest.approx(mix.prior)


def test_midnight_share(tiny):
    rows = features.midnight_share(tiny, k=2).collect()
    assert [(r[0], r[1]) for r in rows] == [("ROBBERY", 1.0), ("THEFT", pytest.approx(1 / 6))]


def test_classes_with_a_common_beginning_keep_their_columns(spark):
    rows = spark.createDataFrame([(i, "NON-CRIMINAL" + (" (SUBJECT SPECIFIED)" if i % 3 else ""), "HOME") for i in range(30)],
                                 "unique_key long, primary_type string, location_description string")
    mix = features.fit_mix(rows, {"loc": F.col("location_description")})
    made = features.add_mix_features(rows, mix, None, keys={"loc": F.col("location_description")})
    columns = [c for c in made.columns if c.startswith("mix_loc_")]
    assert len(set(columns)) == 2 and made.select(*columns).count() == 30
