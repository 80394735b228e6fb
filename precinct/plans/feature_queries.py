"""Feature engineering, splits, labels, historical mix and evaluation of the mix predictor."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.functions.scalars import fold_of
from precinct.operators import evaluation, features, relational as rel, selection
from precinct.operators.splits import split_coverage, stratified_split as stratified, time_split, with_split
from precinct.plans.common import CLASSES, SPLIT, over, query, r6, union_sql
from precinct.plans.quality_queries import AREA_GROUP, MEDIANS
from precinct.session import settle
from precinct.sources.testviews import TRAIN_END, VALIDATION_END, incidents

TR = f"SELECT * FROM inc WHERE date < TIMESTAMP '{TRAIN_END}'"


def _parts(spark, folder):
    return time_split(incidents(spark, folder), TRAIN_END, VALIDATION_END)


def _train(spark, folder) -> DataFrame:
    return _parts(spark, folder)[0]

# ---------------------------------------------------------------- row features


@query("temporal_features", over(
    "SELECT unique_key, CAST(hour(date) AS INT) AS hour, CAST(month(date) AS INT) AS month, "
    "CAST(isodow(date) - 1 AS INT) AS day_of_week, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM inc"))
def temporal_features(spark, folder):
    return features.add_temporal(incidents(spark, folder)).select(
        "unique_key", "hour", "month", "day_of_week", "is_weekend")


def _angle(expression: str, period: int) -> str:
    return f"{expression} * CAST({2 * math.pi!r} AS DOUBLE) / {period}"


CYCLES = (("hour", "hour(date)", 24), ("day_of_week", "(isodow(date) - 1)", 7), ("month", "(month(date) - 1)", 12))


@query("cyclic_features", over("SELECT unique_key, " + ", ".join(
    f"{r6(f'{fn}({_angle(e, p)})')} AS {n}_{fn}" for n, e, p in CYCLES for fn in ("sin", "cos")) + " FROM inc"))
def cyclic_features(spark, folder):
    made = features.add_cyclic(features.add_temporal(incidents(spark, folder)))
    return made.select("unique_key", *[f"{n}_{fn}" for n, _, _ in CYCLES for fn in ("sin", "cos")])


@query("area_group", over(f"SELECT unique_key, {AREA_GROUP} AS area_group FROM inc, m", m=MEDIANS))
def area_group(spark, folder):
    medians = features.fit_medians(_train(spark, folder))
    return features.add_area_group(incidents(spark, folder), *medians).select("unique_key", "area_group")


@query("reporting_flags", over(
    "SELECT unique_key, CAST(minute(date) AS INT) AS minute, CAST(day(date) AS INT) AS day, "
    "CASE WHEN hour(date) = 0 AND minute(date) = 0 THEN 1 ELSE 0 END AS is_midnight, "
    "CASE WHEN minute(date) = 0 THEN 1 ELSE 0 END AS on_the_hour, CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS first_of_month, "
    f"{r6('latitude + longitude')} AS rot45_a, {r6('latitude - longitude')} AS rot45_b FROM inc"))
def reporting_flags(spark, folder):
    made = features.add_rotation(features.add_reporting_flags(incidents(spark, folder)))
    return made.select("unique_key", "minute", "day", "is_midnight", "on_the_hour", "first_of_month", "rot45_a", "rot45_b")


NORM = """SELECT unique_key, date, primary_type, upper(trim(coalesce(location_description, 'Unknown'))) AS location_description,
  CASE WHEN domestic THEN 1 ELSE 0 END AS domestic_int, latitude, longitude, split,
  coalesce(CAST(beat AS VARCHAR), 'Unknown') AS beat, coalesce(CAST(district AS VARCHAR), 'Unknown') AS district,
  coalesce(CAST(ward AS VARCHAR), 'Unknown') AS ward, coalesce(CAST(community_area AS VARCHAR), 'Unknown') AS community_area,
  CAST(beat AS DOUBLE) AS beat_num, CAST(ward AS DOUBLE) AS ward_num,
  ('0x' || substr(md5(CAST(unique_key AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold FROM sp"""


@query("normalise_codes", over(
    "SELECT unique_key, location_description, domestic_int, beat, district, ward, community_area, beat_num, ward_num FROM norm",
    sp=SPLIT, norm=NORM))
def normalise_codes(spark, folder):
    return features.normalise_raw(incidents(spark, folder)).select(
        "unique_key", "location_description", "domestic_int", "beat", "district", "ward", "community_area", "beat_num",
        "ward_num")

# ------------------------------------------------------------ splits and labels


@query("time_split_coverage", over(
    'SELECT split, count(*) AS "rows", min(date) AS "start", max(date) AS "end", '
    "count(CASE WHEN primary_type NOT IN (SELECT primary_type FROM sp WHERE split = 'train') THEN 1 END) AS unseen_targets "
    "FROM sp GROUP BY 1", sp=SPLIT))
def time_split_coverage(spark, folder):
    return split_coverage(with_split(incidents(spark, folder), TRAIN_END, VALIDATION_END))


@query("stratified_split", over(
    "SELECT unique_key, primary_type, CASE WHEN row_number() OVER (PARTITION BY primary_type ORDER BY h, unique_key) "
    "<= round(0.2 * (count(*) OVER (PARTITION BY primary_type))) THEN 'test' ELSE 'train' END AS part FROM h",
    h="SELECT unique_key, primary_type, ('0x' || substr(md5(CAST(unique_key AS VARCHAR)), 1, 8))::BIGINT AS h FROM inc"))
def stratified_split(spark, folder):
    return stratified(incidents(spark, folder).select("unique_key", "primary_type"), "primary_type")


@query("label_by_frequency", over(
    "SELECT primary_type, CAST(row_number() OVER (ORDER BY count(*) DESC, primary_type) - 1 AS DOUBLE) AS label FROM tr GROUP BY 1", tr=TR))
def label_by_frequency(spark, folder):
    return rel.label_by_frequency(_train(spark, folder), "primary_type")


@query("label_by_name", over(
    "SELECT unique_key, coalesce(label, -1) + CAST(0 AS DOUBLE) AS label FROM inc LEFT JOIN l USING (primary_type)",
    tr=TR, l="SELECT primary_type, CAST(row_number() OVER (ORDER BY primary_type) - 1 AS DOUBLE) AS label "
             "FROM (SELECT DISTINCT primary_type FROM tr WHERE primary_type <> 'RARE')"))
def label_by_name(spark, folder):
    train = _train(spark, folder).filter(F.col("primary_type") != "RARE")
    labels = rel.label_by_name(train, "primary_type")
    return rel.apply_labels(incidents(spark, folder), labels, "primary_type").select("unique_key", "label")


@query("class_weights", over(
    'SELECT primary_type, count(*) AS "count", '
    f"{r6('(SELECT count(*) FROM tr) / ((SELECT count(DISTINCT primary_type) FROM tr) * count(*))')} AS weight FROM tr GROUP BY 1", tr=TR))
def class_weights(spark, folder):
    return rel.class_weights(_train(spark, folder), "primary_type")

# ---------------------------------------------------------- fitted encodings


@query("frequency_encoding", over(
    "SELECT unique_key, " + ", ".join(f"{r6(f'coalesce({c}_f, 0)')} AS {c}_freq" for c in ("location_description", "beat"))
    + " FROM norm LEFT JOIN fl USING (location_description) LEFT JOIN fb USING (beat)", sp=SPLIT, norm=NORM,
    fl="SELECT location_description, count(*) / (SELECT count(*) FROM norm WHERE split = 'train') AS location_description_f "
       "FROM norm WHERE split = 'train' GROUP BY 1",
    fb="SELECT beat, count(*) / (SELECT count(*) FROM norm WHERE split = 'train') AS beat_f FROM norm WHERE split = 'train' GROUP BY 1"))
def frequency_encoding(spark, folder):
    cols = ["location_description", "beat"]
    rows = features.normalise_raw(incidents(spark, folder))
    train = features.normalise_raw(_train(spark, folder))
    return features.frequency_encode(train, rows, cols).select("unique_key", *[f"{c}_freq" for c in cols])


@query("class_prior", over(
    f'SELECT primary_type, count(*) AS "count", {r6("count(*) / (SELECT count(*) FROM tr)")} AS share, '
    "CAST(row_number() OVER (ORDER BY count(*) DESC, primary_type) AS INT) AS rank FROM tr GROUP BY 1", tr=TR))
def class_prior(spark, folder):
    return rel.class_prior(_train(spark, folder), "primary_type")


@query("midnight_share", over(
    f"SELECT primary_type, {r6('avg(CASE WHEN hour(date) = 0 AND minute(date) = 0 THEN 1 ELSE 0 END)')} AS midnight_share "
    "FROM tr GROUP BY 1", tr=TR))
def midnight_share(spark, folder):
    return features.midnight_share(_train(spark, folder))


@query("on_the_hour_share", over(
    f"SELECT {r6('avg(CASE WHEN minute(date) = 0 THEN 1 ELSE 0 END)')} AS on_the_hour_share FROM tr", tr=TR))
def on_the_hour_share(spark, folder):
    return features.on_the_hour_share(_train(spark, folder))


GRID_KEY = ("coalesce(CAST(CAST(floor(round(latitude * 1000) / 5) AS BIGINT) AS VARCHAR) || '_' || "
            "CAST(CAST(floor(round(longitude * 1000) / 6) AS BIGINT) AS VARCHAR), 'Unknown')")
KEYS = {"loc": "location_description", "beat": "beat", "locdist": "location_description || '|' || district",
        "lochr": "location_description || '|' || CAST(CAST(floor(hour(date) / 6) AS INT) AS VARCHAR)",
        "domloc": "CAST(domestic_int AS VARCHAR) || '|' || location_description", "grid": GRID_KEY}
REPORT_KEYS = {"loc": KEYS["loc"], "lochr": KEYS["lochr"],
               "locrep": "location_description || '|' || CASE WHEN minute(date) = 0 THEN '1' ELSE '0' END || '|' || "
                         "CASE WHEN day(date) = 1 THEN '1' ELSE '0' END"}


def pairs_sql(keys: dict[str, str], source: str = "norm", extra: str = "unique_key, primary_type, split, fold") -> str:
    return union_sql(f"SELECT {extra}, '{t}' AS tag, {k} AS mix_key FROM {source}" for t, k in keys.items())


def _sums(letter: str) -> str:
    return ", ".join(f"count(*) FILTER (primary_type = '{c}') AS {letter}{i}" for i, c in enumerate(CLASSES))


PRIOR = "SELECT " + ", ".join(
    f"count(*) FILTER (primary_type = '{c}') / count(*) AS p{i}" for i, c in enumerate(CLASSES)) + " FROM tr"
TOT = f"SELECT tag, mix_key, count(*) AS n, {_sums('s')} FROM pairs WHERE split = 'train' GROUP BY 1, 2"
OWN = f"SELECT tag, mix_key, fold, count(*) AS m, {_sums('o')} FROM pairs WHERE split = 'train' GROUP BY 1, 2, 3"


def _value(i: int) -> str:
    return (f"((coalesce(s{i}, 0) - coalesce(o{i}, 0)) + CAST(20 AS DOUBLE) * p{i}) / "
            "((coalesce(n, 0) - coalesce(m, 0)) + CAST(20 AS DOUBLE))")


VALUES = ("SELECT unique_key, tag, " + ", ".join(f"{_value(i)} AS v{i}" for i in range(len(CLASSES)))
          + " FROM pairs LEFT JOIN tot USING (tag, mix_key) LEFT JOIN own ON own.tag = pairs.tag AND own.mix_key = pairs.mix_key "
            "AND own.fold = pairs.fold AND pairs.split = 'train', prior")


def mix_steps(keys: dict[str, str]) -> dict[str, str]:
    return dict(tr=TR, sp=SPLIT, norm=NORM, pairs=pairs_sql(keys), prior=PRIOR, tot=TOT, own=OWN, vals=VALUES)


def _mix(spark, folder, keys=None, top=features.TOP_CLASSES):
    train = features.normalise_raw(time_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END)[0])
    return features.fit_mix(train, keys or features.mix_keys(), top=top)


@query("smoothed_mix", over(
    "SELECT mix_key, n, " + ", ".join(
        f"{r6(f'(s{i} + CAST(20 AS DOUBLE) * p{i}) / (n + CAST(20 AS DOUBLE))')} AS \"mix_{c}\"" for i, c in enumerate(CLASSES))
    + " FROM tot, prior WHERE tag = 'domloc'", **mix_steps(KEYS)))
def smoothed_mix(spark, folder):
    return features.smoothed_mix(_mix(spark, folder), "domloc")


@query("oof_mix_location", over(
    "SELECT own.mix_key, CAST(own.fold AS INT) AS fold, n - m AS n, " + ", ".join(
        f"{r6(f'((s{i} - o{i}) + CAST(20 AS DOUBLE) * p{i}) / ((n - m) + CAST(20 AS DOUBLE))')} AS \"mix_{c}\""
        for i, c in enumerate(CLASSES))
    + " FROM own JOIN tot USING (tag, mix_key), prior WHERE tag = 'loc'", **mix_steps(KEYS)))
def oof_mix_location(spark, folder):
    return features.out_of_fold_mix(_mix(spark, folder), "loc")


@query("mix_features_all", over(
    "SELECT unique_key, " + ", ".join(
        f"{r6(f'''max(CASE WHEN tag = '{t}' THEN v{i} END)''')} AS \"mix_{t}_{c}\""
        for t in KEYS for i, c in enumerate(CLASSES)) + " FROM vals GROUP BY 1", **mix_steps(KEYS)))
def mix_features_all(spark, folder):
    mix = _mix(spark, folder)
    rows = features.normalise_raw(with_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END))
    made = features.add_mix_features(rows, mix, F.col("split") == "train")
    return made.select("unique_key", *[f"mix_{t}_{c}" for t in mix.tags for c in mix.classes])

# ------------------------------------------- evaluation of the mix predictor


def vote_sql(keys, where="split <> 'train'") -> dict[str, str]:
    """Steps ending in ``pred``: unique_key, actual, predicted, split and q0..q5."""
    tags = list(keys)
    mean = [("(" + " + ".join(f"max(CASE WHEN tag = '{t}' THEN v{i} END)" for t in tags) + f") / {len(tags)}")
            for i in range(len(CLASSES))]
    best = "greatest(" + ", ".join(f"q{i}" for i in range(len(CLASSES))) + ")"
    chosen = "CASE " + " ".join(f"WHEN q{i} = {best} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    steps = mix_steps(keys)
    steps["qs"] = "SELECT unique_key, " + ", ".join(f"{m} AS q{i}" for i, m in enumerate(mean)) + " FROM vals GROUP BY 1"
    steps["pred"] = (f"SELECT qs.*, primary_type AS actual, split, {chosen} AS predicted FROM qs JOIN sp USING (unique_key) "
                     f"WHERE {where}")
    return steps


def predictions(spark, folder, keys=None, split: str | None = None):
    """Mix predictor over the holdout rows (classes by name)."""
    keys = keys or features.mix_keys()
    mix = _mix(spark, folder, keys, top=None)
    rows = features.normalise_raw(with_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END))
    rows = rows.filter(F.col("split") == split if split else F.col("split") != "train")
    return features.mix_vote(rows, mix, keys, F.lit(-1)).withColumnRenamed("primary_type", "actual"), mix.classes


VOTE = vote_sql(KEYS)
VOTE_TEST = vote_sql(KEYS, "split = 'test'")
CONF = "SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2"
AXIS = ("SELECT a AS actual, p AS predicted, coalesce(n, 0) AS n FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES)
        + "]) AS a) CROSS JOIN (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES)
        + "]) AS p) LEFT JOIN conf ON a = actual AND p = predicted")
PER = """SELECT class, sum(support) AS support, sum(guessed) AS guessed, sum(hits) AS hits FROM (
  SELECT actual AS class, n AS support, 0 AS guessed, CASE WHEN actual = predicted THEN n ELSE 0 END AS hits FROM axis
  UNION ALL SELECT predicted, 0, n, 0 FROM axis) GROUP BY 1"""
PER_RATES = """SELECT class, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  CASE WHEN support + guessed > 0 THEN 2 * hits / (support + guessed) ELSE 0 END AS f1, support, hits FROM per"""
EVAL = dict(VOTE_TEST, conf=CONF, axis=AXIS, per=PER, rates=PER_RATES)


@query("baseline_predictions", over(
    "SELECT unique_key, split, actual, predicted, " + ", ".join(f"{r6(f'q{i}')} AS p{i}" for i in range(len(CLASSES)))
    + " FROM pred", **VOTE))
def baseline_predictions(spark, folder):
    pred, classes = predictions(spark, folder)
    return pred.select("unique_key", "split", "actual", "predicted",
                       *[F.col("probability")[i].alias(f"p{i}") for i in range(len(classes))])


def _test_confusion(spark, folder):
    pred, classes = predictions(spark, folder, split="test")
    return evaluation.confusion(pred, classes)


@query("confusion", over("SELECT * FROM axis", **EVAL))
def confusion(spark, folder):
    return _test_confusion(spark, folder)


@query("confusion_normalised", over(
    f"SELECT actual, predicted, n, {r6('n / greatest(sum(n) OVER (PARTITION BY actual), 1)')} AS share FROM axis", **EVAL))
def confusion_normalised(spark, folder):
    return evaluation.normalise_rows(_test_confusion(spark, folder))


@query("per_class_metrics", over(
    f"SELECT class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support "
    "FROM rates", **EVAL))
def per_class_metrics(spark, folder):
    return evaluation.per_class(_test_confusion(spark, folder))


OVERALL = (f"SELECT {r6('sum(hits) / sum(support)')} AS accuracy, {r6('avg(precision)')} AS macro_precision, "
           f"{r6('avg(recall)')} AS macro_recall, {r6('avg(f1)')} AS macro_f1, {r6('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM rates")


@query("overall_metrics", over(OVERALL, **EVAL))
def overall_metrics(spark, folder):
    return evaluation.overall(_test_confusion(spark, folder))


def unseen_sql(include: bool) -> str:
    """The same metrics with class RARE unknown to the evaluation."""
    known = [c for c in CLASSES if c != "RARE"]
    names = ", ".join(f"'{c}'" for c in known)
    conf = (f"SELECT CASE WHEN actual IN ({names}) THEN actual ELSE 'UNSEEN_IN_TRAINING' END AS actual, predicted, count(*) AS n "
            "FROM pred GROUP BY 1, 2")
    keep = "" if include else "WHERE class <> 'UNSEEN_IN_TRAINING'"
    scores = (f"SELECT avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(f1 * support) / sum(support) AS wf FROM rates {keep}")
    return over(f"SELECT {r6('(SELECT sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n) FROM axis)')} AS accuracy, "
                f"{r6('mp')} AS macro_precision, {r6('mr')} AS macro_recall, {r6('mf')} AS macro_f1, {r6('wf')} AS weighted_f1 FROM sc",
                **dict(VOTE_TEST, conf=conf, axis="SELECT * FROM conf UNION ALL SELECT a, a, 0 FROM (SELECT unnest(["
                       + names + "]) AS a)", per=PER, rates=PER_RATES, sc=scores))


def _overall_unseen(spark, folder, include: bool):
    pred, classes = predictions(spark, folder, split="test")
    conf = evaluation.confusion(pred, [c for c in classes if c != "RARE"])
    return evaluation.overall(conf, include_unseen=include)


@query("overall_with_unseen", unseen_sql(True))
def overall_with_unseen(spark, folder):
    return _overall_unseen(spark, folder, True)


@query("overall_without_unseen", unseen_sql(False))
def overall_without_unseen(spark, folder):
    return _overall_unseen(spark, folder, False)


RANK_OF_ACTUAL = "(" + " + ".join(
    f"CASE WHEN q{i} > qa OR (q{i} = qa AND '{c}' < actual) THEN 1 ELSE 0 END" for i, c in enumerate(CLASSES)) + ")"
QA = "CASE " + " ".join(f"WHEN actual = '{c}' THEN q{i}" for i, c in enumerate(CLASSES)) + " END"


@query("topk_accuracy", over(
    f"SELECT {r6(f'avg(CASE WHEN {RANK_OF_ACTUAL} < 3 THEN 1 ELSE 0 END)')} AS top3_accuracy, count(*) AS \"rows\" "
    f"FROM (SELECT *, {QA} AS qa FROM pred)", **VOTE_TEST))
def topk_accuracy(spark, folder):
    pred, classes = predictions(spark, folder, split="test")
    return evaluation.topk_accuracy(pred, classes)


@query("majority_accuracy", over(
    f"SELECT {r6('avg(CASE WHEN primary_type = (SELECT primary_type FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) THEN 1 ELSE 0 END)')} "
    f"AS majority_accuracy FROM inc WHERE date >= TIMESTAMP '{VALIDATION_END}'", tr=TR))
def majority_accuracy(spark, folder):
    train, _, test = _parts(spark, folder)
    return evaluation.majority_accuracy(train, test, "primary_type")


@query("error_pairs", over(
    "SELECT * FROM axis WHERE actual <> predicted AND n > 0 ORDER BY n DESC, actual, predicted LIMIT 3", **EVAL))
def error_pairs(spark, folder):
    return evaluation.error_pairs(_test_confusion(spark, folder), 3)


@query("interpretation", over(
    f"""SELECT b.class AS best_class, {r6('b.f1')} AS best_f1, w.class AS worst_class, {r6('w.f1')} AS worst_f1,
  e.actual AS error_actual, e.predicted AS error_predicted, e.n AS error_rows FROM
  (SELECT class, f1 FROM rates WHERE support > 0 ORDER BY f1 DESC, class DESC LIMIT 1) b,
  (SELECT class, f1 FROM rates WHERE support > 0 ORDER BY f1, class LIMIT 1) w,
  (SELECT * FROM axis WHERE actual <> predicted AND n > 0 ORDER BY n DESC, actual, predicted LIMIT 1) e""", **EVAL))
def interpretation(spark, folder):
    conf = _test_confusion(spark, folder)
    return evaluation.interpret(evaluation.per_class(conf), conf)

# ----------------------- comparison and selection over several mix predictors

# Candidates of the comparison: model, tag, keys voted on, stated training seconds, converged.
CANDIDATES = {
    "constant": ("constant", "baseline", (), 0.5, True),
    "place": ("mix", "baseline", ("loc",), 1.0, True),
    "place_hour": ("mix", "tuned_01", ("loc", "lochr"), 2.0, True),
    "domestic": ("mix", "tuned_02", ("domloc",), 2.0, True),
    "all_keys": ("mix", "tuned_03", tuple(KEYS), 3.0, False),
}


def candidate_confusion(spark, folder, splits: tuple[str, ...] = ()) -> DataFrame:
    """Confusion cells of all candidates on some splits (all by default), from one scoring pass (training rows out of fold)."""
    keys = features.mix_keys()
    mix = _mix(spark, folder, keys, top=None)
    rows = features.normalise_raw(with_split(incidents(spark, folder, spread=True), TRAIN_END, VALIDATION_END))
    if splits:
        rows = rows.filter(F.col("split").isin(*splits))
    scored = features.attach_mix(rows, mix, keys, features.training_fold(mix, F.col("split") == "train"))
    names = F.array(*[F.lit(c) for c in mix.classes])
    entries = []
    for name, (_, _, tags, _, _) in CANDIDATES.items():
        total = features.vote(mix, tags) if tags else [F.lit(p) for p in mix.prior]
        array = F.array(*total)
        entries.append(F.struct(F.lit(name).alias("candidate"), F.element_at(
            names, F.array_position(array, F.array_max(array)).cast("int")).alias("predicted")))
    long = scored.select("split", F.col("primary_type").alias("actual"), F.explode(F.array(*entries)).alias("e"))
    return evaluation.confusion(long.select("split", "actual", "e.*"), mix.classes, by=("candidate", "split"))


def candidate_results(spark, folder, split: str = "validation") -> DataFrame:
    """Result rows of the comparison: model, tag, metrics, training seconds, converged."""
    scores = evaluation.overall(settle(candidate_confusion(spark, folder, (split,) if split else ())), by=("candidate", "split"))
    about = F.create_map(*[x for n, (m, t, _, s, c) in CANDIDATES.items() for x in (
        F.lit(n), F.struct(F.lit(m).alias("model"), F.lit(t).alias("tag"), F.lit(s).alias("training_seconds"),
                           F.lit(c).alias("converged")))])
    return (scores.withColumn("about", about[F.col("candidate")])
            .select("about.*", F.col("split").alias("basis"), F.lit("view").alias("experiment_id"),
                    *evaluation.METRICS))


def results_sql() -> dict[str, str]:
    """Steps ending in ``res``: one row per candidate and split, metrics rounded."""
    steps = mix_steps(KEYS)
    width = range(len(CLASSES))
    by_tag = ", ".join(f"max(CASE WHEN tag = '{t}' THEN v{i} END) AS {t}_{i}" for t in KEYS for i in width)
    steps["wide"] = f"SELECT unique_key, {by_tag} FROM vals GROUP BY 1"
    rows = []
    for name, (_, _, tags, _, _) in CANDIDATES.items():
        mean = [("(" + " + ".join(f"{t}_{i}" for t in tags) + f") / {len(tags)}") if tags else f"p{i}" for i in width]
        rows.append(f"SELECT unique_key, '{name}' AS candidate, " + ", ".join(f"{m} AS q{i}" for i, m in enumerate(mean))
                    + " FROM wide, prior")
    best = "greatest(" + ", ".join(f"q{i}" for i in width) + ")"
    chosen = "CASE " + " ".join(f"WHEN q{i} = {best} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    steps["cand"] = union_sql(rows)
    steps["conf"] = (f"SELECT candidate, split, primary_type AS actual, {chosen} AS predicted, count(*) AS n FROM cand "
                     "JOIN sp USING (unique_key) GROUP BY 1, 2, 3, 4")
    steps["per"] = """SELECT candidate, split, class, sum(support) AS support, sum(guessed) AS guessed, sum(hits) AS hits FROM (
  SELECT candidate, split, actual AS class, n AS support, 0 AS guessed, CASE WHEN actual = predicted THEN n ELSE 0 END AS hits FROM conf
  UNION ALL SELECT candidate, split, predicted, 0, n, 0 FROM conf
  UNION ALL SELECT DISTINCT candidate, split, c, 0, 0, 0 FROM conf CROSS JOIN (SELECT DISTINCT primary_type AS c FROM tr)) GROUP BY 1, 2, 3"""
    steps["rates"] = """SELECT candidate, split, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  CASE WHEN support + guessed > 0 THEN 2 * hits / (support + guessed) ELSE 0 END AS f1, support, hits FROM per"""
    about = ", ".join(f"('{n}', '{m}', '{t}', CAST({s} AS DOUBLE), {str(c).lower()})" for n, (m, t, _, s, c) in CANDIDATES.items())
    steps["res"] = ("SELECT model, tag, training_seconds, converged, split AS basis, 'view' AS experiment_id, "
                    "sum(hits) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, "
                    "avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM rates JOIN (SELECT * FROM (VALUES "
                    f"{about}) AS a(candidate, model, tag, training_seconds, converged)) USING (candidate) GROUP BY ALL")
    return steps


RESULTS = results_sql()
ROUNDED = ", ".join(f"{r6(m)} AS {m}" for m in evaluation.METRICS)
RANKING = "macro_f1 DESC, weighted_f1 DESC, training_seconds, model, tag"


@query("rank_results", over(
    f"SELECT model, tag, training_seconds, converged, basis, experiment_id, {ROUNDED}, "
    f"CAST(row_number() OVER (ORDER BY {RANKING}) AS INT) AS position FROM res WHERE basis = 'validation'", **RESULTS))
def rank_results(spark, folder):
    return selection.rank_results(candidate_results(spark, folder))


@query("select_winner", over(
    f"SELECT w.model, w.tag, {r6('w.macro_f1')} AS validation_macro_f1, {r6('w.weighted_f1')} AS validation_weighted_f1, "
    f"w.training_seconds, {r6('b.macro_f1')} AS baseline_macro_f1, {r6('w.macro_f1 - b.macro_f1')} AS macro_f1_change FROM "
    f"(SELECT * FROM res WHERE basis = 'validation' AND converged ORDER BY {RANKING} LIMIT 1) w "
    "JOIN res b ON b.model = w.model AND b.tag = 'baseline' AND b.basis = 'validation'", **RESULTS))
def select_winner(spark, folder):
    return selection.select_winner(candidate_results(spark, folder))


@query("model_comparison", over(
    f"SELECT model, basis, {ROUNDED}, training_seconds, converged, "
    f"CAST(row_number() OVER (ORDER BY {RANKING}) AS INT) AS position FROM res WHERE basis = 'validation' AND tag = 'baseline'", **RESULTS))
def model_comparison(spark, folder):
    baselines = candidate_results(spark, folder).filter(F.col("tag") == "baseline")
    return selection.comparison(baselines)


SIDES = [f"{m} {b}" for m in ("constant", "mix") for b in ("validation", "test")]


@query("compare_models", over(
    "SELECT metric, " + ", ".join(f"max(CASE WHEN model || ' ' || basis = '{s}' THEN v END) AS \"{s}\"" for s in SIDES) + " FROM ("
    + union_sql(f"SELECT '{m}' AS metric, model, basis, {r6(m)} AS v FROM res WHERE tag = 'baseline'" for m in evaluation.METRICS)
    + ") GROUP BY 1", **RESULTS))
def compare_models(spark, folder):
    scores = candidate_results(spark, folder, split="").filter(F.col("tag") == "baseline")
    return evaluation.compare_models(scores, SIDES)


@query("generalisation_gap", over(
    f"SELECT {r6('a.macro_f1')} AS train_macro_f1, {r6('b.macro_f1')} AS validation_macro_f1, {r6('a.macro_f1 - b.macro_f1')} AS gap FROM "
    "(SELECT * FROM res WHERE tag = 'tuned_01' AND basis = 'train') a, (SELECT * FROM res WHERE tag = 'tuned_01' AND basis = 'validation') b",
    **RESULTS))
def generalisation_gap(spark, folder):
    scores = settle(candidate_results(spark, folder, split="").filter(F.col("tag") == "tuned_01"))
    return evaluation.generalisation_gap(scores.filter(F.col("basis") == "train"), scores.filter(F.col("basis") == "validation"))


@query("folds", over(
    "SELECT CAST(fold AS INT) AS fold, count(*) AS \"rows\" FROM norm GROUP BY 1", sp=SPLIT, norm=NORM))
def folds(spark, folder):
    fold = fold_of(F.col("unique_key"), 5)
    return incidents(spark, folder).groupBy(fold.alias("fold")).agg(F.count("*").alias("rows"))
