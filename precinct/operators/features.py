"""Feature engineering.

``fit_*`` functions look at training rows only and return small tables or scalars;
``add_*`` functions are projections and lookups that apply them to any rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.predicates import coordinate_missing, parse_bool
from precinct.functions.scalars import (
    code_text, cyclic, fold_of, grid_cell, hour_block, mix_key, norm_text, not_nan, rot45, weekday0)
from precinct.operators.quantiles import median
from precinct.operators.relational import extremes, frequencies_of, lookup, rate
from precinct.schema import INCIDENTS, LEAKAGE_COLUMNS, UNKNOWN, Roles
from precinct.session import broadcast_if_small, settle

# Fixed values of the historical mix: classes kept, pseudo-count, folds.
TOP_CLASSES, SMOOTHING, FOLDS = 12, 20, 5


def drop_leakage(df: DataFrame, cols=LEAKAGE_COLUMNS) -> DataFrame:
    return df.drop(*cols)

# ------------------------------------------------------------------ row features

def add_temporal(df: DataFrame, ts: str = "date") -> DataFrame:
    """hour, month, day_of_week (Monday = 0), is_weekend."""
    day = weekday0(F.col(ts))
    return df.withColumns({"hour": F.hour(ts), "month": F.month(ts), "day_of_week": day,
                           "is_weekend": day.isin(5, 6).cast("int")})


def add_cyclic(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday and month (needs the temporal features)."""
    made = {}
    for name, period, offset in (("hour", 24, 0), ("day_of_week", 7, 0), ("month", 12, 1)):
        made[f"{name}_sin"], made[f"{name}_cos"] = cyclic(F.col(name), period, offset)
    return df.withColumns(made)


def add_area_group(df: DataFrame, median_lat: float, median_lon: float, roles: Roles = INCIDENTS) -> DataFrame:
    """Quadrant around two thresholds; a missing coordinate is Unknown."""
    lat, lon = F.col(roles.lat), F.col(roles.lon)
    north = F.when(lat >= F.lit(median_lat), "North").otherwise("South")
    west = F.when(lon < F.lit(median_lon), "West").otherwise("East")
    return df.withColumn("area_group", F.when(coordinate_missing(lat, lon), UNKNOWN)
                         .otherwise(F.concat_ws("-", north, west)))


def fit_medians(train: DataFrame, roles: Roles = INCIDENTS) -> tuple[float, float]:
    """Exact training medians of both coordinates."""
    found = median(train, [roles.lat, roles.lon])
    return found[roles.lat], found[roles.lon]


def fit_approx_medians(train: DataFrame, roles: Roles = INCIDENTS, accuracy: int = 10_000) -> tuple[float, float]:
    """Sketch medians: one pass, bounded state."""
    row = train.agg(*[F.percentile_approx(c, 0.5, accuracy) for c in (roles.lat, roles.lon)]).first()
    return row[0], row[1]

# How each preset encodes a missing code and a missing location.
MISSING_PRESETS = {
    "indexed": {"codes": -1, "location": "Unknown"},
    "text": {"codes": "Unknown", "location": "UNKNOWN"},
    "interim": {"codes": 0, "location": "OTHER"},
}


def handle_missing(df: DataFrame, medians: tuple[float, float], roles: Roles = INCIDENTS,
                   codes=("ward", "community_area"), preset: str = "indexed") -> DataFrame:
    """Flag missing coordinates, then fill: training medians, location label, code label."""
    values = MISSING_PRESETS[preset]
    flagged = df.withColumn("coordinates_missing",
                            coordinate_missing(F.col(roles.lat), F.col(roles.lon)).cast("int"))
    if isinstance(values["codes"], str):
        flagged = flagged.withColumns({c: F.col(c).cast("string") for c in codes})
    return flagged.fillna({roles.context: values["location"], **{c: values["codes"] for c in codes},
                           roles.lat: medians[0], roles.lon: medians[1]})


def add_domestic_int(df: DataFrame, flag: str = "domestic") -> DataFrame:
    return df.withColumn("domestic_int", parse_bool(F.col(flag)).cast("int"))


def add_reporting_flags(df: DataFrame, ts: str = "date") -> DataFrame:
    """minute, day and the flags midnight / on the hour / first of month."""
    minute, day = F.minute(ts), F.dayofmonth(ts)
    return df.withColumns({
        "minute": minute, "day": day,
        "is_midnight": ((F.hour(ts) == 0) & (minute == 0)).cast("int"),
        "on_the_hour": (minute == 0).cast("int"), "first_of_month": (day == 1).cast("int")})


def add_rotation(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    a, b = rot45(F.col(roles.lat), F.col(roles.lon))
    return df.withColumns({"rot45_a": a, "rot45_b": b})


def normalise_raw(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Codes as text with a numeric copy, location trimmed and upper-cased, flag as 0/1."""
    place = norm_text(F.coalesce(F.col(roles.context), F.lit(UNKNOWN)))
    numeric = {f"{c}_num": F.col(c).try_cast("double") for c in roles.codes}
    return (df.withColumns({**numeric, "domestic_int": parse_bool(F.col(roles.flag)).cast("int"),
                            roles.lat: not_nan(F.col(roles.lat).try_cast("double")),
                            roles.lon: not_nan(F.col(roles.lon).try_cast("double"))})
            .withColumns({**{c: code_text(F.col(c)) for c in roles.codes}, roles.context: place}))

# ------------------------------------------------------------- fitted encodings

def fit_frequencies(train: DataFrame, cols) -> dict[str, DataFrame]:
    """Training share of each value, one table per column; one scan counts the values of all columns."""
    cols = list(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    counts = settle(train.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.v").agg(F.count("*").alias("count")))
    return {c: frequencies_of(counts.filter(F.col("c") == i).select(F.col("v").cast(train.schema[c].dataType).alias(c), "count"), c, f"{c}_freq") for i, c in enumerate(cols)}


def apply_frequencies(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Add ``<column>_freq``; a value training lacks gets 0."""
    for c, table in tables.items():
        df = lookup(df, table, [c], {f"{c}_freq": 0.0})
    return df


def frequency_encode(train: DataFrame, df: DataFrame, cols) -> DataFrame:
    return apply_frequencies(df, fit_frequencies(train, cols))


def midnight_share(train: DataFrame, roles: Roles = INCIDENTS, k: int = 8) -> DataFrame:
    """Classes with the largest share of records logged at 00:00."""
    at_midnight = (F.hour(roles.ts) == 0) & (F.minute(roles.ts) == 0)
    shares = rate(train, at_midnight, roles.target, "midnight_share")
    return extremes(shares, "midnight_share", k, tie=roles.target, largest=True)


def on_the_hour_share(train: DataFrame, ts: str = "date") -> DataFrame:
    return rate(train, F.minute(ts) == 0, name="on_the_hour_share")


def mix_keys(roles: Roles = INCIDENTS) -> dict[str, Column]:
    """The six grouping keys over normalised rows."""
    place, ts = F.col(roles.context), F.col(roles.ts)
    finest, wider = roles.codes[:2]
    return {
        "loc": place,
        "beat": F.col(finest),
        "locdist": mix_key(place, F.col(wider)),
        "lochr": mix_key(place, hour_block(ts).cast("string")),
        "domloc": mix_key(parse_bool(F.col(roles.flag)).cast("int").cast("string"), place),
        "grid": grid_cell(F.col(roles.lat), F.col(roles.lon)),
    }


def reporting_keys(roles: Roles = INCIDENTS) -> dict[str, Column]:
    """Keys that change with the minute and the day, for scoring over expanded times."""
    place, ts = F.col(roles.context), F.col(roles.ts)
    return {
        "loc": place,
        "lochr": mix_key(place, hour_block(ts).cast("string")),
        "locrep": mix_key(place, (F.minute(ts) == 0).cast("int").cast("string"),
                          (F.dayofmonth(ts) == 1).cast("int").cast("string")),
    }


@dataclass
class MixTables:
    """Fitted historical class mix.

    ``table`` holds one row per (tag, mix_key, fold): ``fold`` -1 carries the values of
    all training rows, fold f the values of all rows outside fold f.  ``mix`` is aligned
    with ``classes``; ``prior`` is the training share of each class.
    """

    table: DataFrame
    classes: list[str]
    prior: list[float]
    tags: list[str]
    folds: int
    sizes: dict[str, int]


def _tagged(keys: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), k.alias("mix_key")) for t, k in keys.items()]))


def fit_mix(train: DataFrame, keys: dict[str, Column], roles: Roles = INCIDENTS, top: int | None = TOP_CLASSES,
            alpha: float = SMOOTHING, folds: int = FOLDS) -> MixTables:
    """Smoothed class shares of every key, for all training rows and with each fold left out.

    One scan of the training rows: each row yields one (tag, key) pair per mix table, and
    the pairs are counted per (tag, key, fold, class) before the shuffle, so a key that
    holds a third of the rows costs a few rows per map task.  All the rest works on those
    counts; leaving a fold out is the key total minus the fold's own sums.  Classes come by
    share; with ``top=None`` all classes are kept, by name.
    """
    target = roles.target
    pairs = train.select(target, fold_of(F.col(roles.id), folds).alias("fold"), _tagged(keys).alias("p"))
    cells = settle(pairs.select(target, "fold", "p.*").groupBy("tag", "mix_key", "fold", target)
                   .agg(F.count("*").alias("n")))

    # Every record is in each tag once, so one tag holds the class totals; one row per class.
    totals = cells.filter(F.col("tag") == next(iter(keys))).groupBy(target).agg(F.sum("n").alias("n")).collect()
    order = (lambda r: (-r["n"], r[target])) if top else (lambda r: r[target])
    leaders, rows = sorted(totals, key=order)[:top], sum(r["n"] for r in totals)
    classes, prior = [r[target] for r in leaders], [r["n"] / rows for r in leaders]

    hits = [F.coalesce(F.sum(F.when(F.col(target) == c, F.col("n"))), F.lit(0).cast("long")) for c in classes]
    own = cells.groupBy("tag", "mix_key", "fold").agg(F.sum("n").alias("n"), F.array(*hits).alias("sums"))

    def smooth(n: Column, counts: Column) -> Column:
        rest = [(counts[i] + F.lit(alpha * prior[i])) / (n + F.lit(float(alpha))) for i in range(len(classes))]
        return F.array(*rest)

    # A key has at most ``folds`` rows here: total them, then subtract each fold's own counts.
    grouped = own.groupBy("tag", "mix_key").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(len(classes))]).alias("sums"),
        F.collect_list(F.struct("fold", "n", "sums")).alias("own"))
    none = F.struct(F.lit(-1).alias("fold"), F.lit(0).cast("long").alias("n"),
                    F.array(*[F.lit(0).cast("long")] * len(classes)).alias("sums"))
    spread = grouped.select("tag", "mix_key", "n", "sums", F.explode(F.array_append("own", none)).alias("o"))
    left = F.zip_with("sums", "o.sums", lambda a, b: a - b)
    rest = spread.select("tag", "mix_key", F.col("o.fold").alias("fold"), (F.col("n") - F.col("o.n")).alias("n"),
                         left.alias("sums"))
    table = settle(rest.select("tag", "mix_key", "fold", "n", smooth(F.col("n"), F.col("sums")).alias("mix")))
    sizes = {r["tag"]: r["count"] for r in table.groupBy("tag").count().collect()}  # one row per mix table
    return MixTables(table, classes, prior, list(keys), folds, sizes)


def smoothed_mix(mix: MixTables, tag: str) -> DataFrame:
    """One table in wide form: key, rows, and one column per class."""
    rows = mix.table.filter((F.col("tag") == tag) & (F.col("fold") == -1))
    return rows.select("mix_key", "n", *[F.col("mix")[i].alias(f"mix_{c}") for i, c in enumerate(mix.classes)])


def out_of_fold_mix(mix: MixTables, tag: str) -> DataFrame:
    """One table with a fold left out: key, fold, remaining rows, and one column per class."""
    rows = mix.table.filter((F.col("tag") == tag) & (F.col("fold") >= 0))
    return rows.select("mix_key", "fold", "n", *[F.col("mix")[i].alias(f"mix_{c}") for i, c in enumerate(mix.classes)])


def mix_column(tag: str, i: int) -> str:
    return f"mix_{tag}_{i}"


def attach_mix(df: DataFrame, mix: MixTables, keys: dict[str, Column], fold: Column) -> DataFrame:
    """Add one column per key and class (``mix_<tag>_<i>``, prior where the key is unseen).

    ``fold`` is the row's own fold, or -1 for rows outside training.  All tables are
    joined first (broadcast when their counted size allows it), so small tables leave
    the rows where they are: no shuffle, one projection before and one after the joins.
    """
    width = range(len(mix.classes))
    out = df.withColumns({"__fold": fold, **{f"__k_{t}": k for t, k in keys.items()}})
    for tag in keys:
        part = mix.table.filter(F.col("tag") == tag).select(
            F.col("mix_key").alias(f"__k_{tag}"), F.col("fold").alias("__fold"),
            *[F.col("mix")[i].alias(mix_column(tag, i)) for i in width])
        out = out.join(broadcast_if_small(part, row_bytes=64 + 8 * len(mix.classes), rows=mix.sizes.get(tag, 0)), [f"__k_{tag}", "__fold"], "left")
    shares = [F.coalesce(F.col(mix_column(t, i)), F.lit(mix.prior[i])).alias(mix_column(t, i)) for t in keys for i in width]
    return out.select(*df.columns, *shares)


def vote(mix: MixTables, tags) -> list[Column]:
    """Mean of the attached shares over some keys, one column per class."""
    tags = list(tags)
    return [sum((F.col(mix_column(t, i)) for t in tags[1:]), F.col(mix_column(tags[0], i))) / len(tags)
            for i in range(len(mix.classes))]


def training_fold(mix: MixTables, in_training: Column, roles: Roles = INCIDENTS) -> Column:
    return F.when(in_training, fold_of(F.col(roles.id), mix.folds)).otherwise(F.lit(-1))


def add_mix_features(df: DataFrame, mix: MixTables, in_training: Column | None, roles: Roles = INCIDENTS,
                     keys: dict[str, Column] | None = None) -> DataFrame:
    """Mix columns for all rows: out of fold on training rows (None: there are none), full training tables elsewhere."""
    chosen = keys or mix_keys(roles)
    fold = F.lit(-1) if in_training is None else training_fold(mix, in_training, roles)
    attached = attach_mix(df, mix, chosen, fold)
    return attached.withColumnsRenamed({mix_column(t, i): f"mix_{t}_{c}"
                                        for t in chosen for i, c in enumerate(mix.classes)})


def mix_vote(df: DataFrame, mix: MixTables, keys: dict[str, Column], fold: Column) -> DataFrame:
    """Transparent baseline: the class probability is the mean of the key mixes.

    Adds ``probability`` aligned with ``mix.classes`` and ``predicted``.
    """
    scored = attach_mix(df, mix, keys, fold)
    return with_predicted(scored.select(*df.columns, F.array(*vote(mix, keys)).alias("probability")), mix.classes)


def with_predicted(df: DataFrame, classes: list[str]) -> DataFrame:
    """Class of the largest probability (the first one among equals)."""
    names = F.array(*[F.lit(c) for c in classes])
    place = F.array_position("probability", F.array_max("probability")).cast("int")
    return df.withColumn("predicted", F.element_at(names, place))


def final_features(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """All row-level features of the final model over raw incident columns."""
    out = add_rotation(add_reporting_flags(add_temporal(normalise_raw(df, roles), roles.ts), roles.ts), roles)
    return out.withColumn("coordinates_missing", F.col(roles.lat).isNull().cast("int"))
