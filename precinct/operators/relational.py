"""Joins, grouped aggregates, windows, ranking and set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.functions.predicates import blank_or_null
from precinct.schema import DEFAULT_CENTRE
from precinct.session import broadcast_if_small, settle

# ---------------------------------------------------------------- projections

def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULL by a constant, column by column."""
    return df.fillna(values)


def drop_missing(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def tall(df: DataFrame, names: dict[str, list[Column]], label: str, fields: list[str]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per entry (no second scan)."""
    rows = [F.struct(F.lit(name).alias(label), *[v.alias(f) for v, f in zip(values, fields)])
            for name, values in names.items()]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

# ---------------------------------------------------------------------- joins

def unseen_classes(holdout: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """Target values of the holdout that training never shows."""
    return holdout.select(target).distinct().join(train.select(target).distinct(), target, "left_anti")


def attach_zone(df: DataFrame, zones: DataFrame, zone_col: str, key: str) -> DataFrame:
    return df.join(zones.select(key, F.col(zone_col).alias("zone")), key)


def rows_with_repeated_key(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once.

    The key counts are partially aggregated before their shuffle; the semi join
    keeps the row side on the left, where AQE can split a hot key.
    """
    return df.join(repeated_keys(df, key).select(key), key, "left_semi")


def on_axis(axis: DataFrame, counts: DataFrame, key: str, value: str = "count") -> DataFrame:
    """Left join onto a complete axis; absent groups count zero."""
    return axis.join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object],
           rows: int | None = None) -> DataFrame:
    """Left join of fitted values with a default for keys the table lacks.

    ``table`` is broadcast only after its rows were counted (``rows`` when the caller
    already knows them).  Beyond the bound the join is a sort-merge join whose hot keys
    AQE splits on the row side.
    """
    joined = df.join(broadcast_if_small(table, rows=rows), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v))
                               for c, v in defaults.items()})


def with_area(df: DataFrame, areas: DataFrame, area: str, unknown: str | None = None) -> DataFrame:
    """Attach name, centre and default district; an unlisted id gets a made-up name.

    ``unknown`` names rows of unlisted or absent ids; without it they read "Area n".
    """
    dim = areas.select(F.col("area_id").alias(area), F.col("name").alias("area_name"),
                       F.col("lat").alias("area_lat"), F.col("lon").alias("area_lon"),
                       F.col("district").alias("area_district"))
    fallback = F.lit(unknown) if unknown else F.concat(F.lit("Area "), F.col(area).cast("string"))
    return (df.join(broadcast_if_small(dim), area, "left")
            .withColumns({"area_name": F.coalesce("area_name", fallback),
                          "area_lat": F.coalesce("area_lat", F.lit(DEFAULT_CENTRE[0])),
                          "area_lon": F.coalesce("area_lon", F.lit(DEFAULT_CENTRE[1]))}))


def assert_unique_key(df: DataFrame, key: str, label: str = "table") -> None:
    if not df.filter(F.col(key).isNull()).isEmpty() or not repeated_keys(df, key).isEmpty():
        raise ValueError(f"{label}: {key} must be non-null and unique")


def key_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row of facts about a key on two tables, from one shuffle of the key column.

    Keys are counted per side before the shuffle, so a repeated key costs one row per task.
    """
    def side(df: DataFrame, left: int) -> DataFrame:
        return df.select(key, F.lit(left).cast("long").alias("l"), F.lit(1 - left).cast("long").alias("r"))

    counts = side(a, 1).unionByName(side(b, 0)).groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    known, left, right = F.col(key).isNotNull(), F.col("l"), F.col("r")
    return counts.agg(
        F.count(F.when(known & (left > 0) & (right == 0), 1)).alias("only_left"),
        F.count(F.when(known & (right > 0) & (left == 0), 1)).alias("only_right"),
        F.count(F.when(known & (left > 1), 1)).alias("repeated_left"),
        F.count(F.when(known & (right > 1), 1)).alias("repeated_right"),
        F.coalesce(F.sum(F.when(~known, left)), F.lit(0).cast("long")).alias("null_left"),
        F.coalesce(F.sum(F.when(~known, right)), F.lit(0).cast("long")).alias("null_right"))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of keys of each side that the other lacks."""
    return tall(key_match(a, b, key), {s: [F.col(s)] for s in ("only_left", "only_right")}, "side", ["n"])


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    facts = key_match(a, b, key).first()
    return facts["only_left"] == 0 and facts["only_right"] == 0


def assert_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    if not same_keys(a, b, key):
        raise ValueError(f"Both tables must hold the same {key} values")


def assert_one_to_one(a: DataFrame, b: DataFrame, key: str) -> None:
    """Key non-null and unique on both sides, and present on both."""
    facts = key_match(a, b, key).first().asDict()
    if any(facts.values()):
        raise ValueError(f"{key} must match one to one: {facts}")


def keep_top_classes(df: DataFrame, target: str, k: int) -> DataFrame:
    """Rows of the k most frequent classes (ties by class name)."""
    top = settle(top_groups(df, target, k).select(target))
    return df.join(broadcast_if_small(top), target, "left_semi")

# ----------------------------------------------------------------- aggregates

def value_counts(df: DataFrame, *cols) -> DataFrame:
    """Group count (column ``count``)."""
    return df.groupBy(*cols).agg(F.count("*").alias("count"))


def coverage(df: DataFrame, ts: str, by: str | None = None) -> DataFrame:
    grouped = df.groupBy(by) if by else df
    return grouped.agg(F.min(ts).alias("first_record"), F.max(ts).alias("last_record"), F.count("*").alias("count"))


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0).cast("long")).alias(c)
                    for c in (cols or df.columns)])


def n_distinct(df: DataFrame, col: str, count_null: bool = False) -> DataFrame:
    value = F.struct(col) if count_null else F.col(col)
    return df.agg(F.count_distinct(value).alias("n_distinct"))


def approx_distinct(df: DataFrame, cols, rsd: float = 0.05) -> DataFrame:
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in cols])


def approx_quartiles(df: DataFrame, cols, accuracy: int = 10_000) -> DataFrame:
    """Approximate quartiles from mergeable sketches of bounded size."""
    wide = df.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(c) for c in cols])
    return tall(wide, {c: [F.col(c)[0], F.col(c)[1], F.col(c)[2]] for c in cols}, "column_name",
                ["q1", "median", "q3"])


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum in one pass."""
    parts = ("n", "mean", "stddev", "min", "max")
    builders = (F.count, F.avg, F.stddev_samp, F.min, F.max)
    wide = df.agg(*[f(c).alias(f"{c}__{p}") for c in cols for p, f in zip(parts, builders)])
    picked = {c: [F.col(f"{c}__n")] + [F.col(f"{c}__{p}").cast("double") for p in parts[1:]] for c in cols}
    return tall(wide, picked, "column_name", ["n", "mean", "stddev", "min_value", "max_value"])


def rate(df: DataFrame, flag: Column, by=None, name: str = "rate") -> DataFrame:
    """Share of rows for which a flag holds."""
    measure = F.avg(flag.cast("double")).alias(name)
    return (df.groupBy(by) if by else df).agg(measure)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return value_counts(df, key).filter(F.col("count") > 1)


def argmax_row(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Row with the largest ``by``; the smallest ``tie`` wins among equals."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(1)


def frequencies(train: DataFrame, col: str, name: str = "freq") -> DataFrame:
    """Share of each value among the non-null values."""
    return frequencies_of(value_counts(train, col), col, name)


def frequencies_of(counts: DataFrame, col: str, name: str = "freq") -> DataFrame:
    """The same shares from counts per value."""
    known = counts.filter(F.col(col).isNotNull())
    return known.select(col, (F.col("count") / known.agg(F.sum("count")).scalar()).alias(name))


def class_prior(train: DataFrame, target: str) -> DataFrame:
    """Class, count, share and rank (share descending, class ascending).

    The window has no partition: it sees one row per class, and the class list is
    a bounded domain (models keep class x class matrices of it).
    """
    counts = value_counts(train, target)
    order = Window.orderBy(F.desc("count"), F.asc(target))
    return counts.select(target, "count", (F.col("count") / counts.agg(F.sum("count")).scalar()).alias("share"),
                         F.row_number().over(order).alias("rank"))


def median_of_counts(counts: DataFrame, value: str = "count") -> DataFrame:
    """Median over group counts: few distinct numbers, so the exact median is cheap."""
    return counts.agg(F.median(value).alias("median"))


def class_weights(train: DataFrame, target: str) -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = value_counts(train, target)
    totals = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    n, k = totals.select("n").scalar(), totals.select("k").scalar()
    return counts.select(target, "count", (n / (k * F.col("count"))).alias("weight"))


def trend_counts(df: DataFrame, ts: str, target: str, classes: dict[str, str]) -> DataFrame:
    """Counts per year and month (named classes and everything else) and the last record."""
    named = [F.count(F.when(F.col(target) == value, 1)).alias(name) for name, value in classes.items()]
    rest = F.count(F.when(~F.coalesce(F.col(target).isin(*classes.values()), F.lit(False)), 1)).alias("other")
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month_number")).agg(*named, rest, F.max(ts).alias("last_record"))


def pivot_matrix(long: DataFrame, row: str, col: str, value: str, columns) -> DataFrame:
    """Matrix with one row per ``row``; absent cells are zero.

    The column values are given, so no extra job has to discover them.
    """
    return long.groupBy(row).pivot(col, list(columns)).agg(F.first(value)).fillna(0)

# -------------------------------------------------------------------- windows

def cumulative_share(counts: DataFrame, target: str) -> DataFrame:
    """Share and running share over classes, largest first (one row per class)."""
    share = F.col("count") / counts.agg(F.sum("count")).scalar() * 100
    running = Window.orderBy(F.desc("count"), F.asc(target)).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("share_pct", share)
            .withColumn("cumulative_pct", F.sum("count").over(running)
                        / counts.agg(F.sum("count")).scalar() * 100))


def share_within(counts: DataFrame, group: str, name: str, value: str = "count") -> DataFrame:
    """Percent of each row within its group.  Input is already aggregated, so a
    group holds one row per class however many records stand behind it."""
    return counts.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(group)) * 100)


def label_by_frequency(train: DataFrame, target: str) -> DataFrame:
    """Ordinal labels, most frequent class first."""
    order = Window.orderBy(F.desc("count"), F.asc(target))
    return value_counts(train, target).select(target, (F.row_number().over(order) - 1).cast("double").alias("label"))


def label_by_name(train: DataFrame, target: str) -> DataFrame:
    """Ordinal labels in lexicographic order."""
    order = Window.orderBy(F.asc(target))
    return (train.select(target).distinct()
            .select(target, (F.row_number().over(order) - 1).cast("double").alias("label")))


def apply_labels(df: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """Attach labels; a class training never saw gets -1."""
    return lookup(df, settle(labels), [target], {"label": -1.0})


def top_k_per_group(df: DataFrame, group: str, target: str, k: int) -> DataFrame:
    """Most frequent classes per group with their rank."""
    order = Window.partitionBy(group).orderBy(F.desc("count"), F.asc(target))
    return (value_counts(df, group, target)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))

# ------------------------------------------------------------ sorting, limits

def recent(df: DataFrame, ts: str, key: str, n: int = 8) -> DataFrame:
    return df.orderBy(F.desc(ts), F.asc(key)).limit(n)


def top_groups(df: DataFrame, col: str, k: int) -> DataFrame:
    return value_counts(df, col).orderBy(F.desc("count"), F.asc(col)).limit(k)


def extremes(df: DataFrame, by: str, k: int, tie: str, largest: bool = False) -> DataFrame:
    return df.orderBy(F.desc(by) if largest else F.asc(by), F.asc(tie)).limit(k)


def chronological(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Total order by time and id: a range shuffle, only for consumers that need it."""
    return df.orderBy(ts, key)

# ------------------------------------------------------------- set operations

def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of every row; copies collapse map-side before the shuffle."""
    return df.dropDuplicates()


def drop_duplicates_by(df: DataFrame, key: str) -> DataFrame:
    return df.dropDuplicates([key])


def class_names(df: DataFrame, target: str) -> list[str]:
    """Sorted class names: the label domain, which a classifier's driver-side description holds whole."""
    rows = df.filter(~blank_or_null(F.col(target))).select(target).distinct().collect()
    return sorted(r[0] for r in rows)
