"""Chronological and stratified splits."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.functions.predicates import in_window
from precinct.functions.scalars import hex_number
from precinct.operators.relational import value_counts
from precinct.schema import INCIDENTS, Roles
from precinct.session import broadcast_if_small, settle

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def with_split(df: DataFrame, train_end: str, validation_end: str, ts: str = "date") -> DataFrame:
    """Add ``split`` from two half-open boundaries."""
    moment = F.col(ts)
    return df.withColumn("split", F.when(in_window(moment, None, train_end), TRAIN)
                         .when(in_window(moment, train_end, validation_end), VALIDATION)
                         .when(in_window(moment, validation_end, None), TEST))


def time_split(df: DataFrame, train_end: str, validation_end: str, ts: str = "date",
               check: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows; the boundaries reach the scan as filters."""
    moment = F.col(ts)
    parts = (df.filter(in_window(moment, None, train_end)),
             df.filter(in_window(moment, train_end, validation_end)),
             df.filter(in_window(moment, validation_end, None)))
    if check and any(p.isEmpty() for p in parts):
        raise ValueError("Every split must hold rows")
    return parts


def split_coverage(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows, time range and rows with a class unseen in training, per split.

    One scan: rows are counted per split and class, the rest is read off those few rows.
    """
    cells = df.groupBy("split", roles.target).agg(
        F.count("*").alias("n"), F.min(roles.ts).alias("a"), F.max(roles.ts).alias("b"))
    seen = F.max((F.col("split") == TRAIN).cast("int")).over(Window.partitionBy(roles.target)) == 1
    return cells.withColumn("seen", seen).groupBy("split").agg(
        F.sum("n").alias("rows"), F.min("a").alias("start"), F.max("b").alias("end"),
        F.sum(F.when(F.col("seen"), 0).otherwise(F.col("n"))).alias("unseen_targets"))


def stratified_split(df: DataFrame, target: str, share: float = 0.2, key: str = "unique_key",
                     seed: str = "", bucket_bits: int = 16) -> DataFrame:
    """Add ``part`` (train / test): the rows of each class with the smallest hash of their id form the test part.

    Exact to the row (``round(share * rows)`` per class) without ranking a whole class
    in one task: hashes are counted by bucket, the bucket where a class reaches its
    quota is found from those counts, and only the rows of that bucket are ranked to find
    the last hash and id that still belong to the test part.  ``key`` must be unique.
    """
    shift = 1 << (32 - bucket_bits)
    text = F.concat(F.lit(seed), F.col(key).cast("string"))
    place = F.struct(hex_number(text, 8).alias("h"), F.col(key).alias("k"))
    hashed = df.select(target, place.alias("p")).withColumn("b", F.floor(F.col("p.h") / F.lit(shift)).cast("long"))
    buckets = value_counts(hashed, target, "b")
    quota = F.round(F.sum("count").over(Window.partitionBy(target)) * F.lit(share)).cast("long")
    upto = F.sum("count").over(Window.partitionBy(target).orderBy("b"))
    reached = (buckets.select(target, "b", quota.alias("q"), (upto - F.col("count")).alias("before"), upto.alias("upto"))
               .filter((F.col("before") < F.col("q")) & (F.col("upto") >= F.col("q"))))
    edges = broadcast_if_small(settle(reached.select(target, "b", (F.col("q") - F.col("before")).alias("need"))))
    rank = F.row_number().over(Window.partitionBy(target).orderBy("p"))
    last = (hashed.join(edges, [target, "b"]).withColumn("rank", rank).filter(F.col("rank") == F.col("need"))
            .select(target, F.col("p").alias("__last")))
    rows = df.join(broadcast_if_small(settle(last)), target, "left")
    return rows.withColumn("part", F.when(place <= F.col("__last"), "test").otherwise("train")).drop("__last")
