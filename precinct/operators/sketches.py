"""Stored sketches: a review of a table that grows day by day reads only what is new.

A partition's distinct counts and quantiles are kept as binary columns of one row (HyperLogLog and KLL sketches).  Rows of
many partitions unite into the sketch of the whole, whatever order they come in; old partitions are never read again.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.predicates import is_finite

LG_K, K = 12, 4096  # sizes of the sketches
DISTINCT_ERROR = 4 * 1.04 / 2 ** (LG_K / 2)  # four standard errors of a distinct count
RANK_ERROR = 0.002  # bound on a quantile's rank at this size


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def _number(col: str) -> Column:
    value = F.col(col).cast("double")
    return F.when(is_finite(value), value)


def partition_sketches(df: DataFrame, by: Column, distinct=(), measures=()) -> DataFrame:
    """One row per partition: ``part``, rows, missing values, and a sketch per column (``d_``: distinct values, ``q_``: quantiles)."""
    return df.groupBy(by.alias("part")).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in distinct],
        *[F.hll_sketch_agg(_text(c), F.lit(LG_K)).alias(f"d_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(_number(c), F.lit(K)).alias(f"q_{c}") for c in measures])


def united(table: DataFrame) -> DataFrame:
    """One row for all partitions of a sketch table."""
    kinds = {"d": F.hll_union_agg, "q": F.kll_merge_agg_double, "n": F.sum}
    return table.agg(F.sum("rows").alias("rows"), *[kinds[c[0]](c).alias(c) for c in table.columns if c not in ("part", "rows")])


def add_partitions(path: str, new: DataFrame) -> None:
    """Append sketches of new partitions to the stored table."""
    new.write.mode("append").parquet(path)


def distinct_review(table: DataFrame) -> DataFrame:
    """Approximate distinct values and NULL count per column of the united sketches."""
    whole = united(table)
    rows = [F.struct(F.lit(c[2:]).alias("column_name"), F.hll_sketch_estimate(c).alias("approx_distinct_values"), F.col(f"n_{c[2:]}").alias("null_count"))
            for c in table.columns if c.startswith("d_")]
    return whole.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantile_review(table: DataFrame, probabilities) -> DataFrame:
    """Approximate quantiles per column of the united sketches: column, probability, value."""
    whole = united(table)
    rows = [F.struct(F.lit(c[2:]).alias("column_name"), F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double(c, F.lit(float(p))).alias("value"))
            for c in table.columns if c.startswith("q_") for p in probabilities]
    return whole.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def distinct_errors(review: DataFrame, exact: DataFrame) -> DataFrame:
    """The estimates next to the exact counts (column_name, distinct_values), and whether they keep the stated error."""
    both = review.join(exact, "column_name")
    off = F.abs(F.col("approx_distinct_values") - F.col("distinct_values"))
    return both.select("column_name", "distinct_values", "null_count", (off <= F.greatest(F.lit(1.0), DISTINCT_ERROR * F.col("distinct_values"))).alias("within_error"))


def rank_errors(df: DataFrame, review: DataFrame) -> DataFrame:
    """Per estimated quantile the exact share of values below and up to it, and whether the probability lies between
    (but for the stated error): one pass over the table for all of them."""
    points = review.collect()  # one row per column and probability
    aggregates = [a for i, p in enumerate(points) for a in (
        F.avg((_number(p["column_name"]) < p["value"]).cast("double")).alias(f"below{i}"), F.avg((_number(p["column_name"]) <= p["value"]).cast("double")).alias(f"upto{i}"))]
    rows = [F.struct(F.lit(p["column_name"]).alias("column_name"), F.lit(p["probability"]).alias("probability"),
                     ((F.col(f"below{i}") <= p["probability"] + RANK_ERROR) & (F.col(f"upto{i}") >= p["probability"] - RANK_ERROR)).alias("within_error"))
            for i, p in enumerate(points)]
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stored_day_by_day(path: str, parts: list[DataFrame], by: Column, distinct=(), measures=()) -> DataFrame:
    """Sketch the parts one after the other into the table at ``path`` and read it."""
    for part in parts:
        add_partitions(path, partition_sketches(part, by, distinct, measures))
    return reduce(DataFrame.unionByName, parts).sparkSession.read.parquet(path)
