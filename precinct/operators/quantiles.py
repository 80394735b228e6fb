"""Exact quantiles of large columns in three scans.

Spark's exact ``percentile`` merges one map of all distinct values into a single
task, which does not hold for a high-cardinality column.  Here the first scan makes a mergeable
quantile sketch per column, which brackets every wanted rank; the second one counts exactly what lies below each
bracket, on its ends and inside it; the third one keeps and sorts the few rows inside.  A bracket too large to sort (from some hundred million
rows on) is bracketed once more by a sketch of its inside.  The counts decide: a bracket that misses its rank is moved.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from precinct.functions.predicates import is_finite

ACCURACY = 2000  # the sketch's ranks are wrong by at most a share of 1 / ACCURACY
BINS = 64  # points of the sketch of a bracket's inside
SORT_ROWS = 50_000  # rows of a bracket that are sorted


@dataclass(frozen=True)
class Bracket:
    """Two values of a column that enclose the given ranks, and the rows expected between them."""

    column: int
    low: float
    high: float
    rows: float
    ranks: tuple[int, ...]

    @property
    def sorts(self) -> bool:
        return self.rows <= SORT_ROWS


def _ranks(n: int, probability: float) -> tuple[int, int, float]:
    position = (n - 1) * probability
    return math.floor(position), math.ceil(position), position - math.floor(position)


def _value(column: int):
    return F.col(f"__v{column}")


def _scan(values: DataFrame, aggregates: list) -> Row:
    """One pass over the table: every bracket and column of it in one aggregate of fixed size."""
    return values.agg(*aggregates).first()


def _sketched(values: DataFrame, columns: int, probabilities: list[float], also: dict[str, Column]) -> tuple[list[tuple[int, float, float, list[float]]], dict]:
    """Per column: finite values, least and largest one, and the values around each probability (lower ends, then upper ends).

    ``also`` names further aggregates that ride along.
    """
    ends = [max(0.0, q - 2 / ACCURACY) for q in probabilities] + [min(1.0, q + 2 / ACCURACY) for q in probabilities]
    row = _scan(values, [a.alias(f"{name}{c}") for c in range(columns) for name, a in (
        ("n", F.count(_value(c))), ("low", F.min(_value(c))), ("high", F.max(_value(c))), ("at", F.percentile_approx(_value(c), ends, ACCURACY)))] + [a.alias(f"also_{name}") for name, a in also.items()])
    return [(row[f"n{c}"], row[f"low{c}"], row[f"high{c}"], row[f"at{c}"]) for c in range(columns)], {name: row[f"also_{name}"] for name in also}


def _inspected(values: DataFrame, brackets: list[Bracket]) -> list[dict]:
    """Per bracket: rows below it, on its ends and inside, and the values at its ranks or a sketch of its inside.

    The counts are one compiled aggregate; the lists and sketches, which are not, see only the rows inside some bracket.
    """
    aggregates, insides = [], []
    for i, b in enumerate(brackets):
        v, low, high = _value(b.column), F.lit(b.low), F.lit(b.high)
        insides.append((v > low) & (v < high))
        aggregates += [F.count_if(v < low).alias(f"below{i}"), F.count_if(v == low).alias(f"low{i}"), F.count_if(insides[i]).alias(f"inside{i}"),
                       F.count_if(v == high).alias(f"high{i}")]
    counts = _scan(values, aggregates)
    seen = [{name: counts[f"{name}{i}"] for name in ("below", "low", "inside", "high")} for i in range(len(brackets))]
    picks, made = [], []
    for i, (b, row) in enumerate(zip(brackets, seen)):
        inside = F.when(insides[i], _value(b.column))
        grid = [k / BINS for k in range(BINS + 1)]
        picks.append((F.sort_array(F.collect_list(inside)) if b.sorts else F.percentile_approx(inside, grid, ACCURACY)).alias(f"at{i}"))
        places = [r - row["below"] - row["low"] for r in b.ranks]
        made.append(F.array(*[F.get(f"at{i}", F.lit(p)) if 0 <= p < row["inside"] else F.lit(None).cast("double") for p in places]) if b.sorts else F.col(f"at{i}"))
    held = values.filter(reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in insides]))
    found = _scan(held.agg(*picks), [F.first(c).alias(f"at{i}") for i, c in enumerate(made)])
    return [{**row, "at": found[f"at{i}"]} for i, row in enumerate(seen)]


def _resolved(b: Bracket, seen: dict, least: float, most: float) -> tuple[dict[int, float], list[Bracket]]:
    """Values of the ranks that the counts settle, and brackets for the others."""
    known: dict[int, float] = {}
    todo: list[Bracket] = []
    for i, r in enumerate(b.ranks):
        place = r - seen["below"] - seen["low"]
        if r < seen["below"]:
            todo.append(Bracket(b.column, least, b.low, seen["below"], (r,)))
        elif place < 0:
            known[r] = b.low
        elif place >= seen["inside"] + (seen["high"] if b.high > b.low else 0):
            todo.append(Bracket(b.column, b.high, most, math.inf, (r,)))
        elif place >= seen["inside"]:
            known[r] = b.high
        elif b.sorts:
            known[r] = seen["at"][i]
        else:
            share = place / seen["inside"]
            first, last = max(0, math.floor((share - 2 / ACCURACY) * BINS)), min(BINS, math.ceil((share + 2 / ACCURACY) * BINS))
            rows = seen["inside"] * ((last - first) / BINS + 4 / ACCURACY)
            todo.append(Bracket(b.column, seen["at"][first], seen["at"][last], rows, (r,)))
    return known, todo


def exact_quantiles(df: DataFrame, cols, probabilities) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles per column, over the finite values."""
    return quantiles_and(df, cols, probabilities, {})[0]


def quantiles_and(df: DataFrame, cols, probabilities, also: dict[str, Column]) -> tuple[dict[str, dict[float, float | None]], dict]:
    """The quantiles, and further aggregates over ``df`` from the same scans."""
    cols, probabilities = list(cols), list(probabilities)
    whole = [F.col(c).cast("double") for c in cols]
    values = df.withColumns({f"__v{i}": F.when(is_finite(v), v) for i, v in enumerate(whole)})
    spans, extra = _sketched(values, len(cols), probabilities, also)
    known: dict[tuple[int, int], float] = {}
    wanted: dict[tuple, set[int]] = {}
    for c, (n, low, high, at) in enumerate(spans):
        if n:
            known[c, 0], known[c, n - 1] = low, high
        for i, q in enumerate(probabilities if n else []):
            ends = (low, high, n) if n <= SORT_ROWS else (at[i], at[i + len(probabilities)], 6 * n / ACCURACY)
            for r in _ranks(n, q)[:2]:
                if (c, r) not in known:
                    wanted.setdefault((c, *ends), set()).add(r)
    todo = [Bracket(*key, tuple(sorted(ranks))) for key, ranks in wanted.items()]
    while todo:
        seen, later = _inspected(values, todo), []
        for b, row in zip(todo, seen):
            found, more = _resolved(b, row, *spans[b.column][1:3])
            known.update({(b.column, r): v for r, v in found.items()})
            later += more
        todo = later
    result: dict[str, dict[float, float | None]] = {}
    for c, name in enumerate(cols):
        result[name] = {}
        for q in probabilities:
            if not spans[c][0]:
                result[name][q] = None
                continue
            low, high, part = _ranks(spans[c][0], q)
            a, b = known[(c, low)], known[(c, high)]
            result[name][q] = a if part == 0 else a + (b - a) * part
    return result, extra


def quantile_table(df: DataFrame, cols, probabilities, names) -> DataFrame:
    """One row per column with the named quantiles."""
    found = exact_quantiles(df, cols, probabilities)
    rows = [(c, *[found[c][q] for q in probabilities]) for c in cols]
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(rows, "column_name string, " + ", ".join(f"{n} double" for n in names))


def median(df: DataFrame, cols) -> dict[str, float | None]:
    return {c: q[0.5] for c, q in exact_quantiles(df, cols, [0.5]).items()}
