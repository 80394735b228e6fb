"""Shards of nearly equal bytes by sampled splitters: DataFrame functions only.

Records are ordered by (hash of the text, doc_id, row number), so that equal texts stand together.  Keys are sampled in
proportion to the records' sizes, quantiles of the weighted sample become boundaries, every range between them is
measured exactly, and ranges that are overfull are sampled and cut again until none is.  Boundaries lie between groups of
equal texts; only a range that is one such group is cut within it.  The exact bytes before each range then place every
group (or every record of an overfull group) on the line from 0 to the total, which is cut into equal shards.
"""
from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.session import store

OVERHEAD = 8  # bytes that a record counts besides its text
RANGES = 16  # ranges a shard has at least, unless it has fewer records
RANGE_BYTES = 4 << 30  # bytes of a range at most: what one task numbers
PER_RANGE = 8  # sampled keys for as many bytes as a range may have
LEAST = -(1 << 63)
KEY = "struct<g: bigint, d: bigint, row: bigint>"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key (g, d, row) of each record: all that the shuffles carry."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.struct(F.xxhash64(text).alias("g"), F.coalesce(doc_id, F.lit(LEAST)).alias("d"), F.monotonically_increasing_id().alias("row")).alias("key"))


def _place(cuts: list[tuple]) -> Column:
    """Number of the range that ``key`` falls in: a binary search among the sorted ``cuts``, each the first key of a range."""
    if not cuts:
        return F.lit(0)
    found = F.from_json(F.lit(json.dumps([dict(zip(("g", "d", "row"), c)) for c in cuts])), f"array<{KEY}>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(found, low + step - 1) <= F.col("key")), low + step).otherwise(low))


def _measured(records: DataFrame, cuts: list[tuple]) -> list:
    """One row per range that has records: its number, bytes, rows, first and last key."""
    ranges = records.groupBy(_place(cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"))
    return sorted(ranges.collect(), key=lambda r: r["range"])


def _between(first: tuple, last: tuple, total: int, sample: list[tuple], limit: int) -> set[tuple]:
    """Keys that cut an overfull range at quantiles of its weighted sample, each above ``first`` and at most ``last``."""
    parts = math.ceil(2 * total / limit)
    weight = sum(w for _, w in sample)
    bounds, i = [], 1
    for key, reached in zip((k for k, _ in sample), itertools.accumulate(w for _, w in sample)):
        while i < parts and reached >= weight * i / parts:
            bounds.append(key)
            i += 1
    if first[0] == last[0]:
        return {k for k in bounds if first < k <= last} or {last}
    groups = [k[0] for k in bounds]
    behind = {g + 1 for g in groups if groups.count(g) > 1 or g == first[0]}  # a hot group becomes a range of its own
    return {(g, LEAST, LEAST) for g in {*groups, *behind} if first[0] < g <= last[0]} or {(last[0], LEAST, LEAST)}


def splitters(records: DataFrame, limit: int) -> tuple[list[tuple], list]:
    """Cuts between ranges of at most ``limit`` bytes (a single record may be larger), and the ranges' exact measures.

    The driver sees about PER_RANGE sampled keys and one row per range of ``limit`` bytes, whatever the number of rows.
    """
    cuts: list[tuple] = []
    for turn in itertools.count():
        ranges = _measured(records, cuts)
        over = {r["range"]: r for r in ranges if r["bytes"] > limit and r["rows"] > 1}
        if not over:
            return cuts, ranges
        step = limit / PER_RANGE
        chance = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 52)) / float(1 << 52)
        drawn = (records.select("key", "size", _place(cuts).alias("range")).where(F.col("range").isin(*over) if cuts else F.lit(True))
                 .where(chance < F.col("size") / step).select("range", "key.*", F.greatest("size", F.lit(step)).cast("double").alias("weight")).collect())
        by_range: dict[int, list] = {}
        for r in sorted(drawn):
            by_range.setdefault(r["range"], []).append(((r["g"], r["d"], r["row"]), r["weight"]))
        for number, r in over.items():
            cuts = [*cuts, *_between(tuple(r["first"]), tuple(r["last"]), r["bytes"], by_range.get(number, []), limit)]
        cuts = sorted(set(cuts))


def shard(docs: DataFrame, shards: int = 24, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null), one row per row of ``docs``.

    A shard's bytes differ from an equal share by at most the bytes of a range (a sixteenth of a shard) or of one record.
    Equal texts share a shard unless they fill a range or more.  A null text is empty; rows without a doc_id are sharded
    like others; rows that repeat a doc_id or are equal count each; an empty table has no rows.  Columns other than doc_id
    and text play no part.  ``slot`` numbers the records of a shard from 0 without gaps.
    """
    records = store(sized(docs))  # row numbers are fixed from here on
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    cuts, found = splitters(records, max(1, min(total // (shards * ranges), RANGE_BYTES)))
    size = len(cuts) + 1
    before, rows, single = [0] * size, [0] * size, [False] * size
    at = count = 0
    for r in found:
        before[r["range"]], rows[r["range"]], single[r["range"]] = at, count, r["first"]["g"] == r["last"]["g"]
        at, count = at + r["bytes"], count + r["rows"]

    def known(values: list, kind: str) -> Column:
        return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("range"))

    ordered = Window.partitionBy("range").orderBy("key.g", "key.d", "key.row")
    group = Window.partitionBy("range", "key.g")
    alone = known(single, "boolean")
    line = records.withColumn("range", _place(cuts)).select(
        "*", (known(before, "bigint") + F.sum("size").over(ordered) - F.col("size")).alias("start"), (known(rows, "bigint") + F.row_number().over(ordered) - 1).alias("place"))
    line = line.withColumns({"low": F.when(alone, F.col("start")).otherwise(F.min("start").over(group)),
                             "length": F.when(alone, F.col("size")).otherwise(F.sum("size").over(group))})
    middle = F.expr(f"cast(least({shards - 1}, ((2 * low + length) * {shards}) div {2 * max(1, total)}) as int)")
    placed = store(line.select("doc_id", "size", "text_crc32", middle.alias("shard"), "place"))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = F.from_json(F.lit(json.dumps([first.get(i, 0) for i in range(shards)])), "array<bigint>")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.get(starts, F.col("shard"))).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
