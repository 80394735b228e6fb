"""Hard negatives by an inverted multi-index: exact, with certified windows.

Vectors are cut in two halves, each with a codebook of its own; a pair of codes is a cell.  The rows are dealt to shards by
(cell, vec_id), and every anchor goes to every shard.  There a heap visits the shard's cells in the order of an upper bound
on any score in them: the sum of both halves' bounds, each the product with the code's centre plus the anchor's length times
the code's radius.  A search ends when what it looks for is found above the bound of the next cell.  Codebooks only decide
the order of the work: every row is in a cell, and the results are those of comparing all.
"""
from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow
from precinct.session import store

SCALE, LIMIT = 256, 1 << 27  # components are floor(SCALE * x), held within +-LIMIT so that scores stay 64-bit numbers
SAMPLE = 4096  # rows that the codebooks are fitted on
CODES = 256  # codes of a half at most
SHARDS, LEAST_ROWS, MOST_ROWS = 64, 4096, 1 << 19  # shards for tables whose shards have between so many rows
BATCH = 1024  # rows scored at once, about

ROWS = "shard int, kind int, cell int, vec_id long, label int, vec binary"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def participants(embeddings: DataFrame, flip: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, v (array of int).

    Rows with a null vec_id, label or vector, or with a component that is null or not finite, take no part.  Where vec_id
    is divisible by ``flip`` the label first moves on by one.  Rows that repeat a vec_id count once: the one with the
    smallest label and vector.  A shorter vector counts as zero beyond its end.
    """
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("int")
    vector = F.col("embedding").cast("array<double>")
    used = embeddings.select(vec_id.alias("vec_id"), label.alias("label"), vector.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    moved = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    kept = used.select("vec_id", F.struct(moved.alias("label"), whole.alias("v")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return kept.select("vec_id", "r.label", "r.v")


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int32)
    for row, values in zip(out, lists):
        found = values.values.to_numpy(zero_copy_only=False)
        row[:len(found)] = found
    return out


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of ``k`` groups (Lloyd's steps from evenly spread rows)."""
    if not len(x):
        return np.zeros((k, x.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(float)
    for _ in range(8):
        near = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * (x.astype(float) @ centres.T), axis=1)


class Codes:
    """The two codebooks and the keys at which shards begin."""

    def __init__(self, ids, x: np.ndarray, codes: int, shards: int):
        self.dims, self.half = x.shape[1], x.shape[1] // 2
        k = max(1, min(codes, len(x)))
        self.books = [_codebook(x[:, part], k) for part in self.parts()]
        keys = sorted(zip(self.cells(x).tolist(), ids))
        self.cuts = sorted({keys[len(keys) * i // shards] for i in range(1, shards)})

    def parts(self):
        return slice(0, self.half), slice(self.half, self.dims)

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = (_nearest(x[:, part], book) for part, book in zip(self.parts(), self.books))
        return first * len(self.books[1]) + second


class Shard:
    """The cells of one shard: rows sorted by cell, centres and radii of the codes that occur."""

    def __init__(self, codes: Codes, cells: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        most = int(np.abs(x).max(initial=0))
        # Products are summed in the narrowest type that holds them exactly.
        kind = np.float32 if most * most * codes.dims < 1 << 24 else np.float64 if most * most * codes.dims < 1 << 53 else np.int64
        self.codes, self.ids, self.labels, self.x = codes, ids, labels, x.astype(kind)
        self.most = most
        width = len(codes.books[1])
        found, starts = np.unique(cells, return_index=True)
        ends = np.append(starts[1:], len(cells))
        self.used, self.centres, self.radii = [], [], []
        for side, (part, code) in enumerate(zip(codes.parts(), (cells // width, cells % width))):
            used, inverse = np.unique(code, return_inverse=True)
            centres = codes.books[side][used]
            radii = np.zeros(len(used))
            for first in range(0, len(x), 1 << 16):  # in blocks, so that distances take little memory
                rows = slice(first, first + (1 << 16))
                np.maximum.at(radii, inverse[rows], np.linalg.norm(x[rows, part] - centres[inverse[rows]], axis=1))
            self.used.append(used), self.centres.append(centres), self.radii.append(radii)
        places = [{int(c): i for i, c in enumerate(used)} for used in self.used]
        self.cells = {(places[0][int(c) // width], places[1][int(c) % width]): (int(a), int(b)) for c, a, b in zip(found, starts, ends)}

    def visits(self, q: np.ndarray):
        """Batches (row numbers, scores, bound on every later score), by a multi-sequence heap over both halves."""
        bounds, orders = [], []
        slack = 1 + 1e-9 * self.codes.dims * float(np.abs(q).max(initial=0)) * self.most
        for part, centres, radii in zip(self.codes.parts(), self.centres, self.radii):
            bound = centres @ q[part].astype(float) + np.linalg.norm(q[part].astype(float)) * radii
            order = np.argsort(-bound)
            bounds.append(bound[order].tolist()), orders.append(order.tolist())
        (u, v), (a, b) = bounds, orders
        exact = q.astype(self.x.dtype) if int(np.abs(q).max(initial=0)) <= self.most or self.x.dtype == np.int64 else None
        x = self.x
        if exact is None:  # an anchor with larger components than this shard's rows
            exact, x = q.astype(np.int64), self.x.astype(np.int64)
        heap, rows, size = [(-(u[0] + v[0]), 0, 0)], [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            if place := self.cells.get((a[i], b[j])):
                rows.append(np.arange(*place))
                size += place[1] - place[0]
            if size >= BATCH or not heap and rows:
                at = np.concatenate(rows)
                yield at, (x[at] @ exact).astype(np.int64), slack - heap[0][0] if heap else -np.inf
                rows, size = [], 0

    def positives(self, vec_id: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The first ``k`` other rows of the label: (score, vec_id), higher scores first, then smaller ids."""
        best: list[tuple[int, int]] = []
        for at, scores, later in self.visits(q):
            fits = (self.labels[at] == label) & (self.ids[at] != vec_id)
            best = _first(best, scores, self.ids[at], fits, k)
            if len(best) == k and best[-1][0] > later:
                break
        return best

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores its first ``k`` rows of other labels."""
        best: list[list] = [[] for _ in windows]
        for at, scores, later in self.visits(q):
            other = self.labels[at] != label
            best = [_first(b, scores, self.ids[at], other & (scores >= low) & (scores <= high), k) for b, (low, high) in zip(best, windows)]
            if all(later < low or len(b) == k and b[-1][0] > later for b, (low, _) in zip(best, windows)):
                break
        return best


def _first(best: list, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> list:
    if len(best) == k:
        fits = fits & (scores >= best[-1][0])
    at = np.flatnonzero(fits)
    if len(at) > k:
        at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return sorted([*best, *((int(scores[i]), int(ids[i])) for i in at)], key=lambda r: (-r[0], r[1]))[:k] if len(at) else best


def window(positive: int, low: int = 50, high: int = 95) -> tuple[int, int]:
    """Scores n with low * positive <= 100 n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _search(codes, positives: int, negatives: int, second: bool):
    """Task function: a shard's rows come first, then the anchors, which are answered one by one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(FOUND))

    def run(batches):
        number, parts, shard, rows = None, [], None, []

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return made

        def vectors(column):
            return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), codes.value.dims)

        for batch in batches:
            shards, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            for first in (starts := [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1), batch.num_rows])[:-1]:
                part = batch.slice(first, starts[starts.index(first) + 1] - first)
                if not part.num_rows:
                    continue
                if shards[first] != number:
                    number, parts, shard = shards[first], [], None
                if kinds[first] == 0:
                    parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(), vectors(part.column(5))))
                    continue
                if not parts and shard is None:
                    continue  # no rows in this shard
                if shard is None:
                    shard, parts = Shard(codes.value, *(np.concatenate(c) for c in zip(*parts))), []
                known = part.column(6).to_pylist()
                for vec_id, label, q, own in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), vectors(part.column(5)), known):
                    if not second:
                        rows += [(vec_id, i, s, None, None) for s, i in shard.positives(vec_id, label, q, positives)]
                    else:
                        scores = sorted({p["score"] for p in own})
                        found = dict(zip(scores, shard.negatives(label, q, [window(s) for s in scores], negatives)))
                        rows += [(vec_id, p["vec_id"], p["score"], i, s) for p in own for s, i in found[p["score"]]]
                    if len(rows) >= 8192:
                        yield out()
        if rows:
            yield out()

    return run


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; see ``participants`` for rows that take no part or repeat.
    An anchor without another row of its label, and a positive without a row in its window (always so below a score of
    0), give no rows; nor does an empty table.  Columns other than vec_id, label and embedding play no part.
    """
    spark = embeddings.sparkSession
    rows = store(participants(embeddings))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, n // SHARDS))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 8 * shards)).collect()
    x = np.zeros((len(drawn), dims), np.int32)
    for row, r in zip(x, drawn):
        row[:len(r["v"])] = r["v"]
    codes = spark.sparkContext.broadcast(Codes([r["vec_id"] for r in drawn], x, min(CODES, max(4, round((n / 50) ** 0.5))), shards))

    def coded(batches):
        for batch in batches:
            v = _matrix(batch.column(2), codes.value.dims)
            cells, ids = codes.value.cells(v), batch.column(0)
            places = [bisect_right(codes.value.cuts, key) for key in zip(cells.tolist(), ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(np.zeros(len(v), np.int32)), pa.array(cells, pa.int32()), ids, batch.column(1),
                                              pa.array([r.tobytes() for r in v], pa.binary())], names=[c.split()[0] for c in ROWS.split(", ")])

    index = store(map_arrow(rows.select("vec_id", "label", "v"), coded, ROWS))
    anchors = index.where(F.col("vec_id") % every == 0)
    count = len(codes.value.cuts) + 1

    def answered(asked: DataFrame, second: bool) -> DataFrame:
        copies = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(count - 1))), "kind": F.lit(1)})
        both = index.withColumn("known", F.lit(None).cast("array<struct<score: bigint, vec_id: bigint>>")).unionByName(copies.select("shard", "kind", "cell", "vec_id", "label", "vec", "known"))
        dealt = both.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "kind", "cell", "vec_id")
        return map_arrow(dealt, _search(codes, positives, negatives, second), FOUND)

    near = answered(anchors.withColumn("known", F.lit(None).cast("array<struct<score: bigint, vec_id: bigint>>")), False)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    own = near.withColumn("place", place).where(F.col("place") <= positives).groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("vec_id"))).alias("known"))
    found = answered(anchors.join(own, "vec_id"), True)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
