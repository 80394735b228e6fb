"""Packs token pieces into as few sequences of a fixed capacity as it can, by patterns of lengths.

1. Texts become pieces of at most ``capacity`` tokens (only longer documents are cut; the first piece is the short one).
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) goes to the driver.  Patterns of
   two and three lengths that fill a sequence exactly are enumerated, and non-negative least squares finds how often to
   repeat each so that together they use up the histogram.  Repeat counts are rounded to what is there, and the residual
   lengths are packed best-fit decreasing, length class by length class.
3. Each piece has a rank among the pieces of its length; the plan says which sequence and offset take which ranks.
   Ranks come from counts per task and length and their prefix sums, so no class of equal lengths meets in one task.
"""
from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.common import map_texts, texts
from precinct.llm.tokens import crc, encoder
from precinct.session import store

ITERATIONS = 200  # of the least-squares descent


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Piece lengths of a document: all ``capacity``, but for a first one that takes what is left over."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of the given lengths that add up to ``capacity``; a pair has 0 in front."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in np.flatnonzero(there):
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        c = capacity - a - b
        ok = there[b] & there[c] & (c < capacity)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), int)


def non_negative_fit(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A counting the lengths of each pattern (accelerated projection)."""
    target = histogram.astype(float).copy()
    target[0] = 0

    def use(x):
        made = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), len(target))
        made[0] = 0
        return made

    v = np.ones(len(patterns))
    for _ in range(15):
        v = use(v)[patterns].sum(axis=1)
        scale = np.linalg.norm(v) or 1.0
        v /= scale
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(ITERATIONS):
        new = np.maximum(0, y - (use(y) - target)[patterns].sum(axis=1) / (1.01 * scale))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); every length is used exactly as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        x = non_negative_fit(patterns, left)
        for i in np.argsort(-x, kind="stable").tolist():
            need = Counter(k for k in patterns[i].tolist() if k)
            n = min(int(round(x[i])), *(int(left[k]) // m for k, m in need.items()))
            if n:
                plan.append((tuple(need.elements()), n))
                for k, m in need.items():
                    left[k] -= n * m
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over length classes: equal lengths are placed together into groups of equal sequences."""
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        for space in range(length, capacity):
            while count and by_space.get(space):
                pattern, n = by_space[space].pop()
                fit = min(space // length, max(1, count // n)) if count >= n else 1
                put = min(n, count)
                by_space[space - fit * length].append((pattern + (length,) * fit, put))
                count -= put * fit
                if n > put:
                    by_space[space].append((pattern, n - put))
        each = capacity // length
        if count >= each:
            by_space[capacity - each * length].append(((length,) * each, count // each))
        if count % each:
            by_space[capacity - count % each * length].append(((length,) * (count % each), 1))
    return [group for groups in by_space.values() for group in groups]


class Plan:
    """Where the pieces of each length go: ranks from ``lo[i]`` on take sequences from ``sequence[i]`` on, at ``offset[i]``."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], capacity: int):
        slots = defaultdict(list)
        base = 0
        for pattern, n in plan:
            at = 0
            for length in pattern:
                slots[length].append((n, base, at))
                at += length
            base += n
        self.sequences = base
        self.by_length = {}
        for length, rows in slots.items():
            n, sequence, offset = np.array(rows, np.int64).T
            self.by_length[length] = (np.concatenate([[0], np.cumsum(n)[:-1]]), sequence, offset)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            lo, first, at = self.by_length[int(lengths[part[0]])]
            i = np.searchsorted(lo, ranks[part], "right") - 1
            sequence[part], offset[part] = first[i] + ranks[part] - lo[i], at[i]
        return sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ``task`` and ``rank``: the piece's place among those of its length in its task."""
    state: dict = {}

    def cut(batch: pa.RecordBatch) -> dict:
        task = TaskContext.get()
        if state.get("attempt") != task.taskAttemptId():
            state.update(attempt=task.taskAttemptId(), seen=Counter())
        code, seen = encoder(tokenizer), state["seen"]
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(code.encode(text), code.dtype)
            if end_id is not None:
                ids = np.append(ids, np.array([end_id], code.dtype))
            start = 0
            for i, length in enumerate(cut_lengths(len(ids), capacity)):
                for name, value in zip(out, (key, i, start, length, crc(ids[start:start + length]), task.partitionId(), seen[length])):
                    out[name].append(value)
                seen[length] += 1
                start += length
        return out

    return map_texts(texts(docs), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty (with ``end_id``, a piece of one token; without, no piece).  Rows that repeat a doc_id are packed
    each by itself.  Empty table: no rows.  The result is a plan over all pieces: no piece is dropped or cut short.
    """
    stored = store(token_pieces(docs, tokenizer, capacity, end_id))
    counts = stored.groupBy("task", "length").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("task", "length", "base")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # <= capacity rows
    plan = Plan(pack_histogram(histogram, capacity), capacity)

    def place(batch: pa.RecordBatch) -> dict:
        table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        sequence, offset = plan.place(table["length"].to_numpy(), table["rank"].to_numpy() + table["base"].to_numpy())
        return table | {"sequence_id": sequence, "offset": offset}

    ranked = stored.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank", "base", F.lit("").alias("text"))
    return map_texts(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
