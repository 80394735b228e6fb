"""A hidden Markov language model over whole texts, and the unigram score it is measured against.

Words are counted over all training texts; the full table of counts stays in Spark.  The model's latent states emit
symbols: the most frequent words are symbols of their own, all others share a symbol by their ending, and within such a class a word
has its smoothed share, as counted.  So the model gives every word a probability, and P(text) = P(symbols) * P(words | symbols).

* Counts: one pass, added up by word.  Words that make up at least 2**-20 of all tokens (so at most 2**20 words) go to
  the tasks with their counts; occurrences of the others are joined with the table, one row per occurrence.
* Baum-Welch: each round, tasks run scaled forward and backward recursions over whole symbol sequences and add up expected
  counts; these are summed across partitions, one row per parameter, and the driver normalises them.
* Likelihood: the scaled forward recursion over each whole sequence, exact.
"""
from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow, map_texts, pieces, texts
from precinct.session import store

STATES, ROUNDS = 8, 5
SYMBOLS = 4096  # most frequent words that are symbols of their own
CLASSES = 256  # symbols shared by the other words
FREQUENT = 2.0**-20
SMOOTH = 0.1
COUNTED = 300_000  # different words a task holds before it hands on their counts
TOKENS = 2_000_000  # tokens of the sequences that one recursion runs over together
LEVELS = (1024, 4096)  # lengths from which sequences are grouped apart
SEQUENCE = 1 << 20  # in learning, longer sequences are taken in parts of this length


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""
    def run(batches):
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

        def handed(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch):
                for text in part.column(1).to_pylist():
                    counts.update(words_of(text))
                if len(counts) > COUNTED:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    return map_arrow(docs, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals, and the frequent words with their ranks and counts."""

    tokens: int  # N, ends of texts included
    distinct: int  # V, the end of a text included
    texts: int
    words: list[bytes]  # frequent words, most frequent first
    counts: np.ndarray
    class_tokens: np.ndarray  # of the words that share a symbol: how many tokens and different words each class has
    class_words: np.ndarray

    def __post_init__(self):
        self.rank = {w: i for i, w in enumerate(self.words)}
        own = min(SYMBOLS, len(self.words))
        self.symbol = np.array([i if i < own else SYMBOLS + class_of(w) for i, w in enumerate(self.words)] + [SYMBOLS + CLASSES], np.int32)  # the last: end of text
        self.log_count = np.log10(np.append(self.counts, self.texts) + SMOOTH)
        self.log_share = np.zeros(SYMBOLS + CLASSES + 1)
        self.log_share[SYMBOLS:-1] = np.log10(self.class_tokens + SMOOTH * (self.class_words + 1))

    def encode(self, text: str) -> tuple[np.ndarray, list[bytes], float, float, int]:
        """Symbols, the words that are not frequent, sums of log10(count + 0.1) over the frequent tokens (for the unigram
        score; for P(words | symbols), less the classes' totals) and how many of them were seen in training."""
        words = words_of(text)
        ranks = np.fromiter(map(self.rank.get, words, itertools.repeat(-1)), np.int64, len(words))
        ranks = np.append(ranks, len(self.words))
        at = np.flatnonzero(ranks < 0)
        rare = [words[i] for i in at.tolist()]
        symbols = self.symbol[ranks]
        symbols[at] = [SYMBOLS + class_of(w) for w in rare]
        logs = self.log_count[ranks]
        logs[at] = 0
        shared = (symbols >= SYMBOLS) & (symbols < SYMBOLS + CLASSES)
        known = len(words) - len(rare) + (self.texts > 0)
        return symbols.astype(np.uint16), rare, float(logs.sum()), float(logs[shared].sum() - self.log_share[symbols].sum()), known


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens = (total.n or 0) + n_texts
    frequent = sorted(((-r.n, bytes(r.word)) for r in counts.where(F.col("n") >= max(1, math.ceil(FREQUENT * tokens))).collect()))
    own = {w for _, w in frequent[:SYMBOLS]}
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % CLASSES).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_tokens[r.c], class_words[r.c] = r.n, r.v
    for n, w in frequent[:SYMBOLS]:
        class_tokens[class_of(w)] += n
        class_words[class_of(w)] -= w in own
    return Vocabulary(tokens, total.v + (n_texts > 0), n_texts, [w for _, w in frequent], np.array([-n for n, _ in frequent], float), class_tokens, class_words)


class Model:
    """Initial, transition and emission probabilities."""

    def __init__(self, symbols: int, states: int = STATES):
        rng = np.random.default_rng(0)
        self.initial = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        self.emit = rng.gamma(2.0, size=(states, symbols)) + 1e-3
        self.emit /= self.emit.sum(axis=1, keepdims=True)

    def parameters(self) -> int:
        return len(self.initial) + self.move.size + self.emit.size

    def learned(self, expected: np.ndarray) -> "Model":
        """The model that makes the expected counts likeliest (with a little smoothing)."""
        new = Model.__new__(Model)
        k, m = self.emit.shape
        new.initial = expected[:k] + 0.01
        new.move = expected[k:k + k * k].reshape(k, k) + 0.01
        seen = expected[k + k * k:].reshape(k, m)
        new.emit = seen + 0.01 + 0.5 * seen.sum(axis=0) / max(1.0, seen.sum()) * k
        for p in (new.initial[None], new.move, new.emit):
            p /= p.sum(axis=1, keepdims=True)
        return new

    def _steps(self, sequences: list[np.ndarray]):
        """Sequences side by side, longest first: order, starts, and how many reach each step."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        reach = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), "right")
        return np.concatenate(sequences).astype(np.int64), order, starts, reach.tolist()

    def likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence, by the scaled forward recursion."""
        if not sequences:
            return np.empty(0)
        flat, order, starts, reach = self._steps(sequences)
        emit = np.ascontiguousarray(self.emit.T)
        total, a = np.zeros(len(sequences)), None
        for t, n in enumerate(reach):
            b = emit[flat[starts[:n] + t]]
            a = self.initial * b if t == 0 else (a[:n] @ self.move) * b
            c = a.sum(axis=1)
            a = a / c[:, None]
            total[:n] += np.log10(c)
        out = np.empty(len(sequences))
        out[order] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Expected counts of starts, moves and emissions, by scaled forward and backward recursions (in single precision).

        Columns are sequences, so that a step reads and writes whole rows; what a step needs of the emissions is looked up
        once for all steps, for a block of them at a time.
        """
        k, m = self.emit.shape
        flat, _, starts, reach = self._steps(sequences)
        offsets = np.concatenate([[0], np.cumsum(reach)])
        symbols = np.empty(len(flat), np.int64)
        for t, n in enumerate(reach):
            np.take(flat, starts[:n] + t, out=symbols[offsets[t]:offsets[t] + n])
        emit, move = self.emit.astype(np.float32), np.ascontiguousarray(self.move.astype(np.float32))
        emitting = emit[:, symbols]
        alpha, a = np.empty((k, len(flat)), np.float32), None
        scale, into = np.empty(len(flat), np.float32), np.ascontiguousarray(move.T)
        for t, n in enumerate(reach):
            here = slice(offsets[t], offsets[t] + n)
            a = (self.initial[:, None].astype(np.float32) if t == 0 else into @ a[:, :n]) * emitting[:, here]
            c = a.sum(axis=0)
            a /= c
            alpha[:, here], scale[here] = a, c
        emitting /= scale
        moves, beta = np.zeros((k, k)), np.ones((k, reach[-1]), np.float32)
        for t in range(len(reach) - 2, -1, -1):
            n, after = reach[t], reach[t + 1]
            later = slice(offsets[t + 1], offsets[t + 1] + after)
            w = emitting[:, later] * beta
            moves += alpha[:, offsets[t]:offsets[t] + after] @ w.T
            alpha[:, later] *= beta  # from here on the share of each state
            beta = np.ones((k, n), np.float32)
            np.matmul(move, w, out=beta[:, :after])
        alpha[:, :reach[0]] *= beta
        emitted = np.stack([np.bincount(symbols, alpha[j], m) for j in range(k)])
        return np.concatenate([alpha[:, :reach[0]].sum(axis=1, dtype=float), (moves * self.move).ravel(), emitted.ravel()])


def _grouped(batches):
    """Rows of the batches (key, symbols) in groups of about TOKENS tokens.

    Sequences of like length go together: a recursion takes as many steps as its longest sequence is long.
    """
    groups = {level: ([], []) for level in range(len(LEVELS) + 1)}
    sizes = dict.fromkeys(groups, 0)
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            symbols = np.frombuffer(raw.as_buffer(), np.uint16).copy()
            level = sum(len(symbols) >= least for least in LEVELS)
            groups[level][0].append(key)
            groups[level][1].append(symbols)
            sizes[level] += len(symbols)
            if sizes[level] >= TOKENS:
                yield groups[level]
                groups[level], sizes[level] = ([], []), 0
    yield from (group for group in groups.values() if group[0])


def one_round(sequences: DataFrame, model: Model) -> Model:
    """One round of Baum-Welch over all rows (key, symbols)."""
    shared, parameters = sequences.sparkSession.sparkContext.broadcast(model), model.parameters()

    def run(batches):
        total = np.zeros(parameters)
        for _, held in _grouped(batches):
            total += shared.value.expected([s[i:i + SEQUENCE] for s in held for i in range(0, len(s), SEQUENCE)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "x"])

    expected = np.zeros(parameters)
    for row in map_arrow(sequences, run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # <= one row per parameter
        expected[row.i] = row.x
    return model.learned(expected)


def score(docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on doc_id; counts, symbols and the model are learned from the other documents, all of
    them.  A null doc_id is held out.  Null and empty texts consist of their end alone.  Rows that repeat a doc_id are
    learned from and scored each.  Empty table: no rows; without training texts every word has the same share.
    """
    every = texts(docs).withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    training = every.where("not held_out")
    counts = store(word_counts(training.select("doc_id", "text")))
    words = vocabulary(counts, training.select("doc_id").count())
    shared = docs.sparkSession.sparkContext.broadcast(words)
    state: dict = {}

    def encode(batch: pa.RecordBatch) -> dict:
        task = TaskContext.get()
        if state.get("attempt") != task.taskAttemptId():
            state.update(attempt=task.taskAttemptId(), rows=itertools.count(task.partitionId() << 33))
        found = [shared.value.encode(t) for t in batch.column(1).to_pylist()]
        return {"key": [next(state["rows"]) for _ in found], "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": [len(f[0]) for f in found],
                "symbols": [f[0].tobytes() for f in found], "rare": [f[1] for f in found], "base": [f[2] for f in found], "within": [f[3] for f in found], "known": [f[4] for f in found]}

    coded = store(map_texts(every, encode, "key long, doc_id long, held_out boolean, n_tokens long, symbols binary, rare array<binary>, base double, within double, known long"))
    model = Model(SYMBOLS + CLASSES + 1, states)
    for _ in range(rounds):
        model = one_round(coded.where("not held_out").select("key", "symbols"), model)
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def forward(batches):
        for keys, held in _grouped(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fitted.value.likelihood(held))], names=["key", "likelihood"])

    likelihood = map_arrow(coded.select("key", "symbols"), forward, "key long, likelihood double")
    rare = coded.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    sums = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("rare_log"), F.count("n").alias("rare_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    scored = coded.select("key", "doc_id", "held_out", "n_tokens", "base", "within", "known").join(likelihood, "key").join(sums, "key", "left")
    share = math.log10(words.tokens + SMOOTH * (words.distinct + 1))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
                         (F.col("base") + zero("rare_log") - F.col("n_tokens") * F.lit(share)).alias("base_score"),
                         (F.col("likelihood") + F.col("within") + zero("rare_log")).alias("score"))
