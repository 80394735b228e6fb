"""Toxicity by a lexicon met through Levenshtein automata, weighed by the words around each hit.

The lexicon is learned: words that labelled toxic documents hold clearly more often than others, with a few general ones
to begin with.  Its trie is intersected with Levenshtein automata (no edit for words of up to 4 letters, one up to 8,
two beyond) into one deterministic automaton, whose states are made when a word first asks for them; all words of all texts
run through it together, a letter a step.  Around each hit a window of words tells quotation (quotation marks, verbs of reporting)
from abuse (second person, further hits).  A logistic model turns a document's sums into a score.
"""
from __future__ import annotations

import functools
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.common import map_texts, remainder, texts
from precinct.llm.simhash import shingle_hashes
from precinct.session import store

# General terms of abuse that the lexicon starts with, and words of the windows.
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile bastard".split()
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes reported reports word term dit disait écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch tu toi ton ta vous votre tú ti usted ustedes vosotros".split())
QUOTES = frozenset("\"'«»„“”‘’‹›")

SAMPLE = 32768  # labelled rows that lexicon and model are learned from at most
SUPPORT, LEAST, ERRORS = 3, 1.2, 1.5  # toxic documents a word must stand in; log ratio it must exceed by so many standard errors
SEED_WEIGHT = 2.0
WINDOW = 5
FEATURES = 12
OTHER = 1  # class of letters in no term; 0 is not a letter
MEMORY, WORDS, BATCH = 96 << 20, 16384, 1 << 16  # bytes of automaton states kept in a worker, words run together, set members stepped together


def allowed(term: str) -> int:
    return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters or digits of words, as ``_words`` sees them."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of several runs of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Automaton:
    """Trie of the lexicon x Levenshtein automata, made deterministic state by state as words ask for it.

    A state is the set of trie nodes reachable, each with its least number of edits.  States and steps met are kept in the
    worker; beyond ``MEMORY`` bytes all are forgotten and made again.  What is sent to the workers is the terms alone.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.ready = False

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "ready": False}

    def _prepare(self) -> None:
        """Trie with nodes numbered breadth first, so that a node's children follow each other."""
        alphabet = sorted({c for t in self.terms for c in t})
        number_of = {c: i + 2 for i, c in enumerate(alphabet)}
        self._classes = _letters().astype(np.int32) * OTHER
        self._classes[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.width = len(alphabet) + 2
        first, count, letter, most, word = [], [], [0], [0], [-1]
        level, node = [sorted(range(len(self.terms)), key=self.terms.__getitem__)], 0
        depth = 0
        while level:
            below = []
            for members in level:
                most[node] = max((allowed(self.terms[i]) for i in members), default=0)
                first.append(len(letter))
                for c, group in itertools.groupby((i for i in members if len(self.terms[i]) > depth), key=lambda i: self.terms[i][depth]):
                    group = list(group)
                    letter.append(number_of[c])
                    most.append(0)
                    word.append(next((i for i in group if len(self.terms[i]) == depth + 1), -1))
                    below.append(group)
                count.append(len(letter) - first[-1])
                node += 1
            level, depth = below, depth + 1
        self.first, self.count, self.letter, self.most, self.word = (np.array(x, np.int64) for x in (first, count, letter, most, word))
        self.own = np.array([allowed(self.terms[i]) if i >= 0 else -1 for i in word], np.int64)
        self.ready = True
        self._forget()

    def _forget(self) -> None:
        self.table = np.full((1024, self.width), -1, np.int32)
        self.term, self.edits = np.full(1024, -1, np.int32), np.zeros(1024, np.int32)
        self.states, self.seen, self.bytes = [], {}, 0
        for state in (np.empty(0, np.int64), np.zeros(1, np.int64)):
            pair = np.zeros(len(state), np.int64)
            self._number(self._closed(pair, state, pair)[1:])
        self.table[0] = 0

    def _number(self, state: tuple[np.ndarray, np.ndarray]) -> int:
        """The number of a state (nodes ascending, edits), a new one if it was not met."""
        node, edits = state
        key = (node * 4 + edits).astype(np.int32).tobytes()
        number = self.seen.get(key)
        if number is None:
            number = self.seen[key] = len(self.states)
            self.states.append(np.frombuffer(key, np.int32))
            self.bytes += 2 * len(key) + 300 + 4 * self.width
            if number == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.term, self.edits = np.concatenate([self.term, np.full_like(self.term, -1)]), np.concatenate([self.edits, np.zeros_like(self.edits)])
            ends = np.flatnonzero(edits <= self.own[node])
            if len(ends):
                self.edits[number], self.term[number] = min(zip(edits[ends].tolist(), self.word[node[ends]].tolist()))
        return number

    def _children(self, pair: np.ndarray, node: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.count[node]
        return np.repeat(pair, n), np.repeat(self.first[node], n) + _runs(n), np.repeat(edits, n)

    def _closed(self, pair: np.ndarray, node: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add what is reached by leaving out letters of a term; of each pair's nodes the least edits, nodes ascending."""
        parts = [(pair, node, edits)]
        while len(parts[-1][0]):
            p, child, e = self._children(*parts[-1])
            kept = e + 1 <= self.most[child]
            parts.append((p[kept], child[kept], e[kept] + 1))
        pair, node, edits = (np.concatenate(x) for x in zip(*parts))
        nodes = len(self.letter)
        key = np.sort((pair * nodes + node) * 4 + edits)
        key = key[np.concatenate([[True], key[1:] >> 2 != key[:-1] >> 2])] if len(key) else key
        return (key >> 2) // nodes, (key >> 2) % nodes, key & 3

    def _fill(self, wanted: np.ndarray) -> None:
        """Steps (state * width + class) that the table does not have yet."""
        weight = np.cumsum([len(self.states[w // self.width]) + 1 for w in wanted.tolist()])
        for part in np.split(wanted, np.searchsorted(weight, np.arange(BATCH, weight[-1], BATCH), "right")):
            if not len(part):
                continue
            state, c = part // self.width, part % self.width
            sets = [self.states[i] for i in state.tolist()]
            coded = np.concatenate(sets).astype(np.int64)
            pair = np.repeat(np.arange(len(part)), [len(x) for x in sets])
            node, edits = coded >> 2, coded & 3
            p, child, e = self._children(pair, node, edits)
            e = e + (self.letter[child] != c[p])
            on, stay = e <= self.most[child], edits + 1 <= self.most[node]
            pair, node, edits = self._closed(np.concatenate([p[on], pair[stay]]), np.concatenate([child[on], node[stay]]), np.concatenate([e[on], edits[stay] + 1]))
            bounds = np.searchsorted(pair, np.arange(len(part) + 1))
            after = [self._number((node[i:j], edits[i:j])) for i, j in itertools.pairwise(bounds.tolist())]
            self.table[state, c] = after

    @property
    def classes(self) -> np.ndarray:
        """The class of each code point: 0 no letter, OTHER in no term."""
        if not self.ready:
            self._prepare()
        return self._classes

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words (numbers), terms and edits of all hits among the words codes[starts:ends]."""
        if not self.ready:
            self._prepare()
        found = []
        for low in range(0, len(starts), WORDS):
            if self.bytes > MEMORY:
                self._forget()
            found.append(self._some(codes, starts[low:low + WORDS], ends[low:low + WORDS], low))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def _some(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        state = np.ones(len(starts), np.int32)
        done = np.zeros(len(starts), np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            now, c = state[live], codes[at]
            after = self.table[now, c]
            missing = after < 0
            if missing.any():
                self._fill(np.unique(now[missing].astype(np.int64) * self.width + c[missing]))
                after = self.table[now, c]
            state[live] = after
            at = at + 1
            over = at >= ends[live]
            done[live[over]] = after[over]
            on = ~over & (after > 0)
            live, at = live[on], at[on]
        hit = np.flatnonzero(self.term[done] >= 0)
        return hit + low, self.term[done[hit]], self.edits[done[hit]]


class Lexicon:
    """Terms with weights, and their automaton; ``features`` are what the model sees of a text."""

    def __init__(self, weights: dict[str, float]):
        self.terms = sorted(weights)
        self.weights = np.array([weights[t] for t in self.terms])
        self.automaton = Automaton(self.terms)

    def features(self, values: list[str]) -> np.ndarray:
        lowered = [t.lower() for t in values]
        points = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.automaton.classes[points]
        inside = np.concatenate([[False], codes > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        bounds = np.cumsum([0] + [len(t) + 1 for t in lowered])
        first = np.searchsorted(starts, bounds)
        hit, term, edits = self.automaton.run(codes, starts, ends)
        owner = np.searchsorted(first, hit, "right") - 1
        out = np.zeros((len(values), FEATURES))
        out[:, 0] = 1
        out[:, 9] = np.log1p(np.diff(first))
        by_text = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(np.arange(len(hit)), by_text) if len(hit) else []:
            doc = owner[part[0]]
            text, base = lowered[doc], bounds[doc]
            low, high = first[doc], first[doc + 1]
            exact = fuzzy = quoted = person = together = 0.0
            best = 0.0
            close = np.diff(hit[part]) <= WINDOW  # hits ascend: the nearest other hit stands beside in the array
            close = np.concatenate([[False], close]) | np.concatenate([close, [False]])
            for i, beside in zip(part, close):
                w = hit[i]
                a, b = max(low, w - WINDOW), min(high, w + WINDOW + 1)
                near = text[starts[a] - base:ends[b - 1] - base]
                around = set(near.split())
                begin, end = starts[w] - base, ends[w] - base
                in_quotes = QUOTES.intersection(text[max(0, begin - 1):begin]) and QUOTES.intersection(text[end:end + 2])
                weight = self.weights[term[i]] / (1 + edits[i])
                best = max(best, weight)
                if in_quotes or (not REPORTING.isdisjoint(around) and not QUOTES.isdisjoint(near)):
                    quoted += weight
                elif edits[i]:
                    fuzzy += weight
                else:
                    exact += weight
                person += not SECOND_PERSON.isdisjoint(around)
                together += beside
            out[doc, 1:9] = np.log1p([exact, fuzzy, quoted, person, together, 100 * len(part) / max(1, high - low), best, len(part)])
            out[doc, 10], out[doc, 11] = exact > 0, fuzzy > 0
        return out


def lexicon(counts: list[tuple[str, int, int]], toxic: int, other: int) -> Lexicon:
    """From (word, toxic documents, other documents): words whose log ratio is clearly above ``LEAST``, and the seeds."""
    weights = {w: SEED_WEIGHT for w in SEEDS}
    for word, t, o in counts:
        if t >= SUPPORT:
            ratio = np.log((t + 0.5) / (toxic + 1)) - np.log((o + 0.5) / (other + 1))
            if ratio - ERRORS * np.sqrt(1 / t + 1 / (o + 1)) >= LEAST:
                weights[word] = float(ratio)
    return Lexicon(weights)


class Model:
    """Lexicon, and weights of a logistic model over its features."""

    def __init__(self, words: Lexicon, x: np.ndarray, y: np.ndarray):
        self.lexicon = words
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.mean[0], self.scale[0] = 0, 1
        z = (x - self.mean) / self.scale
        self.beta = np.zeros(FEATURES)
        self.beta[0] = -2
        for _ in range(25 if len(x) else 0):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            ridge = np.full(FEATURES, 1.0)
            ridge[0] = 1e-3
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-8:
                break

    def score(self, values: list[str]) -> np.ndarray:
        z = (self.lexicon.features(values) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))


def _words(text: str) -> set[str]:
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows, chosen by a hash of the id.

    The model's features of each half of the sample come from a lexicon of the other half, so that words that are in the
    lexicon by chance don't look better than they are.  Of sampled documents that share the smallest hash of their
    three-word shingles (copies, mostly) and the label, one is learned from: words of a copied document are no evidence of their own.  Rows with a null id or label, and ids that are not in ``docs``,
    play no part.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
              .groupBy("doc_id").agg((F.max("label") >= 0.5).cast("int").alias("label")))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = chosen.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def shown(batch: pa.RecordBatch) -> dict:
        copy = [min(shingle_hashes(t, 3), default=0) >> 1 for t in batch.column(1).to_pylist()]
        return {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | {"copy": copy}

    half = (F.xxhash64(F.col("doc_id") + 1) % 2 == 0).cast("int").alias("half")
    sampled = store(map_texts(texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label", half), shown,
                              "doc_id long, text string, label int, half int, copy long"))
    first = sampled.groupBy("copy", "label").agg(F.min("doc_id").alias("doc_id"))
    rows = store(sampled.join(first, ["copy", "label", "doc_id"]).select("doc_id", "text", "label", "half"))
    size = {(r.half, r.label): r.n for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}

    def count(batch: pa.RecordBatch) -> dict:
        counts = Counter()
        for text, y, half in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            counts.update((w, y, half) for w in _words(text))
        keys = list(counts)
        return {"word": [k[0] for k in keys], "label": [k[1] for k in keys], "half": [k[2] for k in keys], "n": list(counts.values())}

    n = lambda y, half: F.sum(F.when((F.col("label") == y) & (F.col("half") == half), F.col("n")).otherwise(0)).alias(f"n{y}{half}")
    table = (map_texts(rows, count, "word string, label int, half int, n long").groupBy("word").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))
             .where(f"n10 + n11 >= {SUPPORT} and 3 * (n10 + n11) * {1 + size.get((0, 0), 0) + size.get((0, 1), 0)} > (n00 + n01) * {1 + size.get((1, 0), 0) + size.get((1, 1), 0)}").collect())

    def make(halves: tuple[int, ...]) -> Lexicon:
        return lexicon([(r.word, sum(r[f"n1{h}"] for h in halves), sum(r[f"n0{h}"] for h in halves)) for r in table],
                       sum(size.get((h, 1), 0) for h in halves), sum(size.get((h, 0), 0) for h in halves))

    crossed = docs.sparkSession.sparkContext.broadcast({0: make((1,)), 1: make((0,))})

    def see(batch: pa.RecordBatch) -> dict:
        values, halves = batch.column(1).to_pylist(), np.array(batch.column(3).to_pylist())
        x = np.zeros((len(values), FEATURES))
        for half, words in crossed.value.items():
            at = np.flatnonzero(halves == half)
            x[at] = words.features([values[i] for i in at])
        return {"label": batch.column(2), "x": [row.tobytes() for row in x]}

    seen = map_texts(rows, see, "label int, x binary").collect()  # <= sample rows of 12 numbers
    seen.sort(key=lambda r: (r.label, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x) for r in seen]) if seen else np.empty((0, FEATURES))
    return Model(make((0, 1)), x, np.array([r.label for r in seen], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text.

    Null and empty texts are scored as texts without a hit.  Rows that repeat a doc_id are scored each.  Empty table: no
    rows; without labels only the seeds' lexicon and no weight but the starting one is there (all scores equal).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": shared.value.score(batch.column(1).to_pylist())}

    return map_texts(texts(docs), run, "doc_id long, score double")


def training_labels(labels: DataFrame, divisor: int, held_out: int) -> DataFrame:
    return labels.where(remainder("doc_id", divisor) != held_out)
