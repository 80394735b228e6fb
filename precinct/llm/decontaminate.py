"""Finds documents that hold passages of a benchmark, by spaced-seed hashing.

A seed is a fixed mask over a run of words: the words at its selected positions are hashed, those at the others ignored,
so a hit survives substituted words at ignored positions.  Hashes of all runs of the benchmark are joined with those of all
runs of the documents; around each hit the two texts are laid side by side and words compared, and a window of ``window``
words with at least ``least`` of them equal is an overlap.

The masks catch every such window: whatever (up to a fifth) of 20 words are substituted, some mask meets no substituted
word at some place (tested over all choices).  Items shorter than the window are compared whole; those too short for
the longest mask also have a mask of their own length, and those of five to seven words, which may have one word
substituted, masks that leave out one position each.
"""
from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow, map_texts, pieces, texts

# Fixed masks: positions that count, within runs of words.
MASKS = [(0, 1, 3, 4, 5, 6), (0, 1, 2, 4, 7, 8), (0, 1, 5, 6, 8, 13)]
SHORT_MASKS = [(0, 1, 3, 4, 5), (0, 1, 5, 6, 7), (0, 1, 2, 3, 5)]  # more for items shorter than the window
WINDOW, SHARE = 20, 0.8
BLOCK_WORDS = 2_000_000  # benchmark words held by a task at once; a larger benchmark is taken in several blocks
MANY = 1 << 18  # pairs of equal hashes of a document beyond which those of repeated words are taken together
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0x85EBCA77C2B2AE63], np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z lower-cased, without punctuation at their ends; words of punctuation alone vanish."""
    found = [w.strip(PUNCTUATION) for w in text.encode("utf-8", "surrogatepass").lower().split()]
    return [w for w in found if w]


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Block:
    """Items of a benchmark with their hash index: sorted hashes, and item and position of each."""

    ids: list = field(default_factory=list)
    words: list = field(default_factory=list)  # arrays of word numbers

    def build(self, items: list[tuple[int, list[bytes]]]) -> "Block":
        self.vocabulary: dict[bytes, int] = {}
        for key, item in items:
            self.ids.append(key)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item], np.int64))
        lengths = sorted({len(w) for w in self.words if len(w)})
        # Each mask with the lengths of the items it is for.
        self.masks = [(m, (1, None)) for m in MASKS] + [(m, (1, WINDOW)) for m in SHORT_MASKS if lengths and lengths[0] < WINDOW]
        self.masks += [(m, (n, n + 1)) for n in lengths for m in own_masks(n)]
        hashes, places = [], []
        for number, w in enumerate(self.words):
            for i, (m, (least, below)) in enumerate(self.masks):
                if len(w) < least or below and len(w) >= below:
                    continue
                h = seed_hashes(w, m, i)
                hashes.append(h)
                places.append(np.stack([np.full(len(h), number), np.arange(len(h))], axis=1))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.places = np.concatenate(places) if places else np.empty((0, 2), np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]
        self.bits = max(16, int(8 * len(self.hashes)).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)  # a first look before the search in the sorted hashes
        self.filter[self.hashes >> np.uint64(64 - self.bits)] = True
        return self

    def hits(self, w: np.ndarray) -> np.ndarray:
        """Rows (item, shift): at ``shift`` of the document the item's first word would stand."""
        found = []
        for i, (m, _) in enumerate(self.masks):
            h = seed_hashes(w, m, i)
            at = np.flatnonzero(self.filter[h >> np.uint64(64 - self.bits)])
            if not len(at):
                continue
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            n = high - low
            if n.sum() > MANY:
                # Repeated words: a hash that stands in many places of both sides has few shifts for its many pairs.
                hot = np.flatnonzero(n > 0)
                order = hot[np.argsort(low[hot], kind="stable")]
                for group in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
                    pairs = n[group[0]] * len(group)
                    if pairs > MANY // 64:
                        found += self._shifts(at[group], self.places[low[group[0]]:high[group[0]]], len(w))
                        n[group] = 0
            if n.any():
                doc = np.repeat(at, n)
                index = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                item, position = self.places[index].T
                found.append(np.unique(np.stack([item, doc - position], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def _shifts(self, doc: np.ndarray, places: np.ndarray, size: int) -> list[np.ndarray]:
        """The different shifts of all pairs of a place in the document and one in an item, without making the pairs."""
        out = []
        for part in np.split(places, np.flatnonzero(np.diff(places[:, 0])) + 1):  # places of one hash stand item by item
            item, own = part[0, 0], part[:, 1]
            reach = len(self.words[item])
            if len(doc) * len(own) <= size + reach:
                there = np.zeros(size + reach, bool)
                there[np.subtract.outer(doc, own).ravel() + reach] = True
            elif len(own) <= 64:
                there = np.zeros(size + reach, bool)
                for q in own:
                    there[doc - q + reach] = True
            else:
                a, b = np.zeros(size), np.zeros(reach)
                a[doc], b[reach - 1 - own] = 1, 1
                length = 1 << (size + reach - 1).bit_length()
                sums = np.fft.irfft(np.fft.rfft(a, length) * np.fft.rfft(b, length), length)[:size + reach - 1]
                there = np.concatenate([[False], sums > 0.5])
            shifts = np.flatnonzero(there) - reach
            out.append(np.stack([np.full(len(shifts), item), shifts], axis=1))
        return out

    def overlaps(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, equal words, start, end): each item's best window in the text, in words of the document."""
        get = self.vocabulary.get
        found = words_of(text)
        w = np.fromiter((get(x, 0) for x in found), np.int64, len(found))
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in self.hits(w).tolist():
            own = self.words[item]
            if item in best and best[item][0] == min(WINDOW, len(own)):
                continue  # nothing is better than a window without a substituted word
            low, high = max(0, shift), min(len(w), shift + len(own))
            equal = w[low:high] == own[low - shift:high - shift]
            size = min(WINDOW, len(own))
            if len(equal) < size:
                continue
            total = np.concatenate([[0], np.cumsum(equal)])
            sums = total[size:] - total[:-size]
            at = int(sums.argmax())
            if sums[at] >= np.ceil(SHARE * size) and (item not in best or sums[at] > best[item][0]):
                best[item] = (int(sums[at]), low + at, low + at + size)
        return [(item, *value) for item, value in sorted(best.items())]


def own_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` words alone: all of them, and for five to seven words all but one."""
    if n > max(MASKS[-1]):
        return []
    whole = tuple(range(n))
    left_out = [whole[:p] + whole[p + 1:] for p in range(1, n - 1)] + [whole[:-1]] if 5 <= n <= 7 else []
    return [whole, *left_out]


def seed_hashes(w: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """A hash for each place where the mask fits; places with a word unknown to the benchmark can't match and still get one."""
    n = len(w) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    values = w.astype(np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for k, p in enumerate(mask):
        h = (h ^ values[p:p + n]) * MULTIPLIERS[k % len(MULTIPLIERS)]
        h ^= h >> np.uint64(29)
    return h


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The benchmark in blocks of at most BLOCK_WORDS words (or one item), read one partition at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).toLocalIterator()
    held, size = [], 0
    for row in rows:
        w = words_of(row.text)
        if held and size + len(w) > BLOCK_WORDS:
            yield Block().build(held)
            held, size = [], 0
        if w:
            held.append((row.item, w))
            size += len(w)
    if held:
        yield Block().build(held)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, n_equal, first_word, end_word.

    ``n_equal`` words of the best window (first_word to end_word of the document, end exclusive) are the item's.  Null and
    empty texts have no overlap, nor have null and empty items.  Rows that repeat a doc_id or an item_id give rows of
    their own.  Empty tables: no rows.  The documents are read once per block of the benchmark.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_equal long, first_word long, end_word long"
    out = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            here = shared.value
            rows = [(key, here.ids[i], n, a, b) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, n, a, b in here.overlaps(text)]
            return {name: [r[k] for r in rows] for k, name in enumerate(("doc_id", "item_id", "n_equal", "first_word", "end_word"))}

        part = map_texts(texts(docs), run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps no item; decided row by row, so repeated ids don't matter."""
    fields = docs.schema
    at = fields.names.index("text")
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for part in pieces(batch):
                    yield part.filter(pa.array([not (t and shared.value.overlaps(t)) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = map_arrow(docs, run, fields)
    return docs


def misses(masks=MASKS, window: int = WINDOW, substituted: int = WINDOW - int(np.ceil(SHARE * WINDOW))) -> int:
    """How many choices of substituted words in a window no mask survives."""
    places = [sum(1 << (p + s) for p in m) for m in masks for s in range(window - m[-1])]
    return sum(all(place & bad for place in places) for bad in (sum(1 << p for p in c) for c in itertools.combinations(range(window), substituted)))
