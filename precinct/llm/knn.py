"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

A text becomes counts of three kinds: runs of three character classes, words by hash, and steps of a few shares
(repeated words, different words, number of words).  A truncated singular value decomposition of the labelled sample's
weighted counts gives the latent space.  The labelled vectors (at most ``Neighbours.SAMPLE`` rows of ``Neighbours.DIMENSIONS`` numbers,
about 1 MB) and the projection (about 2 MB) go to every task; each document's cosine with every labelled vector is computed in blocks
of documents, and its nearest neighbours vote with weights that rise with similarity.
"""
from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow, map_texts, pieces, remainder, texts

SHAPES, WORDS, STEPS = 4096, 4096, 40
TERMS = SHAPES + WORDS + STEPS
BLOCK = 256  # documents whose products are held at once


def _classes() -> np.ndarray:
    table = np.full(256, 9, np.uint8)  # 9: other control
    for i, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".,;:",
                               b"!?", b"#*$%&|<>=~^+\\_@", b"'\"()[]{}-/`"]):
        table[list(chars)] = i
    table[0xC0:] = 10  # first byte of a longer character
    table[0x80:0xC0] = 11
    return table


CLASSES = _classes()


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of a text's terms; none for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    c = CLASSES[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.int32)
    shape = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=SHAPES)
    n = len(words)
    hashed = np.bincount(np.fromiter(map(zlib.crc32, raw.lower().split()), np.int64, n) % WORDS, minlength=WORDS)
    same = sum(itertools.starmap(bytes.__eq__, itertools.pairwise(words))) / n
    distinct = len(set(words)) / n
    steps = np.zeros(STEPS)
    steps[int(same * 11.99)] = steps[12 + int(distinct * 11.99)] = steps[24 + min(15, n.bit_length())] = 1
    counts = np.concatenate([shape, hashed, steps])
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def dense(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    rows = np.zeros((len(found), TERMS), np.float32)
    for row, (at, counts) in zip(rows, found):
        row[at] = np.log1p(counts)
    return rows


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Neighbours:
    """The fitted classifier: term weights, projection, labelled vectors and their labels."""

    SAMPLE = 4096  # labelled rows used at most: the bound of the fit and of what is broadcast
    DIMENSIONS = 48
    NEAREST = 25
    POWER = 8

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        """``found`` holds each labelled text's term indices and counts; only BLOCK of them are spread out at a time."""
        n = len(found)
        there = np.bincount(np.concatenate([at for at, _ in found]), minlength=TERMS) if n else np.zeros(TERMS)
        self.weights = np.where(there > 0, np.log((n + 1) / (there + 0.5)), 0).astype(np.float32)
        self.weights[there < 2] = 0
        self.labels = np.asarray(labels, np.float32)
        self.prior = float(self.labels.mean()) if n else 0.5
        d = min(self.DIMENSIONS, n)
        basis = np.random.default_rng(0).standard_normal((TERMS, min(n, d + 16))).astype(np.float32)
        for _ in range(5):  # subspace iteration
            product = np.zeros_like(basis)
            for x in self._blocks(found):
                product += x.T @ (x @ basis)
            basis = np.linalg.qr(product)[0] if n else basis
        _, _, v = np.linalg.svd(self._projected(found, basis), full_matrices=False) if n else (0, 0, np.zeros((0, 0)))
        self.projection = np.ascontiguousarray(basis @ v[:d].T, dtype=np.float32)
        self.vectors = _unit(self._projected(found, self.projection))

    def _blocks(self, found):
        for first in range(0, len(found), BLOCK):
            yield self._weigh(dense(found[first:first + BLOCK]))

    def _projected(self, found, basis: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ basis for x in self._blocks(found)]) if found else np.zeros((0, basis.shape[1]), np.float32)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.weights
        for part, scale in ((slice(0, SHAPES), 1.0), (slice(SHAPES, SHAPES + WORDS), 0.5), (slice(SHAPES + WORDS, TERMS), 0.7)):
            x[:, part] = _unit(x[:, part]) * scale
        return x

    def score(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(found), self.prior)
        if not len(self.labels):
            return out
        k = min(self.NEAREST, len(self.labels))
        for first in range(0, len(found), BLOCK):
            part = found[first:first + BLOCK]
            cosine = _unit(self._weigh(dense(part)) @ self.projection) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** self.POWER
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) + 1e-6 * self.prior
            known = np.array([len(at) > 0 for at, _ in part])
            out[first:first + BLOCK] = np.where(known, vote / (total + 1e-6), self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = Neighbours.SAMPLE) -> Neighbours:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, ``label`` 0 or 1), chosen by a hash of the id.

    Rows with a null id or label, and ids that are not in ``docs``, play no part; of an id labelled more than once the
    larger label counts; of repeated rows of a document any one is used.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
              .groupBy("doc_id").agg(F.max("label").alias("label")))

    def count(batch: pa.RecordBatch) -> dict:
        found = [term_counts(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "label": batch.column(2), "at": [a.tobytes() for a, _ in found], "counts": [c.tobytes() for _, c in found]}

    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = chosen.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    counted = map_texts(known, count, "doc_id long, label double, at binary, counts binary").dropDuplicates(["doc_id"])
    rows = counted.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # <= sample rows
    found = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows]
    return Neighbours(found, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text.

    Null and empty texts, and texts of white space, get the share of label 1 among the labelled rows.  Rows that repeat a
    doc_id are scored each.  Empty table: no rows; without any labelled row all scores are 0.5.
    """
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": model.score([term_counts(t) for t in batch.column(1).to_pylist()])}

    return map_texts(texts(docs), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Neighbours, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""
    fields = docs.schema
    at = fields.names.index("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                values = ["" if t is None else t for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.score([term_counts(t) for t in values]) >= least))

    return map_arrow(docs, run, fields)


def training_labels(labels: DataFrame, divisor: int, held_out: int) -> DataFrame:
    return labels.where(remainder("doc_id", divisor) != held_out)
