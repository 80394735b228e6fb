"""Token ids in flat binary files.

A folder of token files holds, per part: ``part-N.ids`` (little-endian unsigned ids, 16 bits where the vocabulary
allows it, else 32), ``part-N.off`` (64-bit starts of the documents within the part, and its end) and ``part-N.doc``
(64-bit document ids; documents without an id come first).  ``manifest`` is a Parquet table with one row per part and
the part's base, the prefix sum of what the parts before it hold.  Parts are in ascending order of document id.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.llm.common import file_system, map_arrow, pieces, texts

# How byte-level BPE files of this family cut a text before merging.  Written for Python's ``re``; it
# differs from the tokenizer's own classes only on the characters in ODD, and texts that hold one go to the tokenizer whole.
CUT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]")
CACHE_ENTRIES = 600_000


class Encoder:
    """Encodes texts to bytes of ids with the tokenizers library.

    The merging of a repeated word is done once: words already seen come from a bounded table.  This holds for
    byte-level BPE files that cut at words; with any other file each text is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        cut = known.get("pre_tokenizer") or {}
        self.by_word = (known["model"].get("type", "BPE") == "BPE" and cut.get("type") == "ByteLevel" and not known.get("normalizer")
                        and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not known["model"].get("ignore_merges"))
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.known = _Words(self)

    def word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, CUT.findall(text)))


class _Words(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word)
        if len(self) < CACHE_ENTRIES and len(word) < 64:
            self[word] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write the ids of all texts of ``docs`` (doc_id, text) into ``folder``; returns the manifest.

    Texts are dealt by ranges of doc_id and sorted within a range, so a part is one task's work and no task sees more
    than its range.  A part is written under a name of its attempt and then moved to its final name: a task that runs
    again after a lost executor replaces the part by an equal one.  Null text: empty.  Rows that repeat a doc_id are
    kept, in the order of their texts.  Null doc_id: sorted first and read back as null.  Empty table: no parts.
    """
    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterable[pa.RecordBatch]):
        code, task = encoder(tokenizer), TaskContext.get()
        end = b"" if end_id is None else np.array([end_id], code.dtype).tobytes()
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}"
        trial = f"{path}/.{name}-{task.taskAttemptId()}"
        starts, ids, no_id, total = [0], [], 0, 0
        with fs.open_output_stream(trial + ".ids") as out:
            for batch in batches:
                for part in pieces(batch):
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        coded = code.encode(text) + end
                        out.write(coded)
                        total += len(coded) // code.dtype.itemsize
                        starts.append(total)
                        ids.append(0 if key is None else key)
                        no_id += key is None
        for kind, values in (("off", starts), ("doc", ids)):
            with fs.open_output_stream(f"{trial}.{kind}") as out:
                out.write(np.array(values, "<i8").tobytes())
        for kind in ("ids", "off", "doc"):
            fs.move(f"{trial}.{kind}", f"{path}/{name}.{kind}")
        if ids:
            yield pa.RecordBatch.from_pydict({
                "part": [task.partitionId()], "file": [name], "width": pa.array([code.dtype.itemsize], pa.int32()),
                "docs": [len(ids)], "tokens": [total], "without_id": [no_id]})

    written = map_arrow(ordered, write, "part long, file string, width int, docs long, tokens long, without_id long")
    rows = sorted(written.collect())  # one row per part
    bases = np.cumsum([[0, 0], *([r.docs, r.tokens] for r in rows)], axis=0).tolist()
    manifest = spark.createDataFrame(
        [(r.part, r.file, r.width, r.docs, r.tokens, r.without_id, *bases[i]) for i, r in enumerate(rows)],
        "part long, file string, width int, docs long, tokens long, without_id long, doc_base long, token_base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def open_part(folder: str, file: str, kind: str, dtype: str) -> np.ndarray:
    """The values of one file: mapped into memory where the folder is mounted, else read."""
    fs, path = file_system(folder)
    name = f"{path}/{file}.{kind}"
    if fs.type_name == "local":
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
    with fs.open_input_file(name) as source:
        return np.frombuffer(source.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers; ``with_ids`` adds the ids themselves in
    that form.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                ids = open_part(folder, row["file"], "ids", f"<u{row['width']}")
                starts, docs = (open_part(folder, row["file"], kind, "<i8") for kind in ("off", "doc"))
                for first in range(0, row["docs"], 2000):
                    last = min(first + 2000, row["docs"])
                    at = [ids[starts[i]:starts[i + 1]].astype("<u4") for i in range(first, last)]
                    out = {"doc_id": [None if i < row["without_id"] else int(docs[i]) for i in range(first, last)],
                           "start": (starts[first:last] + row["token_base"]).tolist(), "n_tokens": [len(x) for x in at],
                           "ids_crc32": [zlib.crc32(x.tobytes()) for x in at]}
                    if with_ids:
                        out["ids"] = [x.tobytes() for x in at]
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                        + [("ids", pa.binary())] * with_ids))

    return map_arrow(manifest.select("file", "width", "docs", "without_id", "token_base").repartition(max(1, parts)), read, schema)
