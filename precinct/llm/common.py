"""Helpers shared by the text operators: streaming over whole texts, split columns, shared folders."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Bytes of text that one call of a task's function sees at most, unless a single text is larger.
CHUNK_BYTES = 4 << 20


def texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Id and text alone (a null text is empty), so that other columns, whatever their names, play no part."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds about CHUNK_BYTES of ``column``: long texts don't add up in memory."""
    n, size, first = batch.num_rows, 0, 0
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    for row, length in enumerate(lengths):
        length = length or 0
        if row > first and size + length > CHUNK_BYTES:
            yield batch.slice(first, row - first)
            first, size = row, 0
        size += length
    if first < n:
        yield batch.slice(first, n - first)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path (where driver and workers see the same folder and no copy was shipped)."""
    context = df.sparkSession.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    return df.mapInArrow(function, schema)


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """Apply ``function`` to bounded record batches; it returns the columns of ``schema`` as a dict of lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, column):
                out = function(part)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


def file_system(uri: str):
    """The file system and path of a folder that driver and executors share: a mounted folder, or any store pyarrow knows."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
