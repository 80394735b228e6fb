"""Prefix trie of conversations over range-partitioned paths, with the trie of the splitters as its skeleton.

A conversation's path is the sequence of its turns' 128-bit digests.  Paths are sampled in proportion to their length and
quantiles of the sample split them, ties by conv_id, into shards: a group of equal conversations may run over many shards.
The trie of the splitter paths is broadcast.  A node off it has all its members in one shard, because paths with a common
prefix stand together, so the shard's sorted stream finishes it; of a node on it (the skeleton) every shard gives partial
aggregates, which are summed up, and then added up from the leaves of the skeleton to its root.
"""
from __future__ import annotations

import hashlib
import itertools
import math
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow, map_texts, pieces
from precinct.session import broadcast_if_small, store

DIGEST = 16  # bytes of a turn in a path
WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEADS = 20, 4  # a conversation starts like the first one of its twenty, by 0 to 3 turns
SHARD_BYTES = 64 << 20  # paths of a shard, about
PER_SHARD = 8  # sampled paths a shard
CHUNK = 1 << 20  # bytes of joined ids handed on at once

LOCAL = ("skeleton int, conv_id long, depth long, parent int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, words long, shard int, chunk int, ids binary")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (binary), words (array): every conversation as rebuilt from its own turns and its family's first one.

    Turns are ordered by turn (null first), equal ones by role and digest.  One record per conversation: 16 bytes and a
    number a turn, no texts.  Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    conv = F.col("conv_id").cast("long")
    turns = conversations.select(conv.alias("conv_id"), (conv - conv % FAMILY).alias("head"), F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t")).where("conv_id is not null").repartition("head")
    own = turns.groupBy("head", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = F.first(F.when(F.col("conv_id") == F.col("head"), F.slice("turns", 1, HEADS - 1)), ignorenulls=True).over(Window.partitionBy("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    made = own.withColumns({"first": first, "h": taken}).select("conv_id", F.expr(
        "concat(slice(coalesce(first, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, size(turns)))").alias("t"))
    return made.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t.digest), "")).alias("path"), F.transform("t", lambda t: t.words).alias("words"))


def splitters(records: DataFrame, shards: int | None = None) -> list[tuple[bytes, int]]:
    """Keys (path, conv_id) at which shards begin; the driver sees about PER_SHARD paths a shard."""
    weight = F.octet_length("path") + DIGEST
    total = records.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first().n
    shards = shards or max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD_BYTES))
    step = max(1.0, total / (shards * PER_SHARD))
    chance = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 52)) / float(1 << 52)
    drawn = sorted(records.where(chance < weight / step).select("path", "conv_id", F.greatest(weight, F.lit(step)).alias("w")).collect())
    sums = list(itertools.accumulate(r["w"] for r in drawn))
    return sorted({(bytes(drawn[at]["path"]), drawn[at]["conv_id"]) for i in range(1, shards) if drawn and (at := bisect_right(sums, sums[-1] * i / shards)) < len(drawn)})


class Skeleton:
    """Trie of the splitter paths: nodes numbered from the root 0, children after their parents."""

    def __init__(self, paths):
        self.parents, self.depths, self.below = [-1], [0], {}
        for path in paths:
            node = 0
            for d in range(0, len(path), DIGEST):
                step = node, path[d:d + DIGEST]
                if step not in self.below:
                    self.below[step] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                node = self.below[step]


class _Node:
    """A node on the current path; ``number`` is its place in the skeleton or None."""

    __slots__ = ("number", "depth", "words", "low", "n", "children", "leaves", "saved", "hash", "ids", "chunks", "waiting")

    def __init__(self, number, depth, words):
        self.number, self.depth, self.words = number, depth, words
        self.low, self.n, self.children, self.leaves, self.saved, self.chunks = None, 0, 0, 0, 0, 0
        self.hash, self.ids, self.waiting = None, None, []

    def count(self, low, n):
        self.low = low if self.low is None or low < self.low else self.low
        self.n += n


class _Shard:
    """Takes one shard's conversations in the order of their paths; ``rows`` gathers what is known."""

    def __init__(self, number: int, skeleton: Skeleton, rows: list):
        self.number, self.skeleton, self.rows, self.path, self.stack = number, skeleton, rows, b"", [_Node(0, 0, 0)]

    def _chunk(self, node):
        if node.ids:
            self.rows.append((node.number, None, None, None, None, None, None, None, None, None, None, self.number, node.chunks, bytes(node.ids)))
            node.chunks, node.ids = node.chunks + 1, bytearray()

    def _pop(self):
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if above:
            above.count(node.low, node.n)
        if node.number is not None:
            self._chunk(node)
            self.rows.append((node.number, node.low, node.depth, None, None, node.n, node.children, node.leaves, node.saved, None, node.words, self.number, None, None))
            return
        leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.words
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        ends = (node.hash or hashlib.sha256()).hexdigest()
        mine = (node.low, node.depth, node.n, node.children, leaves, saved, ends)
        self.rows += [self._row(c, None, node.low) for c in node.waiting]
        if above.number is None:
            above.waiting.append(mine)  # until the smallest member of the parent is known
        else:
            self.rows.append(self._row(mine, above.number, None))

    @staticmethod
    def _row(node, parent, parent_conv):
        low, depth, n, children, leaves, saved, ends = node
        return None, low, depth, parent, parent_conv, n, children, leaves, saved, ends, None, None, None, None

    def take(self, conv_id: int, path: bytes, words: list[int]):
        last, same, most = self.path, 0, min(len(path), len(self.path))
        if path == last:
            same = most
        else:
            while same < most and path[same:same + DIGEST] == last[same:same + DIGEST]:
                same += DIGEST
        while len(self.stack) - 1 > same // DIGEST:
            self._pop()
        for d in range(same, len(path), DIGEST):
            number = self.stack[-1].number
            self.stack.append(_Node(None if number is None else self.skeleton.below.get((number, path[d:d + DIGEST])), d // DIGEST + 1, words[d // DIGEST]))
        node, name = self.stack[-1], str(conv_id).encode()
        node.count(conv_id, 1)
        if node.number is None:
            node.hash = node.hash or hashlib.sha256()
            node.hash.update(b"," + name if node.n > 1 else name)
        else:
            node.ids = bytearray() if node.ids is None else node.ids
            node.ids += b"," + name
            if len(node.ids) >= CHUNK:
                self._chunk(node)
        self.path = path

    def end(self):
        while self.stack:
            self._pop()


def _local(skeleton):
    """Rows of LOCAL from sorted shards: finished nodes (no ``skeleton``), partial aggregates and chunks of joined ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(LOCAL))

    def run(batches):
        rows: list[tuple] = []
        now = None

        def out():
            made = [pa.array(values, type=f.type) for values, f in zip(zip(*rows), arrow)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for batch in batches:
            for part in pieces(batch, "path"):
                for number, conv_id, path, words in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if now is None or now.number != number:
                        if now:
                            now.end()
                        now = _Shard(number, skeleton.value, rows)
                    now.take(conv_id, path, words)
                    if len(rows) >= 8192:
                        yield out()
        if now:
            now.end()
        if rows:
            yield out()

    return run


def _hashed(batches):
    """The SHA-256 of each skeleton node's chunks, which come in order and carry a comma in front of every id."""
    node, h = None, None
    schema = pa.schema([("skeleton", pa.int32()), ("ends_sha256", pa.string())])

    def done():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([h.hexdigest()])], schema=schema)

    for batch in batches:
        for number, ids in zip(batch.column(0).to_pylist(), batch.column(3)):
            data = ids.as_py()
            if number != node:
                if h:
                    yield done()
                node, h, data = number, hashlib.sha256(), data[1:]
            h.update(data)
    if h:
        yield done()


def _added_up(skeleton: Skeleton, partial: list) -> list[tuple]:
    """Whole aggregates of the skeleton's nodes: each takes what its children on the skeleton have, the last ones first."""
    own = {r["skeleton"]: r for r in partial}
    children, leaves, saved = ({k: r[c] for k, r in own.items()} for c in ("n_children", "n_leaves", "saved_tokens"))
    for k in sorted(own, reverse=True):
        saved[k] += (own[k]["n_convs"] - 1) * own[k]["words"]
        leaves[k] = leaves[k] if children[k] else 1
        if k:
            up = skeleton.parents[k]
            children[up], leaves[up], saved[up] = children[up] + 1, leaves[up] + leaves[k], saved[up] + saved[k]
    return [(k, r["conv_id"], skeleton.depths[k], own[skeleton.parents[k]]["conv_id"] if k else None, r["n_convs"], children[k], leaves[k], saved[k])
            for k, r in own.items()]


def prefix_nodes(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; rows without a conv_id play no part; rows that repeat a turn are turns of their own;
    columns other than conv_id, turn, role and text play no part.  An empty table has no node.  What one task holds is the
    current path and the nodes that wait for their parent; what the driver holds is the skeleton, at most one path a shard.
    """
    spark = conversations.sparkSession
    records = store(rebuilt(conversations))
    cuts = splitters(records, shards)
    skeleton = Skeleton(path for path, _ in cuts)
    spark_cuts, spark_skeleton = spark.sparkContext.broadcast(cuts), spark.sparkContext.broadcast(skeleton)

    def numbered(batch: pa.RecordBatch) -> dict:
        keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
        return {"shard": [bisect_right(spark_cuts.value, k) for k in keys], "conv_id": batch.column(0), "path": batch.column(1), "words": batch.column(2)}

    dealt = map_texts(records, numbered, "shard int, conv_id long, path binary, words array<int>", column="path")
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = store(map_arrow(ordered, _local(spark_skeleton), LOCAL))

    partial = found.where("skeleton is not null and ids is null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    whole = _added_up(skeleton, partial.collect())
    top = spark.createDataFrame(whole, "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    chunks = found.where("ids is not null").select("skeleton", "shard", "chunk", "ids").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "chunk")
    ends = map_arrow(chunks, _hashed, "skeleton int, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.lit(hashlib.sha256().hexdigest())
    upper = top.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).select(columns)
    above = broadcast_if_small(top.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("above")), rows=len(whole))
    lower = found.where("skeleton is null").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")).select(columns)
    return upper.unionByName(lower)
