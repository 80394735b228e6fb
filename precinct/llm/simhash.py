"""Near-duplicate documents by SimHash, found through an inverted index on the byte positions of fingerprints.

A fingerprint is a 64-bit word.  The index has a list for each choice of byte positions and each value of those bytes; a
fingerprint stands in every list of its own bytes.  Two uses:

* ``linked_groups``: exact.  Fingerprints that differ in at most d bits differ in at most d of the 8 bytes, so
  they share at least 8 - d positional bytes: the guaranteed minimum.  A pair reaches it exactly if it meets in a list of
  8 - d positions, so those are the lists kept (28 for d = 2; lists on one byte alone would hold 1/256 of the corpus
  each, and pairs in them grow with the square of the corpus).  In a list only d bytes are free: it has at most 65,536
  different fingerprints, whatever the corpus, and is worked through by table look-ups, not by all its pairs.  Shared
  bytes of each pair met are tallied, pairs under the minimum dropped, and the bits compared.
* ``similar_groups``: shingle sets of a given similarity, in three steps.  Documents of which too few shingles stand in any other
  document leave: in any common order of all hashes, two sets of similarity s share k of the first n - ceil(s n) + k of each (n:
  the size; the smaller k of the two), so counting these loses no pair.  Then the index above links what is left by fingerprints, which finds
  close copies; each link is verified on the whole sets.  At similarity 0.8 some 15 % of all bits of fingerprints differ, so no number
  of shared bytes is guaranteed, and lists on the shingles' hashes complete the job: rarest shingles first, the first
  n - ceil(s n) + 1 of each set meet every pair.  Each list links its members to a centre, each link is verified on the whole
  sets.  In lists that this leaves in several groups all pairs across the groups are compared by bits: a shingle flips one bit of its
  set's, so two sets differ in as many shingles as in bits at least.  Only pairs that may differ that little become rows and are verified.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow, map_texts, texts
from precinct.llm.components import components
from precinct.session import broadcast_if_small, discard, store

SEED = 42
LANE = np.uint64(0x0101010101010101)
SPARE = 0.3  # of a set's shingles are counted beyond those of which a similar set may have none
LEAST_WORDS, MOST_WORDS = 8, 256  # 64-bit words of a set's parities
BLOCK = 2048  # members of a list that are compared with as many others at a time


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words (A-Z lower-cased, single spaces between); fewer words: of all of them; none: []."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    shifted = [words[i:] for i in range(size)]
    return [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*shifted))]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes of each run; ``starts`` has the start of each run and the end (runs may be empty).

    Bits are summed eight at a time in the bytes of a 64-bit number, over blocks of at most 255 hashes.
    """
    sizes = np.diff(starts)
    result = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    blocks = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[full][owner] + 255 * within
    first = np.cumsum(blocks) - blocks
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANE, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > sizes[full][:, None]).astype(np.uint8)
        result[full] |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(bit)
    return result


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and ``fp``: a little-endian 64-bit word.  A text without words has the fingerprint zero."""

    def run(batch: pa.RecordBatch) -> dict:
        runs = [shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        hashes = np.fromiter(itertools.chain.from_iterable(runs), np.uint64, int(starts[-1]))
        return {"doc_id": batch.column(0), "fp": [row.tobytes() for row in majority(hashes, starts)]}

    return map_texts(texts(docs), run, "doc_id long, fp binary")


def mask(positions: tuple[int, ...]) -> int:
    """A signed 64-bit number with the bytes at ``positions`` set."""
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that two fingerprints share, from their exclusive or (rows of bytes)."""
    return (x == 0).sum(axis=1)


def _links(members: np.ndarray, free: tuple[int, ...], max_bits: int, masks: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (fingerprint, smaller one of its group) in one list: look up each member with every choice of up to d bits changed."""
    n, least = len(members), 8 - max_bits
    if n <= 128:
        a, b = np.triu_indices(n, 1)
    else:
        low = np.zeros(n, np.int64)
        for i, p in enumerate(free):
            low |= (((members >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * i)).astype(np.int64)
        place = np.full(1 << 8 * len(free), -1, np.int64)
        place[low] = np.arange(n)
        a, b = np.repeat(np.arange(n), len(masks)), place[(low[:, None] ^ masks).ravel()]
        a, b = a[b > a], b[b > a]
    x = members[a] ^ members[b]
    kept = tally(x.view(np.uint8).reshape(-1, 8)) >= least
    a, b, x = a[kept], b[kept], x[kept]
    near = np.bitwise_count(x) <= max_bits
    a, b = a[near], b[near]
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(members[i]), int(members[label[i]])) for i in np.flatnonzero(label != np.arange(n))]


def near_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that connect all fingerprints (``fp`` long, distinct) within ``max_bits`` of each other."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3: beyond that the lists get too long")
    choices = list(itertools.combinations(range(8), 8 - max_bits))
    frees = [tuple(p for p in range(8) if p not in c) for c in choices]
    flips = np.array([sum(1 << i for i in c) for k in range(1, max_bits + 1) for c in itertools.combinations(range(8 * max_bits), k)])
    postings = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("list"), F.col("fp").bitwiseAND(F.lit(mask(c))).alias("key")) for i, c in enumerate(choices)])).alias("p"))
    lists = (postings.groupBy("p.list", "p.key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
             .select(F.col("list").cast("int").alias("list"), "members"))

    def verify(batches):
        for batch in batches:
            found = set()
            for free, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.update(_links(np.sort(members.values.to_numpy().view(np.uint64)), frees[free], max_bits, flips))
            a, b = (np.array([p[i] for p in found], np.uint64).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_arrow(lists, verify, "a long, b long").distinct()


def linked_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id reachable.  Equal
    fingerprints are one node, so groups of copies cost one row in the index.  Null and empty texts, and texts of white
    space, have fingerprint zero and are linked like any other.  Rows that repeat a doc_id are nodes of their own with
    equal results.  A null doc_id counts as larger than any other.  Empty table: no rows.
    """
    little = F.reverse(F.regexp_extract_all(F.hex("fp"), F.lit("(..)")))
    stored = store(fingerprints(docs, shingle).select("doc_id", F.lower(F.array_join(little, "")).alias("fingerprint")))
    value = stored.select("doc_id", "fingerprint", _long("fingerprint").alias("fp"))
    nodes = store(value.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(nodes.select("fp"), max_bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return value.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fingerprint", "component_id")


def _long(digits: str):
    """The signed number of 16 hex digits."""
    half = lambda start: F.conv(F.substring(digits, start, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def prefix_size(n: int, similarity: float) -> int:
    """How many shingles of a set of n are looked up: a set of that similarity shares at least one of its own with them."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def probe_size(n: int, similarity: float) -> int:
    """How many shingles of a set of n are counted, in the order of their hashes."""
    return min(n, prefix_size(n, similarity) - 1 + math.ceil(SPARE * n))


def probe_least(n: int, similarity: float) -> int:
    """How many of these a set of that similarity has among its own at least: as many as the smaller one has to spare."""
    m = math.ceil(similarity * n - 1e-9)  # the size of the smaller one at least
    return probe_size(m, similarity) - prefix_size(m, similarity) + 1


def _own(text: str, shingle: int) -> np.ndarray:
    """The set of a text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def probes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, ``key`` (equal for equal shingle sets only), ``size``, ``probe`` (the set's smallest hashes) and ``least`` (see ``probe_least``)."""

    def run(batch: pa.RecordBatch) -> dict:
        own = [_own(t, shingle) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "key": [xxhash.xxh3_128_digest(o.tobytes()) for o in own], "size": [len(o) for o in own],
                "least": [probe_least(len(o), similarity) if len(o) else 0 for o in own],
                "probe": [o[:probe_size(len(o), similarity)].view(np.int64) for o in own]}

    return map_texts(docs, run, "doc_id long, key binary, size int, least int, probe array<long>")


def parities(own: np.ndarray) -> np.ndarray:
    """Bits, each the parity of the number of shingles that fall on it: twice as many bits as shingles, and a power of two.

    A shingle that two sets share flips the same bit in both, so the bits that differ are at most the shingles that do.
    """
    words = min(max(LEAST_WORDS, (1 << (2 * len(own)).bit_length()) // 64), MOST_WORDS)
    odd = np.bincount((own & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def whole_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, ``key`` and ``size`` as in ``probes``, ``fp`` (the fingerprint as a number), ``bits`` (see ``parities``) and ``own``, the whole set."""

    def run(batch: pa.RecordBatch) -> dict:
        runs = [np.array(shingle_hashes(t, shingle), np.uint64) for t in batch.column(1).to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        own = [np.unique(r) for r in runs]
        return {"id": batch.column(0), "key": [xxhash.xxh3_128_digest(o.tobytes()) for o in own], "size": [len(o) for o in own],
                "fp": majority(np.concatenate(runs), starts).view(np.int64), "bits": [parities(o).tobytes() for o in own], "own": [o.view(np.int64) for o in own]}

    return map_texts(docs, run, "id long, key binary, size int, fp long, bits binary, own array<long>")


def _elsewhere(posts: DataFrame) -> DataFrame:
    """The rows of ``posts`` whose token stands in several ids, with ``often``: in how many rows.  The rows are shuffled once.

    The counts read every column, so that both sides of the join are one and the same shuffle.
    """
    placed = posts.repartition("token")
    highs = {c: F.max(c).alias(f"high_{c}") for c in posts.columns if c != "token"}
    often = placed.groupBy("token").agg(F.count("*").cast("int").alias("often"), F.min("id").alias("low_id"), *highs.values())
    often = often.where("low_id < high_id and " + " and ".join(f"high_{c} is not null" for c in highs))
    return placed.join(often.select("token", "often"), "token")


def _able(nodes: DataFrame) -> DataFrame:
    """id and key of the sets of which so many counted shingles stand in other sets too that they can have a similar one.

    Most documents have none: they leave here, before any list is made.  The sets of one id count as one.
    """
    counted = _elsewhere(nodes.select("id", F.explode("probe").alias("token"))).groupBy("id").agg(F.count("*").alias("found"))
    return nodes.select("id", "key", "least").join(counted, "id").where("found >= least").select("id", "key").distinct()


def ordered(sets: DataFrame, similarity: float) -> DataFrame:
    """id, nth, ``first`` (the number of shingles looked up), ``alone`` and ``prefix``: those of them that stand in other sets too.

    The order is by the exact number of sets that a shingle stands in, then by its hash.  The ``alone`` shingles of no other id come
    first; they are looked up in vain, so no list holds them.  A set with too few others has no similar one and leaves.
    """
    posts = _elsewhere(sets.where("id is not null and nth is not null").select("id", "nth", F.explode("own").alias("token")))
    found = posts.groupBy("id", "nth").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("found"))
    most = (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9)).cast("int")
    return (found.join(sets.select("id", "nth", "size"), ["id", "nth"])
            .select("id", "nth", (most + 1).alias("first"), (F.col("size") - F.size("found")).alias("alone"), F.col("found.token").alias("found"))
            .where("alone < first").withColumn("prefix", F.slice("found", F.lit(1), F.col("first") - F.col("alone"))).drop("found"))


def _possible(similarity: float, i: str, m: str, j: str, n: str):
    """Whether sets of m and n shingles that share those at places i and j of their orders can reach ``similarity``."""
    return F.expr(f"(1 + least({i}, {j}) + least({m} - {i} - 1, {n} - {j} - 1)) * {1 + similarity} >= {similarity} * ({m} + {n}) - 1e-6")


def _enough(similarity: float, shared: str, m: str, first_m: str, n: str, first_n: str):
    """Whether sets of m and n shingles whose first ones have ``shared`` in common can reach ``similarity``.

    What is shared beyond the first ones of both is beyond those of the one whose first ones end earlier.
    """
    return F.expr(f"({shared} + greatest({m} - {first_m}, {n} - {first_n})) * {1 + similarity} >= {similarity} * ({m} + {n}) - 1e-6")


def verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b: ids) whose whole shingle sets reach ``similarity``, compared exactly.

    Pairs whose first shingles have too few in common to reach it are dropped before whole sets are joined.
    """
    one, other = (nodes.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("first").alias(f"first_{x}"), F.col("prefix").alias(f"prefix_{x}")) for x in "ab")
    near = (pairs.join(one, "a").join(other, "b").withColumn("shared", F.size(F.array_intersect("prefix_a", "prefix_b")))
            .where(_enough(similarity, "shared", "size_a", "first_a", "size_b", "first_b")).select("a", "b").distinct())
    one, other = (nodes.select(F.col("id").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return store(near.join(one, "a").join(other, "b").withColumn("shared", shared)
                 .where(F.col("shared") >= F.lit(similarity) * (F.size("own_a") + F.size("own_b") - F.col("shared")) - 1e-9).select("a", "b").distinct())


def fingerprint_pairs(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b: ids) that the index on byte positions links: one document of each fingerprint, and the others with it."""
    first = store(nodes.groupBy("fp").agg(F.min("id").alias("low")))
    same = nodes.join(first, "fp").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    links = near_links(first.select("fp"), max_bits)
    x, y = (first.select(F.col("fp").alias(f), F.col("low").alias(f"low_{f}")) for f in "ab")
    far = links.join(x, "a").join(y, "b").where("low_a <> low_b")
    return same.union(far.select(F.least("low_a", "low_b"), F.greatest("low_a", "low_b"))).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that ``roots`` does not hold together already."""
    one, other = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return pairs.join(one, "a", "left").join(other, "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def _placed(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of lists, other than the centres, with the group that the centres have brought them into."""
    placed = listed.where("id <> centre").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return store(placed.select("token", "id", "size", "first", "pos", "root"))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ between each row of x and each of y; the wider rows are folded to the others' width first."""
    width = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_xor.reduce(m.reshape(len(m), -1, width), axis=1) for m in (x, y))
    count = np.zeros((len(x), len(y)), np.uint16)
    for one, other in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        count += np.bitwise_count(one[:, None] ^ other[None, :])
    return count


def _alike(one: dict, other: dict, similarity: float) -> list[tuple[int, int]]:
    """Pairs (smaller id, larger id) of a member of each block that are in different groups and may reach ``similarity``."""
    found = []
    for (_, x), (_, y) in itertools.product(_by_width(one), _by_width(other)):
        for at in range(0, len(x["id"]), 32):
            # Jaccard = (both - differing) / (both + differing)
            most = ((x["size"][at:at + 32, None] + y["size"][None, :]) * ((1 - similarity) / (1 + similarity)) + 1e-6).astype(np.int32)
            i, j = np.nonzero(_differing(x["bits"][at:at + 32], y["bits"]) <= most)
            a, b = ({k: block[k][rows] for k in ("id", "size", "pos", "root")} for block, rows in ((x, i + at), (y, j)))
            # what precedes the list's shingle in one order only is not shared
            least = np.minimum(a["pos"], b["pos"]) + np.minimum(a["size"] - a["pos"], b["size"] - b["pos"])
            kept = (a["root"] != b["root"]) & (a["id"] != b["id"]) & (least * (1 + similarity) >= similarity * (a["size"] + b["size"]) - 1e-6)
            found.extend((min(p, q), max(p, q)) for p, q in zip(a["id"][kept].tolist(), b["id"][kept].tolist()))
    return found


def _by_width(block: dict) -> list[tuple[int, dict]]:
    """The members of a block by the width of their bits, these as rows of words."""
    lengths = np.array([len(b) for b in block["bits"]])
    parts = []
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        words = np.frombuffer(b"".join(block["bits"][i] for i in at), np.uint64).reshape(len(at), -1)
        parts.append((width, {k: words if k == "bits" else block[k][at] for k in block}))
    return parts


def _across(placed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of a list, other than its centre, that the centres have not brought together yet and that can be similar.

    A list whose members are all in one group is done.  In the others every pair of members of different groups is compared by the
    bits of both.  A list is cut into blocks of some ``BLOCK`` members and each pair of blocks is a piece of work of its own, so that neither
    a list's members nor its pairs need to fit one task.
    """
    unsettled = (placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
                 .select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = (placed.join(unsettled, "token").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
               .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    pieces = (members.select("token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "size", "pos", "root")
              .join(nodes.select("id", "size", "bits"), ["id", "size"]))
    dealt = (pieces.select("token", "i", "j", "own", "id", "size", "pos", "root", "bits").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j"))

    def compare(batches):
        columns = ["id", "size", "pos", "root", "bits"]
        key, parts = None, []

        def result():
            own = np.concatenate([p["own"] for p in parts])
            block = {c: np.concatenate([p[c] for p in parts]) for c in columns}
            one, other = ({c: v[own == b] for c, v in block.items()} for b in key[1:])
            pairs = np.array(sorted(set(_alike(one, other, similarity))), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in range(3)])
            starts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            table = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ["own", *columns]}
            for first, end in itertools.pairwise(starts):
                now = tuple(of[:, first].tolist())
                if now != key and parts:
                    yield result()
                    parts = []
                key = now
                parts.append({c: v[first:end] for c, v in table.items()})
        if parts:
            yield result()

    return map_arrow(dealt, compare, "a long, b long").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id of its group).

    Documents belong together if the Jaccard similarity of their shingle sets reaches ``similarity``; all such pairs are
    candidates and all candidates are compared exactly.  Equal sets are one node.  Null and empty texts are copies of each
    other.  A null doc_id stays null and in no group.  Empty table: no rows.
    """
    docs, spark = texts(docs), docs.sparkSession
    probed = store(probes(docs, shingle, similarity))
    stored = store(probed.drop("probe"))
    named = stored.where("doc_id is not null")
    least = store(named.groupBy("key").agg(F.min("doc_id").alias("id")))
    copies = store(named.select(F.col("doc_id").alias("id")).distinct().join(least, "id", "left_anti"))
    posted = probed.where("size > 0 and doc_id is not null").withColumnRenamed("doc_id", "id").join(broadcast_if_small(copies, 16), "id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("key"))
    able = store(_able(posted).join(least, ["id", "key"], "left_semi").withColumn("nth", nth))
    discard(spark, probed, copies)
    chosen = docs.join(able.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = store(whole_sets(chosen, shingle).join(able, ["id", "key"]).dropDuplicates(["id", "key"]))
    nodes = store(ordered(sets, similarity).join(sets.select("id", "nth", "size", "fp", "bits", "own"), ["id", "nth"]))
    edges = verified(fingerprint_pairs(nodes), nodes, similarity)
    posts = nodes.select("id", "size", "first", "alone", F.posexplode("prefix").alias("at", "token")).withColumn("pos", F.expr("alone + at")).drop("alone", "at")
    lists = (posts.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.struct("pos", "id", "size")).alias("c")).where("low < high")
             .select("token", F.col("c.pos").alias("centre_pos"), F.col("c.id").alias("centre"), F.col("c.size").alias("centre_size")))
    listed = store(posts.join(lists, "token"))
    star = (listed.where("id <> centre").where(_possible(similarity, "pos", "size", "centre_pos", "centre_size"))
            .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
    edges = edges.union(verified(_apart(star, components(edges)), nodes, similarity))
    placed = _placed(listed, components(edges))
    edges = edges.union(verified(_across(placed, nodes, similarity), nodes, similarity))
    discard(spark, able, sets, listed, placed, nodes)
    roots = components(edges)
    named = least.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("component_id"))
    return stored.join(named, "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each group of near copies the one with the smallest doc_id stays.

    Rows equal in doc_id and text are one document and one of them stays; of rows that share a doc_id with different texts
    none goes if one of them stays.  Rows without a doc_id stay.
    """
    groups = similar_groups(docs.select("doc_id", "text"), shingle, similarity).where("doc_id is not null")
    byid = store(groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    gone, repeated = byid.where("not stays").select("doc_id"), byid.where("stays").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    single = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return single.union(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
