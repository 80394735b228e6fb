"""Sharding, conversation trie and hard negatives against their laws and brute force, on odd rows and hot groups."""
import collections
import hashlib
import random
import re
import zlib

import pytest

from precinct.llm import negatives, prefix_trie, sharding
import cases

# ------------------------------------------------------------------- sharding


def _sharded(docs, **settings):
    rows = sharding.shard(docs, **settings).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for number, found in by.items():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    return rows, by


def test_sharding_odd_rows(spark):
    rows, by = _sharded(cases.edges(spark))
    given = [(r[0], (r[1] or "").encode()) for r in cases.edge_rows()]
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in given)
    assert set(by) <= set(range(24)) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert sharding.shard(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("hot", ["group", "row", "none"])
def test_sharding_is_even_and_keeps_groups(spark, hot):
    dice = random.Random(1)
    rows = [(i, f"t{i} " * dice.randint(1, 60)) for i in range(3000)] + [(10_000 + i, f"pair {i // 2} " * 9) for i in range(400)]
    rows += [(-i if hot == "group" else -1, "hot text " * 5) for i in range(2000 if hot != "none" else 0)]
    found, by = _sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=8)
    sizes = [sum(r["size"] for r in by[s]) for s in range(8)]
    share, most = sum(sizes) / 8, max(r["size"] for r in found)
    assert all(abs(s - share) <= share / sharding.RANGES + most for s in sizes)
    where = collections.defaultdict(set)
    for r in found:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    split = [k for k, v in where.items() if len(v) > 1]
    assert len(split) <= (hot != "none")  # none but the hot group


def test_sharding_uses_no_python_worker(spark):
    plan = sharding.shard(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------ conversation trie


def trie(rows):
    """Every prefix of every rebuilt conversation, counted one by one; rows: (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    built = {}
    for c, own in convs.items():
        h, head = zlib.crc32(str(c).encode()) % 4, c - c % 20 if c >= 0 else c + (-c) % 20
        built[c] = [(t[2], t[4]) for t in sorted(convs.get(head, []))[:h] + sorted(own)[h:]]
    members = collections.defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def _nodes(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", depth long, path string").repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_nodes(df, **settings).collect()), key=str)


@pytest.mark.parametrize("shards", [1, 3, 16])
@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_brute_force(spark, shards, seed):
    dice = random.Random(seed)
    rows = []
    for c in [*range(0, 130), -3, -20, -41]:
        rows += [(c, t, dice.choice(["user", "bot", None]), dice.choice(["a b", "c", "", None])) for t in range(dice.randint(1, 6))]
    assert _nodes(spark, rows, shards=shards) == trie(rows)


def test_trie_odd_rows(spark):
    long = [(40, t, "user", f"turn {t}") for t in range(700)] + [(60, t, "user", f"turn {t}") for t in range(700)]
    odd = [(None, 1, "user", "no id"), (1, None, "user", "first"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None),
           (25, 1, "user", "x"), (26, 1, "user", "x " * 50_000), (27, -5, "user", "中 \U0001f600"), (2 ** 62, 2 ** 62, "user", "far")]
    rows = long + odd
    for shards in (1, 5):
        assert _nodes(spark, rows, shards=shards) == trie(rows)
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], TURNS)).collect() == []


def test_trie_splits_a_hot_group(spark, monkeypatch):
    """A third of all conversations are equal: they run over many shards, their ids over many chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    hot = [c for c in range(20, 1500) if zlib.crc32(str(c).encode()) % 4 == 0]
    rows = [(c, t, "user", f"same {t}") for c in hot for t in range(3)] + [(c, t, "user", f"{c} {t}") for c in range(3000, 3600) for t in range(2)]
    assert _nodes(spark, rows, shards=12) == trie(rows)
    cuts = prefix_trie.splitters(prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS)), 12)
    assert len({path for path, _ in cuts}) < len(cuts)  # ties of path, cut by conv_id


# ---------------------------------------------------------------- hard negatives


def mined(rows, every=50, positives=5, negatives_=3):
    """All pairs; rows: (vec_id, label, components)."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        limit = negatives.LIMIT
        r = ((label + 1) % 10 if i % 7 == 0 else label, [int(max(-limit, min(limit, 256 * x)) // 1) for x in v])
        best[i] = min(best.get(i, r), r)
    out = []
    for a in (a for a in best if a % every == 0):
        scored = [(-sum(x * y for x, y in zip(best[a][1], v)), i, label) for i, (label, v) in best.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == best[a][0])[:positives]:
            fits = sorted((n, i) for n, i, label in scored if label != best[a][0] and 50 * -s <= 100 * -n <= 95 * -s)[:negatives_]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, score double, cell int, shard int"


def _mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], VECTORS)
    return sorted(map(tuple, negatives.hard_negatives(df, **settings).collect()))


@pytest.mark.parametrize("kind", ["even", "clustered", "ties", "hot"])
def test_negatives_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 150)  # several shards
    monkeypatch.setattr(negatives, "BATCH", 16)
    dice = random.Random(3)
    centres = [[dice.gauss(0, 1) for _ in range(8)] for _ in range(5)]

    def vector(i):
        if kind == "ties":
            return [float(dice.randint(-1, 1)) for _ in range(4)]
        if kind == "hot" and i % 3 == 0:
            return [0.5, 0.25, -0.125, 1.0, 0.0, 0.0, 0.5, 0.5]
        centre = centres[i % 5] if kind == "clustered" else [0.0] * 8
        return [c + dice.gauss(0, 0.3) for c in centre]

    rows = [(i, dice.randint(0, 3), vector(i)) for i in range(700)]
    rows = [(i, label, [float(f"{x:.4f}") for x in v]) for i, label, v in rows]
    import numpy as np
    exact = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert _mined(spark, rows) == mined(exact)


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [1.0, 1.0]), (50, 0, [1.0, 0.5]), (100, None, [1.0, 1.0]), (150, 1, None), (1, 1, [0.9, 0.5]), (2, 1, [1.0, None]), (3, 1, [nan, 1.0]),
            (4, 1, [inf, 1.0]), (5, 1, []), (6, 1, [0.75]), (8, 1, [0.7, 0.7]), (8, 1, [0.7, 0.7]), (8, 2, [0.0, 0.0]), (None, 1, [1.0, 1.0]),
            (200, 1, [1e30, -1e30]), (9, 1, [1e30, 1.0]), (10, 0, [0.5, 3.0]), (-50, 1, [0.5, 0.5]), (11, 0, [0.25, 0.25])]
    assert _mined(spark, rows) == mined(rows)
    assert _mined(spark, []) == []
    assert _mined(spark, [(0, 1, [1.0])]) == [] and _mined(spark, [(0, 1, []), (1, 1, [])]) == []


def test_search_stops_on_certified_windows():
    """Near rows are found without looking at cells whose bound is lower."""
    import numpy as np
    dice = np.random.default_rng(0)
    centres = dice.normal(0, 200, (16, 8))
    x = np.rint(centres[np.arange(8000) % 16] + dice.normal(0, 5, (8000, 8))).astype(np.int32)
    codes = negatives.Codes(list(range(2000)), x[:2000], 16, 1)
    cells = codes.cells(x)
    order = np.argsort(cells, kind="stable")
    shard = negatives.Shard(codes, cells[order], np.arange(8000)[order], (np.arange(8000) % 16)[order], x[order])
    seen = []
    visits = shard.visits
    shard.visits = lambda q: (seen.append(len(at)) or (at, s, later) for at, s, later in visits(q))
    own = int(np.argmax(np.linalg.norm(x, axis=1)))  # the cluster farthest out has the highest scores with itself
    best = shard.positives(own, own % 16, x[own], 5)
    scores = x.astype(int) @ x[own]
    want = sorted(((-int(s), i) for i, s in enumerate(scores) if i % 16 == own % 16 and i != own))[:5]
    assert best == [(-s, i) for s, i in want] and sum(seen) < 4000
