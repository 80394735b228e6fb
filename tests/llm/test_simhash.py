import collections
import random

import numpy as np
import xxhash

from cases import PROSE, edge_rows, edges, empty, groups, jaccard_groups
from precinct.llm import simhash
from precinct.llm.components import components
from conftest import SF


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(key, fingerprint(text)) for key, text in rows]
    values = sorted({p for _, p in prints})
    linked = [(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= 2]
    root = groups(values, linked)
    least = {}
    for key, p in prints:
        if key is not None:
            least[root[p]] = min(key, least.get(root[p], key))
    return collections.Counter((key, f"{p:016x}", least.get(root[p])) for key, p in prints)


def test_linked_groups_of_odd_rows(spark):
    got = simhash.linked_groups(edges(spark)).collect()
    assert collections.Counter(map(tuple, got)) == brute([r[:2] for r in edge_rows()])
    assert simhash.linked_groups(empty(spark)).collect() == []


def test_linked_groups_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.linked_groups(docs).collect()
    assert collections.Counter(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_near_links_of_dense_fingerprints(spark):
    """Chains, stars and a list too long for all pairs."""
    pick, base = random.Random(2), 0x0123456789ABCDEF
    values = {base ^ sum(1 << b for b in pick.sample(range(64), k)) for k in (0, 1, 2, 3, 4) for _ in range(120)}
    values |= {base ^ (x << 16) for x in pick.sample(range(1 << 16), 400)} | {pick.getrandbits(64) for _ in range(200)} | {0, 3, 2**64 - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    root = {r.node: r.root for r in components(simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    ordered = sorted(signed)
    want = groups(ordered, [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {v: root.get(v, v) for v in signed} == want


def test_components_of_a_chain_and_a_star(spark):
    edge = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(6, 60)] + [(200, 200)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edge, "a long, b long")).collect()}
    want = groups(sorted({n for e in edge for n in e}), edge)
    assert {n: root.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_majority_over_more_than_one_block():
    pick = np.random.default_rng(0)
    sizes = [0, 1, 2, 255, 256, 700, 0]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = pick.integers(0, 2**64, starts[-1], np.uint64)
    for i, got in enumerate(simhash.majority(hashes, starts).tolist()):
        own = hashes[starts[i]:starts[i + 1]].tolist()
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def test_similar_groups_against_all_pairs(spark):
    pick, texts = random.Random(4), {}
    words = [f"word{i}" for i in range(3000)]
    for i in range(60):
        own = [pick.choice(words) for _ in range(300)]
        texts[10 * i] = " ".join(own)
        for j, changes in enumerate((0, 1, 3, 5, 25, 80)):
            near = own[:]
            for at in pick.sample(range(300), changes):
                near[at] = "changed" + str(at)
            texts[10 * i + 1 + j] = " ".join(near)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()}
    _, alike = jaccard_groups(texts, 5, 0.8)
    sure, never = [p for p, s in alike.items() if s >= 0.85], [p for p, s in alike.items() if s < 0.7]
    assert sum(got[a] == got[b] for a, b in sure) >= 0.98 * len(sure) and len(sure) > 200
    assert sum(got[a] == got[b] for a, b in never) <= 0.02 * len(never)


def test_one_of_each_of_odd_rows(spark):
    rows = simhash.one_of_each(edges(spark)).collect()
    kept = [(r.doc_id, r.text) for r in rows]
    assert {k for k, _ in kept if k is not None} == {1, 3, 6, 7, 8, 10, 11, 13}  # 2 and 9 repeat 1, 12 holds its shingles and 4 more of 36; 4 and 5 are as empty as 3
    assert sum(k is None for k, _ in kept) == 2 and rows[0].asDict().keys() == set(edges(spark).columns)
    assert simhash.one_of_each(empty(spark)).collect() == []
    assert PROSE in dict(kept).values()


def near_the_threshold(pick, shares, n=200, groups_of=4):
    """Pairs of documents whose five-word shingle sets have Jaccard similarities around 0.8, in both directions."""
    texts = {}
    for g in range(groups_of):
        for k in range(shares):
            own = [f"w{g}x{k}y{pick.getrandbits(40)}" for _ in range(n)]
            cut = 14 + k % 12  # a new end of that many words: similarity (196 - cut) / (196 + cut) from 0.87 down to 0.77
            texts[len(texts)] = " ".join(own)
            texts[len(texts)] = " ".join(own[:-cut] + [f"z{pick.getrandbits(40)}" for _ in range(cut)])
    return texts


def test_similar_groups_at_the_threshold_are_exact(spark):
    texts = near_the_threshold(random.Random(5), 60)
    want, alike = jaccard_groups(texts, 5, 0.8)
    assert sum(0.78 <= s < 0.8 for s in alike.values()) > 20 and sum(0.8 <= s < 0.82 for s in alike.values()) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_links_between_others_of_a_long_list(spark):
    """All documents share a long passage; the near copies among them are not like the first, last or any one centre."""
    pick, texts, passage = random.Random(6), {}, [f"shared{i}" for i in range(70)]
    for _ in range(80):
        own = passage + [f"v{pick.getrandbits(40)}" for _ in range(60)]
        texts[len(texts) + 1000] = " ".join(own)
        texts[len(texts) + 1000] = " ".join(own[:-6] + [f"z{pick.getrandbits(40)}" for _ in range(6)])
    order = list(texts)
    pick.shuffle(order)
    texts = {i: texts[k] for i, k in enumerate(order)}
    want, alike = jaccard_groups(texts, 5, 0.8)
    assert sum(s >= 0.8 for s in alike.values()) == 80 and len(alike) > 10_000
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()} == want


def test_copies_whose_only_link_is_not_the_centre(spark):
    """a-b and b-c are alike and a-c are not; every order of the ids gives the one group."""
    import itertools
    words = [f"k{i}" for i in range(104)]
    three = [" ".join(words[:94]), " ".join(words[5:99]), " ".join(words[10:])]
    texts = {100 * g + i: " ".join(f"g{g}{w}" for w in three[j].split()) for g, order in enumerate(itertools.permutations(range(3))) for i, j in enumerate(order)}
    want, _ = jaccard_groups(texts, 5, 0.8)
    assert set(want.values()) == {100 * g for g in range(6)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()} == want


def test_unlike_documents_leave_before_lists_and_fingerprints_link_first(spark):
    pick, passage = random.Random(7), " ".join(f"shared{i}" for i in range(30))
    texts = {i: passage + " " + " ".join(f"v{pick.getrandbits(40)}" for _ in range(100)) for i in range(30)}
    texts |= {100 + i: texts[i] + " end" for i in range(5)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    able = simhash._able(simhash.probes(rows, 5, 0.8).withColumnRenamed("doc_id", "id"))
    assert {r.id for r in able.collect()} == {i for k in range(5) for i in (k, 100 + k)}
    nodes = spark.createDataFrame([(4, 0), (2, 3), (9, 7), (5, 7), (8, 1 << 40), (7, -1)], "id long, fp long")
    pairs = [tuple(r) for r in simhash.fingerprint_pairs(nodes).collect()]
    assert groups([2, 4, 5, 7, 8, 9], pairs) == {2: 2, 4: 2, 5: 2, 9: 2, 8: 2, 7: 7}


def cluster(pick, members, changed, n=150, name="c"):
    """Documents that change other words of one text each: all share many shingles, most pairs stay below 0.8."""
    words, texts = [f"{name}{i}" for i in range(n)], []
    for _ in range(members):
        own = words[:]
        for at in pick.sample(range(n), changed):
            own[at] = f"{name}z{pick.getrandbits(40)}"
        texts.append(" ".join(own))
    return texts


def test_bits_never_differ_more_than_shingles_do():
    pick = random.Random(8)
    for n, m, common in ((0, 3, 0), (5, 5, 5), (40, 50, 30), (500, 520, 470), (1000, 1100, 900), (3000, 3300, 2900), (20_000, 21_000, 19_000)):
        shared = [pick.getrandbits(64) for _ in range(common)]
        one, other = (np.unique(np.array(shared + [pick.getrandbits(64) for _ in range(k - common)], np.uint64)) for k in (n, m))
        x, y = simhash.parities(one), simhash.parities(other)
        least = simhash._differing(x[None], y[None])[0, 0]
        assert least == simhash._differing(y[None], x[None])[0, 0] <= n + m - 2 * common
        assert (n + m - 2 * common - least) % 2 == 0 and simhash._differing(x[None], x[None])[0, 0] == 0
        assert 8 <= len(x) <= 256 and len(x) & (len(x) - 1) == 0


def test_pairs_of_a_list_do_not_become_rows(spark):
    """Of all pairs across the groups of a list only those that may be similar leave the comparison, and all that are similar do."""
    pick = random.Random(9)
    texts = dict(enumerate(cluster(pick, 160, 5) + cluster(pick, 40, 12, 700, "d")))
    for i, k in enumerate((3, 50, 170, 190)):
        words = texts[k].split()
        texts[1000 + i] = " ".join(words[:-2] + ["one", "two"])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, alike = jaccard_groups(texts, 5, 0.8)
    near = {p for p, s in alike.items() if s >= 0.8}
    sets = simhash.whole_sets(rows, 5).withColumn("root", simhash.F.col("id")).crossJoin(spark.createDataFrame([(7, 0)], "token long, pos int"))
    for block in (2048, 30):
        simhash.BLOCK, before = block, simhash.BLOCK
        try:
            pairs = [tuple(r) for r in simhash._across(sets, sets, 0.8).collect()]
        finally:
            simhash.BLOCK = before
        assert len(pairs) == len(set(pairs)) and near <= set(pairs) and len(near) >= 4
        assert len(pairs) < len(near) + 0.02 * len(texts) ** 2 / 2
        assert all(alike[p] >= 0.7 for p in pairs)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()}
    assert got == want


def test_each_shingle_is_shuffled_once(spark, capsys):
    """The counts of a token and its rows are read from one shuffle."""
    sets = spark.createDataFrame([(1, 1, 3, [1, 2, 3]), (2, 1, 3, [2, 3, 4]), (2, 2, 2, [4, 5])], "id long, nth int, size int, own array<long>")
    found = {(r.id, r.nth): (r.alone, r.prefix) for r in simhash.ordered(sets, 0.3).collect()}
    assert found == {(1, 1): (1, [2, 3]), (2, 1): (1, [2, 3])}
    out = simhash.ordered(sets, 0.3)
    out.collect()
    out.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") <= 2 and "ReusedExchange" in plan


def test_rows_of_one_id_and_copies(spark):
    """Copies of other documents, several texts and repeated rows under one id; rows without an id stay."""
    other = " ".join(f"o{i}" for i in range(60))
    third = " ".join(f"t{i}" for i in range(60))
    rows = [(1, other), (5, other), (5, third), (6, third + " end"), (6, third + " end"), (7, third + " stop"), (8, PROSE), (8, PROSE), (None, PROSE), (None, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()} == {(1, 1), (5, 1), (5, 5), (6, 5), (7, 5), (8, 8), (None, None)}
    kept = collections.Counter((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect())
    assert kept == {(1, other): 1, (5, other): 1, (5, third): 1, (8, PROSE): 1, (None, PROSE): 2}
