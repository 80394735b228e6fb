import hashlib
import random
import time
import re

import numpy as np
import pytest

from cases import PROSE, edge_rows, edges, empty
from conftest import SF
from precinct.llm import decontaminate, pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


@pytest.mark.parametrize("window", range(8, 21))
def test_masks_survive_every_choice_of_substitutions(window):
    masks = decontaminate.MASKS + decontaminate.SHORT_MASKS * (window < decontaminate.WINDOW)
    assert decontaminate.misses(masks, window, window - int(np.ceil(0.8 * window))) == 0


def brute_overlaps(docs, items):
    found = {}
    for d, text in docs:
        words = decontaminate.words_of(text or "")
        for i, item in items:
            own = decontaminate.words_of(item or "")
            size = min(decontaminate.WINDOW, len(own))
            best = 0
            for a in range(len(words) - size + 1 if own else 0):
                for b in range(len(own) - size + 1):
                    best = max(best, sum(x == y for x, y in zip(words[a:a + size], own[b:b + size])))
            if own and best >= np.ceil(0.8 * size):
                found[d, i] = best
    return found


def test_overlaps_against_all_alignments(spark):
    pick = random.Random(7)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(pick.choice(words) for _ in range(n))) for i, n in enumerate((30, 22, 20, 17, 12, 9, 8, 3, 1, 0))] + [(50, None)]
    docs = []
    for d in range(60):
        text = [pick.choice(words) for _ in range(40)]
        item = items[d % 8][1].split()
        for at in pick.sample(range(len(item)), int(pick.random() * 0.25 * len(item))):
            item[at] = "other"
        text[10:10] = item
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.overlaps(frame, table).collect()}
    want = brute_overlaps(docs, items)
    long_enough = lambda found: {k: v for k, v in found.items() if k[1] <= 9}
    assert long_enough(got) == long_enough(want) and len(long_enough(want)) > 30
    assert all(k in want for k in got)
    kept = {r.doc_id for r in decontaminate.clean(frame, table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert sorted(map(tuple, decontaminate.overlaps(docs, items).collect())) == once and once


def test_decontaminate_odd_rows(spark):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.overlaps(edges(spark), items).collect()}
    assert found == {1, 2, None, 9, 12}
    assert decontaminate.overlaps(empty(spark), items).collect() == []
    assert decontaminate.overlaps(edges(spark), items.limit(0)).collect() == []
    assert decontaminate.clean(edges(spark), items.limit(0)).count() == len(edge_rows())


def plain_spans(text):
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (True, k == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_patterns_against_plain_regular_expressions():
    pick = random.Random(1)
    bits = ["1", "23", "255", "999", ".", "-", " ", "+", "@", "a", "b.c", "4111111111111111", "(", ")", "\n", "x@y.zz", "é"]
    for _ in range(20_000):
        text = "".join(pick.choice(bits) for _ in range(pick.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    for d in docs.collect():
        spans, r = plain_spans(d.text), rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert set(pii.written(spans).split(",")) <= set(r.spans.split(",")) or not spans


def test_repeated_tokens_share_a_label():
    field = pii.Field()
    text = "call +1 (743) 555-3824 today. Later on in the letter it says 555-3824 once more, and 12 apples in 2024."
    base, every = field.spans([text])[0]
    added = [text[a:b] for a, k, b in every if (a, k, b) not in base]
    assert added == ["555-3824"] and len(base) == 1


def test_message_passing_is_exact_on_a_tree():
    """A chain of three nodes: marginals by summing over all labellings."""
    import itertools
    field, graph = pii.Field(), pii.Graph()
    field.chain = np.random.default_rng(0).normal(size=(5, 5))
    field.chain = field.chain + field.chain.T
    graph.add("1a 2b 3c", [])
    graph.skip = []
    unary = pii._design(graph.x) @ field.unary
    total, marginal = 0.0, np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        p = np.exp(sum(unary[i, y[i]] for i in range(3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]])
        total += p
        for i in range(3):
            marginal[i, y[i]] += p
    assert np.allclose(field.marginals(graph), marginal / total, atol=1e-3)


def test_pii_of_odd_rows(spark):
    field = pii.fit(edges(spark))
    rows = pii.find(edges(spark), field).collect()
    assert len(rows) == len(edge_rows())
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (3, 4, 5))
    assert pii.find(empty(spark), pii.fit(empty(spark))).collect() == []
    masked = pii.mask(edges(spark), field)
    assert masked.columns == edges(spark).columns and masked.count() == len(edge_rows())


def test_masking(spark):
    docs = spark.createDataFrame([(1, "mail bob@x.org now", 18), (2, "plain", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, pii.mask(docs, pii.Field()).collect())) == [(1, "mail <EMAIL> now", 16), (2, "plain", 5), (3, None, None)]


def added(field, text):
    base, every = field.spans([text])[0]
    return base, [text[a:b] for a, k, b in every if (a, k, b) not in base]


def test_every_repeat_of_a_found_number_is_found():
    for n in (1, 10, 500):
        text = "call +1 (743) 555-3824 today" + ". Later in the letter it says 555-3824 again" * n
        base, more = added(pii.Field(), text)
        assert len(base) == 1 and more == ["555-3824"] * n


def test_parts_of_numbers_in_documents_rich_in_matches():
    for n in (49, 51, 300):
        text = "call +1 (743) 555-3824 today" + "".join(f" and mail u{i}@x.org" for i in range(n - 1)) + " or just 555-3824 then"
        base, more = added(pii.Field(), text)
        assert len(base) == n and more == ["555-3824"]


def test_messages_travel_along_long_chains():
    """Forty tied nodes in a row, the first of which is observed: marginals from forward and backward products."""
    field, graph = pii.Field(), pii.Graph()
    field.unary[0, 0], field.skip = 0.2, 30.0 * np.eye(5)
    graph.add("".join(f"{i}a, " for i in range(40)), [])
    graph.chain, graph.skip, graph.y[0] = [], [(i, i + 1) for i in range(39)], 4
    own = np.exp(pii._design(graph.x) @ field.unary)
    own[0] = np.eye(5)[4]
    pair = np.exp(field.skip - 30)
    back = [np.ones(5)]
    for i in range(39, 0, -1):
        back.append(pair @ (own[i] * back[-1]) / np.max(pair @ (own[i] * back[-1])))
    ahead, back = np.ones(5), back[::-1]
    p = field.marginals(graph)
    for i in range(40):
        want = ahead * own[i] * back[i]
        assert np.allclose(p[i], want / want.sum(), atol=1e-2), i
        ahead = pair @ (ahead * own[i])


@pytest.mark.parametrize("size", [5, 6, 7])
def test_short_items_with_one_word_substituted(size):
    """Whatever word of an item of five to seven is substituted, and none."""
    item = [f"w{i}".encode() for i in range(size)]
    block = decontaminate.Block().build([(1, item)])
    for place in range(size + 1):
        text = item[:place] + [b"other"] * (place < size) + item[place + 1:]
        for before, after in (([], []), ([b"x"] * 3, [b"y"] * 3)):
            got = block.overlaps(b" ".join(before + text + after).decode())
            assert [(g[0], g[1]) for g in got] == [(0, size - (place < size))]
    assert not block.overlaps(b" ".join([b"a", b"b"] + item[2:]).decode())


@pytest.mark.parametrize("item, text", [(["a"] * 1000, ["a"] * 20_000), (["a", "b"] * 500, ["a", "b"] * 10_000), (["a"] * 400 + [f"w{i}" for i in range(100)], ["a"] * 20_000)])
def test_repeated_words_take_no_pairs(item, text):
    block = decontaminate.Block().build([(1, [w.encode() for w in item])])
    start = time.perf_counter()
    got = block.overlaps(" ".join(text))
    assert [(g[0], g[1]) for g in got] == [(0, 20)] and time.perf_counter() - start < 3


@pytest.mark.parametrize("seed", range(4))
def test_shifts_taken_together_are_those_of_all_pairs(monkeypatch, seed):
    pick = random.Random(seed)
    words = [f"v{i}" for i in range(2 + seed)]
    items = [(i, [pick.choice(words).encode() for _ in range(n)]) for i, n in enumerate((200, 90, 25, 9))]
    block = decontaminate.Block().build(items)
    text = " ".join(pick.choice(words) for _ in range(400))
    w = np.array([block.vocabulary.get(x, 0) for x in decontaminate.words_of(text)])
    plain, best = block.hits(w), block.overlaps(text)
    monkeypatch.setattr(decontaminate, "MANY", 64)
    assert np.array_equal(block.hits(w), plain) and block.overlaps(text) == best and len(plain)
