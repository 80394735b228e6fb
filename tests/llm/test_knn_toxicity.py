import random

import numpy as np

from cases import edge_rows, edges, empty, labels
from conftest import SF
from precinct.llm import knn, queries, toxicity


def test_quality_held_out(spark):
    rows = queries.op10_neighbours(spark, SF.replace("0.001", "0.01")).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet").collect()}
    seen = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in seen) >= 0.95 * len(seen) and len(rows) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_blocks_equal_plain_neighbours():
    """Blocked products against one document and one labelled vector at a time."""
    pick = random.Random(3)
    texts = [" ".join(pick.choice(["the", "of", "AND!!", "ha", "###", "tree", "12"]) for _ in range(pick.randint(1, 40))) for _ in range(700)]
    found = [knn.term_counts(t) for t in texts]
    model = knn.Neighbours(found[:300], np.array([i % 3 == 0 for i in range(300)]))
    got = model.score(found)
    for i in range(0, 700, 37):
        v = model._weigh(knn.dense([found[i]])) @ model.projection
        v = v[0] / np.linalg.norm(v)
        cosine = np.array([float(v @ w) for w in model.vectors])
        near = np.sort(cosine)[::-1][:25].clip(0) ** 8
        least = np.sort(cosine)[::-1][24]
        inside = cosine > least + 1e-5
        if inside.sum() >= 20:
            vote = (cosine[inside] ** 8 * model.labels[inside]).sum()
            slack = near.sum() - (cosine[inside].clip(0) ** 8).sum()
            assert vote / near.sum() - 1e-3 <= got[i] <= (vote + slack) / near.sum() + 1e-3


def test_quality_of_odd_rows(spark):
    model = knn.fit(edges(spark), labels(spark), "quality")
    rows = knn.score(edges(spark), model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert {round(r.score, 6) for r in rows if r.doc_id in (3, 4, 5)} == {round(model.prior, 6)}
    assert knn.score(empty(spark), model).collect() == []
    bare = knn.fit(edges(spark), labels(spark).limit(0), "quality")
    assert {r.score for r in knn.score(edges(spark), bare).collect()} == {0.5}
    assert knn.accepted(edges(spark), bare, 0.5).columns == edges(spark).columns


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_accepts_what_the_distances_say():
    terms = ["idiot", "worthless", "cat", "réeuxou", "idle"]
    machine, pick, words = toxicity.Automaton(terms), random.Random(1), []
    for _ in range(3000):
        w = list(pick.choice(terms))
        for _ in range(pick.randint(0, 3)):
            at, kind = pick.randint(0, len(w) - 1), pick.random()
            if kind < 0.4:
                w[at] = pick.choice("abcidotwxé9")
            elif kind < 0.7 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, pick.choice("abcidotwx9"))
        words.append("".join(w))
    codes = machine.classes[np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)]
    inside = np.concatenate([[False], codes > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    hit, term, edits = machine.run(codes, edge[::2], edge[1::2])
    got = {int(i): int(e) for i, e in zip(hit, edits)}
    for i, w in enumerate(words):
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.allowed(t)]
        assert got.get(i) == (min(near) if near else None), w


def test_quotation_and_abuse_differ():
    words = toxicity.Lexicon({"idiot": 3.0, "worthless": 3.0})
    abuse, quoted, misspelt = words.features(["you are an idiot", 'he said "idiot" was a rude word', "you worthles idot"])
    assert abuse[1] > 0 and abuse[3] == 0 and abuse[4] > 0
    assert quoted[3] > 0 and quoted[1] == quoted[2] == 0
    assert misspelt[2] > 0 and misspelt[5] > 0


def test_toxicity_held_out(spark):
    folder = SF.replace("0.001", "0.1")
    rows = queries.op5_toxicity(spark, folder).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(folder + "/labels.parquet").collect()}
    seen = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    found = sum(p and y for p, y in seen)
    assert found >= 0.9 * sum(y for _, y in seen) and found >= 0.9 * sum(p for p, _ in seen)


def test_toxicity_of_odd_rows(spark):
    model = toxicity.fit(edges(spark), labels(spark), "toxic")
    rows = toxicity.score(edges(spark), model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty(spark), model).collect() == []
    bare = toxicity.fit(empty(spark), labels(spark).limit(0), "toxic")
    assert len({r.score for r in toxicity.score(edges(spark), bare).collect()}) == 1


def hits(machine, words):
    codes = machine.classes[np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)]
    inside = np.concatenate([[False], codes > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return {words[i]: (machine.terms[t], int(e)) for i, t, e in zip(*machine.run(codes, edge[::2], edge[1::2]))}


def test_two_edits_from_nine_letters():
    """And words with support in three toxic documents at 1.5 standard errors are terms."""
    terms = ["worthless", "disgusting", "abcdefghijk"]
    assert hits(toxicity.Automaton(terms), ["wrthles", "disgosteng", "abcxefghijkk", "wrthle"]) == {
        "wrthles": ("worthless", 2), "disgosteng": ("disgusting", 2), "abcxefghijkk": ("abcdefghijk", 2)}
    assert "rarer" in toxicity.lexicon([("rarer", 3, 0)], 100, 5000).terms and "rare" not in toxicity.lexicon([("rare", 2, 0)], 100, 5000).terms


def test_automaton_that_forgets_finds_the_same(monkeypatch):
    pick = random.Random(7)
    make = lambda: "".join(pick.choice("abcde") for _ in range(pick.randint(3, 12)))
    terms, words = sorted({make() for _ in range(60)}), [make() for _ in range(1500)]
    once = hits(toxicity.Automaton(terms), words)
    monkeypatch.setattr(toxicity, "MEMORY", 1)
    monkeypatch.setattr(toxicity, "WORDS", 100)
    monkeypatch.setattr(toxicity, "BATCH", 50)
    assert hits(toxicity.Automaton(terms), words) == once and len(once) > 15
    for w in words[:300]:
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.allowed(t)]
        assert (once[w][1] if w in once else None) == (min(near) if near else None)


def test_terms_of_any_script():
    words = toxicity.Lexicon({"바보멍청이": 3.0, "混蛋": 3.0, "\U00020000\U00020001": 3.0})
    rows = words.features(["너는 바보멍청이、", "你 混蛋。", "바보멍청 \U00020000\U00020001", "你好 。、 안녕"])
    assert [list(r[[10, 11]]) for r in rows] == [[1, 0], [1, 0], [1, 1], [0, 0]]
    assert words.features(["a、b。c"])[0, 9] == np.log1p(3)


def test_scattered_hits_are_alone_however_many():
    words = toxicity.Lexicon({"idiot": 3.0})
    for n in (499, 500, 700):
        alone, pairs = words.features([" ".join(["idiot a b c d e f g"] * n), " ".join(["idiot idiot a b c d e f"] * (n // 2))])
        assert alone[5] == 0 and np.isclose(pairs[5], np.log1p(n // 2 * 2))
