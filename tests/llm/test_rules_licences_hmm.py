import itertools
import math
import re
import zlib

import numpy as np
import pytest

from cases import edge_rows, edges, empty, unigram
from conftest import SF
from precinct.llm import hmm, licences, queries, rules


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_of_odd_rows(spark):
    rows = rules.judge(edges(spark), rules.Cascade(edges(spark))).collect()
    want = sorted(plain_statistics(r[1]) for r in edge_rows())
    assert sorted(tuple(r)[1:6] for r in rows) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows) and any(r.kept for r in rows)
    assert rules.judge(empty(spark), rules.Cascade(empty(spark))).collect() == []


def test_verdict_does_not_depend_on_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cascade = rules.Cascade(docs)
    first = sorted(map(tuple, rules.judge(docs, cascade).collect()))
    cascade.order.reverse()
    assert sorted(map(tuple, rules.judge(docs, cascade).collect())) == first
    assert {r.name for r in cascade.order} == set(rules.RULES)


def test_cascade_puts_rejection_per_cost_first():
    cheap, dear, useless = rules.Rule("a", 1e-6, 0.1), rules.Rule("b", 1e-3, 0.5), rules.Rule("c", 1e-7, 0.0)
    assert sorted([useless, dear, cheap], key=lambda r: -r.worth()) == [cheap, dear, useless]


def test_rules_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = rules.judge(docs, rules.Cascade(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_licences_against_all_blocks(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    sets = {n: set(licences.words_of(t)) for n, t in licences.TEMPLATES.items()}
    size = 2 * max(len(licences.words_of(t)) for t in licences.TEMPLATES.values())
    labels = 0
    for d in docs.collect():
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), d.text))]
        base = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.encode().split()]
        met = set()
        for start in range(0, len(words), size // 2):
            block = set(words[start:start + size])
            own = {n for n, s in sets.items() if len(s & block) / len(s) >= licences.THRESHOLD}
            met |= {f"{start}:{n}" for n in own if not any(sets[n] < sets[o] for o in own)}
        r = rows[d.doc_id]
        places = [i for i, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and set(filter(None, r.blocks.split(","))) == met
        assert r.labels == ",".join(sorted({x for _, x in base} | {m.split(":")[1] for m in met}))
        labels += bool(met)
    assert labels > 10


def test_licences_of_odd_rows(spark):
    rows = licences.scan(edges(spark)).collect()
    assert len(rows) == len(edge_rows()) and all((r.n_words, r.labels, r.score, r.first_word) == (0, "", 0.0, None) for r in rows if r.doc_id in (3, 4, 5))
    assert licences.scan(empty(spark)).collect() == []


def brute(model, s):
    k, m = model.emit.shape
    total, expected = 0.0, np.zeros(model.parameters())
    for path in itertools.product(range(k), repeat=len(s)):
        p = model.initial[path[0]] * model.emit[path[0], s[0]]
        for a, b, x in zip(path, path[1:], s[1:]):
            p *= model.move[a, b] * model.emit[b, x]
        total += p
        expected[path[0]] += p
        for a, b in zip(path, path[1:]):
            expected[k + k * a + b] += p
        for a, x in zip(path, s):
            expected[k + k * k + m * a + x] += p
    return math.log10(total), expected / total


def test_recursions_against_all_paths():
    model = hmm.Model(5, 3)
    sequences = [np.array(s) for s in ([0, 1, 2, 4], [4], [3, 3], [1, 1, 1, 2, 0, 4])]
    assert np.allclose(model.likelihood(sequences), [brute(model, s)[0] for s in sequences])
    assert np.allclose(model.expected(sequences), sum(brute(model, s)[1] for s in sequences), rtol=1e-4, atol=1e-5)


def test_learning_raises_the_likelihood():
    pick = np.random.default_rng(1)
    sequences = [np.append(pick.integers(0, 4, 30) + 4 * (i % 2), 8) for i in range(40)]
    model, last = hmm.Model(9, 3), -np.inf
    for _ in range(5):
        model = model.learned(model.expected(sequences))
        now = model.likelihood(sequences).sum()
        assert now > last - 0.5
        last = now
    assert last > hmm.Model(9, 3).likelihood(sequences).sum() + 50


@pytest.mark.parametrize("frequent", [2.0**-20, 2.0**-6])
def test_base_score_against_plain_counts(spark, monkeypatch, frequent):
    """With few frequent words most occurrences take the join."""
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    rows = queries.op8_language_model(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    want, total = unigram(texts, [k for k in texts if not held[k]])
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, total)
        assert abs(r.base_score - base) <= 1e-6 * max(1, abs(base))
    tokens = sum(r.n_tokens for r in rows if r.held_out)
    assert sum(r.score for r in rows if r.held_out) / tokens > sum(r.base_score for r in rows if r.held_out) / tokens


def test_word_probabilities_sum_to_one(spark):
    """The model's share of every known word, of one unknown word to each class and of the end."""
    training = spark.createDataFrame([(1, "a b b c c c d"), (2, "a e")], "doc_id long, text string")
    counts = hmm.word_counts(training)
    words = hmm.vocabulary(counts, 2)
    shares = np.zeros(hmm.CLASSES)
    for r in counts.collect():
        shares[hmm.class_of(bytes(r.word))] += r.n + hmm.SMOOTH if words.symbol[words.rank[bytes(r.word)]] >= hmm.SYMBOLS else 0
    shares = (shares + hmm.SMOOTH) / 10 ** words.log_share[hmm.SYMBOLS:-1]
    assert np.allclose(shares, 1)
    assert np.allclose(hmm.Model(7, 3).emit.sum(axis=1), 1)


def test_language_model_of_odd_rows(spark):
    from precinct.llm.common import remainder
    rows = hmm.score(edges(spark), remainder("doc_id", 10) == 0, rounds=2).collect()
    assert len(rows) == len(edge_rows()) and all(math.isfinite(r.score) and r.held_out for r in rows if r.doc_id is None)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert hmm.score(empty(spark), remainder("doc_id", 10) == 0, rounds=1).collect() == []
