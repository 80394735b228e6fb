import collections
import random
import zlib

import numpy as np
import pytest

from cases import edge_rows, edges, empty
from precinct.llm import packing, tokens
from precinct.session import shared_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    code = Tokenizer.from_file(PATH)
    code.encode_special_tokens = True
    return lambda text: code.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts_do(plain):
    code, pick = tokens.Encoder(PATH), random.Random(1)
    bits = ["the", " The", "'s", "'ll", "_", "__a", "12", " 3", "  ", "\n", "\t\n ", "é", "ÀÖ", "!?", " ...", "½", "²", " ", "中文", "\U0001f600", "<|endoftext|>", "\x1c", "\x85", "ß", "a'b"]
    for _ in range(3000):
        text = "".join(pick.choice(bits) for _ in range(pick.randint(0, 8)))
        assert np.frombuffer(code.encode(text), code.dtype).tolist() == plain(text), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_text_by_text(name):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(name)
    assert np.frombuffer(tokens.Encoder(path).encode("A b  c"), "<u2").tolist() == Tokenizer.from_file(path).encode("A b  c", add_special_tokens=False).ids


def test_files_round_trip(spark, plain):
    folder = shared_path(spark)
    tokens.write_token_files(edges(spark).repartition(3), folder, PATH, end_id=2)
    rows = tokens.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    want = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in edge_rows()))
    assert len(rows) == len(want)
    start = 0
    for row, (known, key, text) in zip(rows, want):
        ids = np.array(plain(text) + [2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (key if known else None, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(row.ids) == ids.tobytes()
        start += len(ids)


def test_files_of_an_empty_table(spark):
    folder = shared_path(spark)
    tokens.write_token_files(empty(spark), folder, PATH, end_id=2)
    assert tokens.read_token_files(spark, folder).collect() == []


def check_packed(rows, want, capacity):
    by_document, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == collections.Counter(want)
    return len(sequences)


def test_pack_keeps_every_token(spark, plain):
    want = []
    for row in edge_rows():
        ids = np.array(plain(row[1]) + [2], "<u4")
        start = 0
        for length in packing.cut_lengths(len(ids), 64):
            want.append((row[0], start, length, zlib.crc32(ids[start:start + length].tobytes())))
            start += length
    rows = packing.pack(edges(spark).repartition(4), PATH, capacity=64, end_id=2).collect()
    n = check_packed(rows, want, 64)
    assert n <= -(-sum(w[2] for w in want) // 64) + 3
    assert packing.pack(empty(spark), PATH, capacity=64, end_id=2).collect() == []


def test_first_piece_is_the_short_one():
    assert packing.cut_lengths(2500, 1024) == [452, 1024, 1024]
    assert packing.cut_lengths(1024, 1024) == [1024] and packing.cut_lengths(3, 1024) == [3] and packing.cut_lengths(0, 1024) == []


@pytest.mark.parametrize("seed,lengths", [(0, "uniform"), (1, "short"), (2, "long"), (3, "one")])
def test_plans_use_every_length_and_little_room(seed, lengths):
    pick = np.random.default_rng(seed)
    drawn = {"uniform": pick.integers(1, 1025, 20_000), "short": pick.integers(1, 90, 20_000), "long": pick.integers(500, 700, 5000), "one": np.full(1000, 300)}[lengths]
    histogram = collections.Counter(drawn.tolist())
    plan = packing.pack_histogram(histogram, 1024)
    used = collections.Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 1024 and n > 0
        for length in pattern:
            used[length] += n
    assert used == histogram
    n = sum(n for _, n in plan)
    assert n <= 1.002 * one_by_one(drawn, 1024) + 1
    if lengths in ("uniform", "short"):
        assert n <= 1.004 * -(-int(drawn.sum()) // 1024)


def one_by_one(drawn, capacity):
    """Sequences of best-fit decreasing, piece by piece."""
    spaces, n = collections.Counter(), 0
    for length in sorted(drawn.tolist(), reverse=True):
        space = next((s for s in range(length, capacity) if spaces[s]), None)
        if space is None:
            space, n = capacity, n + 1
        else:
            spaces[space] -= 1
        spaces[space - length] += 1
    return n


def test_fit_is_non_negative_and_near():
    pick = np.random.default_rng(5)
    left = np.bincount(pick.integers(1, 64, 5000), minlength=65)
    patterns = packing.exact_patterns(np.flatnonzero(left), 64)
    assert (patterns.sum(axis=1) == 64).all()
    x = packing.non_negative_fit(patterns, left)
    made = np.bincount(patterns.ravel(), np.repeat(x, 3), 65)
    assert (x >= 0).all() and np.abs(made[1:] - left[1:]).sum() < 0.1 * left.sum()
