import zlib

import numpy as np
import pytest

import corpus_pipeline
from cases import edges, empty, jaccard_groups
from conftest import SF
from precinct.llm import decontaminate, knn, pii
from precinct.session import store

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_against_plain_versions(spark):
    """Each stage on all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]

    good = store(stages["quality"](spark, docs, SF))
    model = knn.fit(docs, knn.training_labels(labels, 3, 1), "quality")
    rows = docs.collect()
    scores = model.score([knn.term_counts(r.text) for r in rows])
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, s in zip(rows, scores) if s >= 0.5} and good.columns == docs.columns

    single = store(stages["near_duplicates"](spark, good, SF))
    kept = {r.doc_id for r in single.collect()}
    group, alike = jaccard_groups({r.doc_id: r.text for r in good.collect()}, 5, 0.85)
    assert all((a in kept) + (b in kept) <= 1 for (a, b), s in alike.items() if s >= 0.85)
    lonely = {r.doc_id for r in good.collect()} - {k for p, s in alike.items() if s >= 0.7 for k in p}
    assert lonely <= kept and single.columns == docs.columns

    clean = store(stages["decontamination"](spark, single, SF))
    block = next(decontaminate.blocks(spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not block.overlaps(r.text)} and clean.columns == docs.columns

    private = store(stages["personal_data"](spark, clean, SF))
    assert private.count() == clean.count() and private.columns == docs.columns
    assert not any(pii.base_spans(r.text) for r in private.collect())
    changed = {r.doc_id for r in clean.collect() if pii.base_spans(r.text)}
    before = {r.doc_id: r.text for r in clean.collect()}
    same = [r for r in private.collect() if r.doc_id not in changed]
    assert sum(before[r.doc_id] == r.text for r in same) >= 0.99 * len(same) and all(r.n_chars == len(r.text) for r in private.collect())

    from tokenizers import Tokenizer
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["packing"](spark, private, SF).collect()
    ids = {r.doc_id: np.array(code.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for r in private.collect()}
    assert {r.doc_id for r in packed} == set(ids) and sum(r.length for r in packed) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in packed)


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_stages_of_odd_and_empty_tables(spark):
    for docs in (edges(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.count()
            if name != "packing":
                assert out.columns == docs.columns
