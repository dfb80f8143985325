import numpy as np
import pytest

from reprise.llm import mixing
from tests.llm import data


def test_targets():
    assert mixing.share_out([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.share_out([10, 100, 190])
    assert got[0] == 30 and sum(got) == pytest.approx(300) and got[1] == pytest.approx(180)
    assert mixing.share_out([0, 0]) == [0, 0] and mixing.share_out([5]) == [5]


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        for key in (1, 99):
            assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist()) == list(range(n))


def test_draws_meet_quotas():
    quota = np.array([500, 3, 0, 97])
    counts = mixing.draw_shards(quota, 64, 5)
    assert counts.sum(axis=0).tolist() == quota.tolist() and (counts.sum(axis=1)[:-1] == 64).all() and (counts >= 0).all()


def test_mix(spark):
    docs = data.documents(spark)
    rows = mixing.mix_sources(docs, block=16).collect()
    sizes = sorted(len((t or "").encode().split()) for _, t in data.texts())
    assert sorted(r["size"] for r in rows) == sizes
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=48)
    assert sorted(map(tuple, mixing.mix_sources(docs, block=16).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mixed_documents(spark):
    docs = data.documents(spark)
    taken = sum(r["taken"] for r in mixing.mix_sources(docs, block=16).collect())
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(r["text"].encode().split()) for r in rows) == taken and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_nothing(spark):
    assert mixing.mix_sources(data.empty(spark)).count() == 0 and mixing.mixed_documents(data.empty(spark)).count() == 0
    blank = data.documents(spark, [(1, None), (2, "")])
    assert [r["taken"] for r in mixing.mix_sources(blank).collect()] == [0, 0] and mixing.mixed_documents(blank).count() == 0
