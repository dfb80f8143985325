import hashlib

import numpy as np
import pytest

from reprise.llm import substrings
from tests.llm import data


def slow(rows, window):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().split())
    first = {}
    for i, many in texts.items():
        for w in many if i is not None else []:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + n for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for n in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 13])
def test_against_brute_force(spark, window):
    rows = data.texts()
    got = sorted((tuple(r) for r in substrings.dedup_substrings(data.documents(spark), window).collect()), key=str)
    assert got == slow(rows, window)


def test_passage_in_many_documents(spark):
    passage = " ".join(data.words(55, 77))
    rows = [(k, " ".join(data.words(30 + k % 7, k)) + " " + passage + " " + " ".join(data.words(20, k + 500))) for k in range(120)]
    got = sorted((tuple(r) for r in substrings.dedup_substrings(data.documents(spark, rows)).collect()), key=str)
    assert got == slow(rows, 50)
    assert sum(r[2] >= 55 for r in got) == 119


def test_empty(spark):
    assert substrings.dedup_substrings(data.empty(spark)).count() == 0


def test_window_hashes():
    x = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    for size in (1, 2, 3, 7, 25, 50):
        h = substrings.window_hashes(x, size)
        by = {}
        for i in range(len(x) - size + 1):
            by.setdefault(tuple(x[i : i + size]), set()).add(int(h[i]))
        assert len(h) == len(x) - size + 1 and all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    found = substrings.chains(x, [13, 25, 50])
    for k, (h, size) in enumerate(zip(substrings.level_hashes(x, [13, 25, 50]), (13, 25), strict=False)):
        assert [int(v) for v in found[:, k]] == [int(h[i : i + 51 - size].min()) for i in range(len(x) - 49)]


def test_levels():
    assert substrings.lengths(50) == [13, 25, 50] and substrings.lengths(13) == [7, 13] and substrings.lengths(2) == [1, 2] and substrings.lengths(1) == [1]
    x = np.random.default_rng(2).integers(0, 1 << 60, 200).astype(np.uint64)
    x[120:180] = x[20:80]
    sizes = substrings.lengths(50)
    found, (w, v) = substrings.chains(x, sizes), substrings.full_hashes(x, sizes)
    assert found.shape == (151, 2) and (found[20:31] == found[120:131]).all()
    assert (w[20:31] == w[120:131]).all() and (v[20:31] == v[120:131]).all() and len(set(w.tolist())) == len(set(v.tolist())) == 151 - 11


def test_nothing_survives_the_first_level(spark):
    rows = [(k, " ".join(data.words(80, k + 900, 10**6)).replace("w", f"v{k}")) for k in range(6)]
    assert all(r[2] == 0 for r in substrings.dedup_substrings(data.documents(spark, rows)).collect())
