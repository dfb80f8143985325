import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from reprise.llm import simhash
from tests.llm import data


def slow_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, prints, radius):
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {k: min((rows[i] for i in range(len(rows)) if label[i] == k and rows[i] is not None), default=None) for k in set(label)}
    return [low[k] for k in label]


def test_against_brute_force(spark):
    rows = data.texts()
    prints = [slow_fingerprint(t) for _, t in rows]
    expected = sorted(((i, f"{p:016x}", g) for (i, _), p, g in zip(rows, prints, groups([i for i, _ in rows], prints, 4), strict=True)), key=str)
    got = sorted((tuple(r) for r in simhash.simhash_groups(data.documents(spark)).collect()), key=str)
    assert got == expected


def test_fingerprint_of_long_text():
    text = " ".join(data.words(70_000, 8))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize(("radius", "parts", "block"), [(4, 3, 2048), (4, 3, 16), (2, 4, 2048), (3, 2, 8), (5, 3, 30)])
def test_links_connect_as_all_pairs_do(spark, radius, parts, block):
    rng = np.random.default_rng(radius * 10 + parts)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:6]:  # some far chains, one dense group
        for _ in range(60 if b == base[0] else 8):
            x = int(b)
            for bit in rng.integers(0, 63, rng.integers(1, 7)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [tuple(r) for r in simhash.near_links(df, radius, parts, block).collect()]
    assert all((a ^ b).bit_count() <= radius and a != b for a, b in links)

    def label(edges):
        at = {x: x for x in fps}
        for _ in fps:
            before = dict(at)
            for a, b in edges:
                at[a] = at[b] = min(at[a], at[b])
            if at == before:
                return at

    assert label(links) == label([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius])


def test_empty(spark):
    assert simhash.simhash_groups(data.empty(spark)).count() == 0
    assert simhash.one_of_each(data.empty(spark)).count() == 0


def test_one_of_each(spark):
    docs = data.documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and not {2, 3, 16, 21} & set(ids)
    assert {5, 8, 9, 10, 20} <= set(ids) and not {6, 7} & set(ids)
    assert sum(i is None for i in ids) == 1  # of two equal rows without an id one stays; the null text is near document 5
    assert ids.count(20) == 1 and ids.count(15) == 2


def test_no_column_name_clashes(spark):
    docs = data.documents(spark)
    own = ("fingerprint", "component_id", "root", "first", "row", "bucket", "a", "b", "fp", "node")
    clashing = docs.withColumns({name: F.lit("x") for name in own})
    out = simhash.one_of_each(clashing)
    assert out.columns == clashing.columns
    assert out.count() == simhash.one_of_each(docs).count()


def test_number_of_segments_changes_no_link(spark):
    assert simhash.parts_for(1000, 4) == 3 and simhash.parts_for(1 << 36, 4) == 2
    docs = data.documents(spark)
    got = [sorted(map(tuple, simhash.simhash_groups(docs, parts=m).collect()), key=str) for m in (2, 3, 4)]
    assert got[0] == got[1] == got[2]
