import math
import random
import zlib

import numpy as np
import pytest

from reprise.llm import docstats, gbt, pu, quality_rules, queries
from tests.llm import data


def slow_stats(text):
    text = text or ""
    w = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_statistics():
    for _, t in data.texts():
        if t is None or len(t) < 20_000:
            assert tuple(docstats.base_stats(t)) == slow_stats(t)
            base, values = docstats.features(t)
            assert tuple(base) == slow_stats(t) and len(values) == len(docstats.FEATURES) and np.isfinite(values).all()


def corpus(spark, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = data.words(rng.randrange(60, 200), i)
        rows.append((i, " ".join(w) if good else " ".join(x + rng.choice(["###", "$$$", "!!"]) for x in w)))
        if rng.random() < 0.6:
            labels.append((i, int(good), 0))
    return data.documents(spark, rows), data.labels(spark, labels), {i: q for i, q, _ in labels}


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((800, 4))
    y = (x[:, 0] + 0.3 * rng.standard_normal(800) < 0.5).astype(int)
    forest = gbt.fit(x, y, np.array([-1, 0, 1, 0]))
    assert ((forest.probability(x) >= 0.5) == y).mean() > 0.8
    grid = np.repeat(rng.random((40, 1, 4)), 30, axis=1)
    for f, sign in ((0, -1), (2, 1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 30)
        m = forest.margin(g.reshape(-1, 4)).reshape(40, 30)
        assert (sign * np.diff(m, axis=1) >= -1e-9).all()


def slow_margin(forest, row):
    total = forest.base
    for k in forest.roots:
        while forest.left[k] != k:
            k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
        total += forest.value[k]
    return total


def test_flat_trees_score_as_single_steps():
    rng = np.random.default_rng(2)
    x = rng.random((200, 3))
    forest = gbt.fit(x, (x[:, 1] > 0.4).astype(int), np.zeros(3, int), trees=10)
    assert forest.margin(x) == pytest.approx([slow_margin(forest, r) for r in x])


def test_rules(spark):
    docs, labels, _ = corpus(spark)
    forest = quality_rules.fit_rules(docs, labels)
    extra = data.documents(spark)
    rows = quality_rules.apply_rules(docs.unionByName(extra), forest).collect()
    texts = [t for _, t in sorted(data.texts(), key=str)]
    assert len(rows) == 400 + len(texts)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["score"] >= 0.3)
    assert quality_rules.apply_rules(data.empty(spark), forest).count() == 0
    blank = quality_rules.fit_rules(docs, data.labels(spark, []))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.apply_rules(docs, blank).collect())


def test_classifier(spark):
    docs, labels, known = corpus(spark)
    rows = pu.score_quality(docs, pu.fit_quality(docs, labels)).collect()
    assert len(rows) == 400
    right = [r["predicted"] == known[r["doc_id"]] for r in rows if r["doc_id"] in known and r["held_out"]]
    assert np.mean(right) > 0.8
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1


def test_classifier_edges(spark):
    net = pu.fit(np.zeros((0, 3)), np.zeros(0, int))
    assert net.score(np.zeros((2, 3))) == pytest.approx([0.5, 0.5])
    docs, labels, _ = corpus(spark, 60)
    net = pu.fit_quality(docs, labels)
    odd = data.documents(spark)
    rows = pu.score_quality(odd, net).collect()
    assert len(rows) == len(data.texts()) and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert pu.score_quality(data.empty(spark), net).count() == 0
    kept = pu.keep_quality(odd, net)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in rows)
    again = pu.fit_quality(docs, labels)
    assert np.allclose(again.w1, net.w1)


def slow_risk(net, p, u):
    """The non-negative risk, text by text, from the formula."""
    def margin(row):
        inputs = [min(6, max(-6, (v - c) / s)) for v, c, s in zip(row, net.centre, net.scale, strict=True)]
        hidden = [math.tanh(sum(v * w for v, w in zip(inputs, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(len(net.b1))]
        return sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2

    plus = lambda rows: sum(math.log1p(math.exp(-margin(r))) for r in rows) / len(rows)
    minus = lambda rows: sum(math.log1p(math.exp(margin(r))) for r in rows) / len(rows)
    return net.prior * plus(p) + max(0, minus(u) - net.prior * minus(p))


@pytest.mark.parametrize("prior", [0.3, 0.97])
def test_risk_and_its_gradient(prior):
    rng = np.random.default_rng(6)
    p, u = rng.normal(1, 1, (15, 4)), rng.normal(0.9, 1, (25, 4))
    net = pu.Network(np.full(4, 0.2), np.full(4, 1.5), rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3), 2.0 if prior > 0.9 else 0.1, prior)
    value, direction = pu.risk(net, p, pu.loss_sums(net, u, 0))
    assert value == pytest.approx(slow_risk(net, p, u))
    parts = sum(pu.loss_sums(net, x, 0) for x in (u[:7], u[7:]))  # as tasks add up
    assert pu.risk(net, p, parts)[0] == pytest.approx(value)
    back = pu.loss_sums(net, u, 0)[1] / 25 - prior * pu.loss_sums(net, p, 0)[1] / 15
    for k in range(len(direction)):
        step = np.zeros(len(direction))
        step[k] = 1e-5
        if back >= 0:
            slope = (slow_risk(pu._moved(net, step), p, u) - slow_risk(pu._moved(net, -step), p, u)) / 2e-5
        else:
            part = lambda n: pu.loss_sums(n, u, 0)[1] / 25 - prior * pu.loss_sums(n, p, 0)[1] / 15
            slope = -(part(pu._moved(net, step)) - part(pu._moved(net, -step))) / 2e-5
        assert direction[k] == pytest.approx(slope, abs=1e-6)


def test_sums_cover_all_rows(spark):
    rows = pu.described(data.documents(spark))
    x = np.array([r["features"] for r in rows.collect()])
    n, mean, deviation = pu.moments(rows)
    assert n == len(data.texts()) and mean == pytest.approx(x.mean(axis=0)) and deviation == pytest.approx(x.std(axis=0) + 1e-3, abs=1e-6)
    net = pu._train(x, x[::2], 0.5, 4, 2, 1, True)
    width = len(pu.loss_sums(net, x, 0))
    assert pu._summed(rows, width, lambda b: pu.loss_sums(net, b, 0)) == pytest.approx(pu.loss_sums(net, x, 0))
    found = pu.refine(net, x[:20], rows, 4)
    unlabelled = lambda m: pu.loss_sums(m, x, 0)
    assert pu.risk(found, x[:20], unlabelled(found))[0] <= pu.risk(net, x[:20], unlabelled(net))[0]


def test_query_scores_as_the_operator(spark, tmp_path):
    docs, labels, _ = corpus(spark, 200)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    net = pu.fit_quality(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op3_pu_quality(spark, str(tmp_path)).collect():
        assert r["score"] == pytest.approx(float(net.score(np.array([docstats.features(texts[r["doc_id"]])[1]]))[0]), abs=1e-6)


def test_prior():
    rng = np.random.default_rng(3)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 2000)
    assert pu.estimate_prior(p[:2000], np.concatenate([p[2000:], n])) == pytest.approx(0.5, abs=0.06)
