import numpy as np

from reprise.operators import similarity


def _programmes(a, b):
    common, edits = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a):
        now, new = [0], [i + 1]
        for j, y in enumerate(b):
            now.append(common[j] + 1 if x == y else max(common[j + 1], now[-1]))
            new.append(min(edits[j + 1] + 1, new[-1] + 1, edits[j] + (x != y)))
        common, edits = now, new
    return common[-1], edits[-1], sum(x == y for x, y in zip(a, b, strict=False))


def test_long_pairs_are_right():
    r = np.random.default_rng(3)
    a, b = [], []
    for n in (0, 1, 5, 10, 63, 64, 65, 66, 130, 200):
        for values in (2, 40, 1 << 40):
            x = r.integers(-3, values, n)
            changed = np.where(r.random(n) < 0.3, r.integers(-3, values, n), x)
            for y in (x, changed, np.roll(changed, 1), changed[3:], r.integers(-3, values, 70), x[:0]):
                a += [x, y]
                b += [y, x]
    want = [_programmes(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    assert [tuple(map(int, found)) for found in zip(*similarity.programmes(a, b), strict=True)] == want


def test_a_long_pair_does_not_stretch_short_ones(monkeypatch):
    cells, padded = [], similarity._padded

    def counted(values, offsets, rows, width, fill):
        cells.append(len(rows) * width)
        return padded(values, offsets, rows, width, fill)

    monkeypatch.setattr(similarity, "_padded", counted)
    rows = [np.arange(10)] * 300 + [np.arange(30)] * 5 + [np.arange(500)]
    common, edits, equal = similarity.programmes(rows, rows)
    assert common.tolist() == equal.tolist() == [len(x) for x in rows] and not edits.any()
    assert sum(cells) <= 4 * 2 * sum(map(len, rows))


def test_out_of_reach_pairs_are_left_out_before_the_programmes(spark):
    r = np.random.default_rng(4)
    rows = [(k, r.integers(0, 6, n).tolist(), r.integers(0, 6, m).tolist()) for k, (n, m) in enumerate([(0, 0), (0, 3), (10, 10), (70, 66), *([(10, 10), (9, 7), (40, 40)] * 60)])]
    rows += [(len(rows) + k, [*range(10)], [*range(9 - k), *range(50, 51 + k)]) for k in range(9)]
    df = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>")
    whole = {tuple(x) for x in similarity.score_pairs(df, "a", "b").collect()}
    some = {tuple(x) for x in similarity.score_pairs(df, "a", "b", least=0.75).collect()}
    assert some <= whole and {x for x in whole if x[4] >= 0.75} <= some
    assert len(some) < len(whole)
