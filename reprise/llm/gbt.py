"""Gradient-boosted trees on binned features, with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points to itself, so every row can step ``depth`` times."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 4.0) -> Forest:
    """Boosted logistic regression trees. signs: per feature +1 (may only raise the score), -1 (may only lower it) or 0.

    A constrained split needs ordered child values, and the middle between them bounds all that lies below,
    so the whole forest is monotonic in that feature. Without rows, or with one class, it has no trees.
    """
    rate0 = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(rate0 / (1 - rate0)))
    cols: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        k = len(cols["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            cols[name].append(v)
        return k

    if len(set(y.tolist())) == 2:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)])
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = p - y, p * (1 - p)
            roots.append(root := node(0.0))
            level = [(root, np.arange(len(y)), -np.inf, np.inf)]
            for at in range(depth + 1):
                below = []
                for k, rows, lo, hi in level:
                    g, h = gradient[rows].sum(), weight[rows].sum()
                    cols["value"][k] = rate * float(np.clip(-g / (h + ridge), lo, hi))
                    best = (1e-6, None)
                    if at < depth:
                        for f, sign in enumerate(signs):
                            n = len(cuts[f]) + 1
                            c = codes[f][rows]
                            gl = np.bincount(c, gradient[rows], n).cumsum()[:-1]
                            hl = np.bincount(c, weight[rows], n).cumsum()[:-1]
                            gr, hr = g - gl, h - hl
                            vl, vr = (np.clip(-a / (b + ridge), lo, hi) for a, b in ((gl, hl), (gr, hr)))
                            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
                            v = np.clip(-g / (h + ridge), lo, hi)
                            gain += g * v + (h + ridge) * v**2 / 2
                            gain[(hl < least) | (hr < least) | (sign * (vr - vl) < 0)] = 0
                            if len(gain) and gain.max() > best[0]:
                                s = int(gain.argmax())
                                best = (gain[s], (f, s, vl[s], vr[s]))
                    if best[1] is None:
                        continue
                    f, s, vl, vr = best[1]
                    a, b = node(0.0), node(0.0)
                    cols["feature"][k], cols["threshold"][k], cols["left"][k], cols["right"][k] = f, float(cuts[f][s]), a, b
                    mid = (vl + vr) / 2
                    in_left = codes[f][rows] <= s
                    sign = signs[f]
                    below.append((a, rows[in_left], mid if sign < 0 else lo, mid if sign > 0 else hi))
                    below.append((b, rows[~in_left], mid if sign > 0 else lo, mid if sign < 0 else hi))
                level = below
            flat = _flat(cols, [root], depth, 0.0)
            margin = margin + flat.margin(x)
    return _flat(cols, roots, depth, base)


def _flat(cols: dict[str, list], roots: list[int], depth: int, base: float) -> Forest:
    arrays = [np.array(cols[k], t) for k, t in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float))]
    return Forest(*arrays, np.array(roots, np.int32), depth, base)
