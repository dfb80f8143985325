"""Quality classifier by positive-unlabelled learning.

The network sees trusted positives and unlabelled web text, never a negative label. The class prior comes from the
data too: among texts that score above a threshold, the unlabelled share over the positives' share is at least the
prior, and near it where negatives are rare. Training minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
Bounded samples give a first network. The centre and scale of the inputs, the prior and the last steps down the risk are sums
over all unlabelled texts, made by each task over its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.docstats import FEATURES, features
from reprise.llm.labelled import fold, sample, with_features
from reprise.storage import materialize

FOLDS = 5
THRESHOLD = 0.3


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _train(p: np.ndarray, u: np.ndarray, prior: float, units: int, epochs: int, seed: int, unbiased: bool, inputs: tuple | None = None) -> Network:
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    centre, scale = inputs or (both.mean(axis=0), both.std(axis=0) + 1e-3)
    net = Network(centre, scale, rng.normal(0, 0.4, (p.shape[1], units)), np.zeros(units), rng.normal(0, 0.4, units), 0.0, prior)
    p, u = net.inputs(p), net.inputs(u)
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (net.w1, net.b1, net.w2, np.zeros(1))]
    step, half = 0, 256
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for _ in range(max(1, len(u) // half)):
            x = np.concatenate([p[rng.integers(len(p), size=half)], u[rng.integers(len(u), size=half)]])
            hidden = np.tanh(x @ net.w1 + net.b1)
            z = np.clip(hidden @ net.w2 + net.b2, -40, 40)
            up = 1 / (1 + np.exp(-z))  # the gradient of log(1 + e^z); of log(1 + e^-z) it is up - 1
            d = np.zeros_like(z)
            if unbiased:
                loss_minus = np.logaddexp(0, z)
                rest = loss_minus[half:].mean() - prior * loss_minus[:half].mean()
                if rest >= 0:
                    d[:half] = prior * (up[:half] - 1) / half - prior * up[:half] / half
                    d[half:] = up[half:] / half
                else:  # climb back: only the negative part's gradient, turned round
                    d[:half] = prior * up[:half] / half
                    d[half:] = -up[half:] / half
            else:  # positives against unlabelled, to estimate the prior
                d[:half] = (up[:half] - 1) / half
                d[half:] = up[half:] / half
            back = np.outer(d, net.w2) * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * net.w1, back.sum(axis=0), hidden.T @ d + 1e-4 * net.w2, np.array([d.sum()])]
            step += 1
            moves = []
            for g, s in zip(grads, state, strict=True):
                s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
                moves.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    return net


def _cuts(positive: np.ndarray, least_share: float = 0.3) -> np.ndarray:
    """Scores that leave at least ``least_share`` of the positives, for a steady ratio of shares."""
    return np.quantile(positive, np.linspace(0, 1 - least_share, 60))


def _least_ratio(positive: np.ndarray, cuts: np.ndarray, unlabelled_share: np.ndarray) -> float:
    ratio = [(share + 1e-9) / (positive >= c).mean() for c, share in zip(cuts, unlabelled_share, strict=True)]
    return float(np.clip(min(ratio), 0.05, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of the shares above a score, over scores that leave enough positives; in [0.05, 0.98]."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = _cuts(positive)
    return _least_ratio(positive, cuts, np.array([(unlabelled >= c).mean() for c in cuts]))


def _blank(k: int) -> Network:
    return Network(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)


def fit(x: np.ndarray, y: np.ndarray, units: int = 24, epochs: int = 24, seed: int = 5) -> Network:
    """x, y: rows with y 1 (trusted positive) or -1 (unlabelled). Rows with label 0 aren't used.

    Without positives or unlabelled rows every text scores 0.5.
    """
    p, u = x[y == 1], x[y == -1]
    if len(p) < 2 or len(u) < 2:
        return _blank(x.shape[1] if x.ndim == 2 and x.shape[1] else len(FEATURES))
    against = _train(p[::2], u[::2], 0.5, units, max(6, epochs // 2), seed, False)
    prior = estimate_prior(against.margin(p[1::2]), against.margin(u[1::2]))
    return _train(p, u, prior, units, epochs, seed + 1, True)


# --- sums over all rows --------------------------------------------------------------------------------------------


def described(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, half (which of two halves of the ids), features."""
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), (F.xxhash64("doc_id", F.lit(13)) % 2 == 0).alias("half"), "text")
    return with_features(rows, "doc_id", "held_out", "half")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, width: int, of) -> np.ndarray:
    """The sum of of(features of a batch), ``width`` numbers, over all ``rows``: each task adds up its own, so width rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()), "v": pa.array(total)})

    out = np.zeros(width)
    for r in rows.select("features").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, deviation) of the features."""
    k = len(FEATURES)
    total = _summed(rows, 2 * k + 1, lambda x: np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)])
    n = max(1.0, total[0])
    mean = total[1 : k + 1] / n
    return int(total[0]), mean, np.sqrt(np.maximum(total[k + 1 :] / n - mean * mean, 0)) + 1e-3


def loss_sums(net: Network, x: np.ndarray, label: int) -> np.ndarray:
    """Rows, their summed logistic loss if all had ``label`` (1 or 0), and its gradient by w1, b1, w2, b2, one after another."""
    inputs = net.inputs(x)
    hidden = np.tanh(inputs @ net.w1 + net.b1)
    z = np.clip(hidden @ net.w2 + net.b2, -40, 40)
    d = 1 / (1 + np.exp(-z)) - label
    back = np.outer(d, net.w2) * (1 - hidden**2)
    return np.r_[len(x), np.logaddexp(0, -z if label else z).sum(), (inputs.T @ back).ravel(), back.sum(axis=0), hidden.T @ d, d.sum()]


def _moved(net: Network, by: np.ndarray) -> Network:
    k, units = net.w1.shape
    w1, b1, w2, b2 = np.split(by, [k * units, (k + 1) * units, (k + 2) * units])
    return replace(net, w1=net.w1 + w1.reshape(k, units), b1=net.b1 + b1, w2=net.w2 + w2, b2=net.b2 + float(b2[0]))


def risk(net: Network, p: np.ndarray, unlabelled: np.ndarray) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk, and the direction to leave in. unlabelled: loss_sums of all unlabelled rows with label 0.

    Where the negative part is below 0, it counts as 0, and the direction is that which brings it back up.
    """
    plus, minus = loss_sums(net, p, 1), loss_sums(net, p, 0)
    positive = net.prior * plus[1:] / plus[0]
    negative = unlabelled[1:] / unlabelled[0] - net.prior * minus[1:] / minus[0]
    if negative[0] < 0:
        return float(positive[0]), -negative[1:]
    return float(positive[0] + negative[0]), (positive + negative)[1:]


def refine(net: Network, p: np.ndarray, rows: DataFrame, passes: int = 10, rate: float = 0.01) -> Network:
    """Steps down the risk of the positives ``p`` and all ``rows``, one pass over them a step; the network of the least risk seen."""
    width = len(loss_sums(net, p[:1], 0))
    best, least = net, np.inf
    first, second = np.zeros(width - 2), np.zeros(width - 2)
    for step in range(1, passes + 1):
        value, gradient = risk(net, p, _summed(rows, width, lambda x, net=net: loss_sums(net, x, 0)))
        if value < least:
            best, least = net, value
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        net = _moved(net, -rate / step**0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
    return best


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_start: int = 20_000, units: int = 24, epochs: int = 24, seed: int = 5, rows: DataFrame | None = None) -> Network:
    """The network from a bounded sample of trusted positives and all unlabelled text, none from the held-out fold.

    rows: described(docs), where it is at hand. At most ``max_start`` unlabelled rows, by the hash of their id, give the network that the passes
    over all of them start from. Ids with several texts count as each of them; null ids, and labels without a document, don't count.
    """
    rows = materialize(described(docs), "described") if rows is None else rows
    inside = rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    positives = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0)).select("doc_id").distinct()
    # at most max_labelled + max_start ids of 12 bytes
    ids = sample(positives, max_labelled, 7).select("doc_id", F.lit(1).alias("y")).unionByName(sample(inside.select("doc_id"), max_start, 11).select("doc_id", F.lit(-1).alias("y")))
    found = inside.join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id", "y", "half").agg(F.min("features").alias("features")).orderBy("doc_id", "y").toPandas()
    x, y, half = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES)), found["y"].to_numpy(int), found["half"].to_numpy(bool)
    p, u = x[y == 1], x[y == -1]
    p1, p2, u1 = x[(y == 1) & half], x[(y == 1) & ~half], x[(y == -1) & half]
    if min(map(len, (p1, p2, u1))) < 1 or min(len(p), len(u)) < 2:
        return _blank(len(FEATURES))
    _, centre, scale = moments(inside)
    against = _train(p1, u1, 0.5, units, max(6, epochs // 2), seed, False, (centre, scale))
    margins = against.margin(p2)
    cuts = _cuts(margins)
    above = _summed(inside.where("not half"), len(cuts) + 1, lambda x: np.r_[len(x), (against.margin(x)[:, None] >= cuts).sum(axis=0)])
    prior = _least_ratio(margins, cuts, above[1:] / above[0]) if above[0] else 0.5
    return refine(_train(p, u, prior, units, epochs, seed + 1, True, (centre, scale)), p, inside)


def score_described(rows: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """score_quality of the texts that ``rows`` (described) stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = net.score(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "features").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Only the text is an input of the score.

    Null texts score as empty ones; null ids count as held out; repeated rows score alike; an empty table gives no rows.
    """
    return score_described(described(docs), net, threshold)


def keep_quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                x = np.array([features(t)[1] for t in rows.column("text").to_pylist()])
                yield rows.filter(pa.array(net.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
