"""A random forest of binary decision trees; each tree is grown by a task of its own."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

MAX_DEPTH = 12
MIN_LEAF = 2
CUTS = 32


def grow(x: np.ndarray, y: np.ndarray, seed: int, max_depth: int = MAX_DEPTH) -> np.ndarray:
    """One tree on a bootstrap sample, as rows (feature, cut, left, right, share of positives)."""
    rng = np.random.default_rng(seed)
    take = rng.integers(0, len(x), len(x))
    x, y = x[take], y[take].astype(np.float64)
    tried = max(1, int(round(np.sqrt(x.shape[1]))))
    nodes: list[list[float]] = []
    waiting = [(np.arange(len(x)), 0, -1, 0)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if parent >= 0:
            nodes[parent][2 + side] = here
        if depth == max_depth or len(rows) < 2 * MIN_LEAF or y[rows].min() == y[rows].max():
            continue
        best = (np.inf, -1, 0.0)
        for feature in rng.choice(x.shape[1], tried, replace=False):
            values = x[rows, feature]
            distinct = np.unique(values)
            if len(distinct) < 2:
                continue
            middles = (distinct[1:] + distinct[:-1]) / 2
            if len(middles) > CUTS:
                middles = np.sort(rng.choice(middles, CUTS, replace=False))
            below = values[:, None] <= middles
            n = below.sum(axis=0)
            ones = (below * y[rows][:, None]).sum(axis=0)
            rest, rest_ones = len(rows) - n, y[rows].sum() - ones
            impurity = ones * (n - ones) / np.maximum(n, 1) + rest_ones * (rest - rest_ones) / np.maximum(rest, 1)
            impurity[(n < MIN_LEAF) | (rest < MIN_LEAF)] = np.inf
            at = int(impurity.argmin())
            if impurity[at] < best[0]:
                best = (float(impurity[at]), int(feature), float(middles[at]))
        if best[1] < 0:
            continue
        nodes[here][0], nodes[here][1] = best[1], best[2]
        left = x[rows, best[1]] <= best[2]
        waiting += [(rows[~left], depth + 1, here, 1), (rows[left], depth + 1, here, 0)]
    return np.array(nodes, dtype=np.float64)


def train(spark: SparkSession, x: np.ndarray, y: np.ndarray, trees: int, seed: int = 11) -> list[np.ndarray]:
    """The trees. ``x`` and ``y`` are a bounded sample."""
    if not len(x):
        return [np.array([[-1, 0.0, -1, -1, 0.0]])]
    sent = spark.sparkContext.broadcast((x, y))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            grown = [grow(*sent.value, seed + int(i)).tobytes() for i in part["id"]]
            yield pd.DataFrame({"id": part["id"], "nodes": grown})

    rows = spark.range(0, trees, 1, min(trees, 8)).mapInPandas(run, "id bigint, nodes binary").collect()
    return [np.frombuffer(r["nodes"], dtype=np.float64).reshape(-1, 5) for r in sorted(rows, key=lambda r: r["id"])]


def probability(trees: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of positives over the leaves that each row falls into."""
    total = np.zeros(len(x))
    for nodes in trees:
        feature, left, right = nodes[:, 0].astype(int), nodes[:, 2].astype(int), nodes[:, 3].astype(int)
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= nodes[node, 1], left[node], right[node])
        total += nodes[at, 4]
    return total / len(trees)
