"""Fitted regression trees as flat arrays: predictions and exact path-dependent Shapley values.

A leaf's share in the prediction, where only the features of a set S are known, is its value times a factor for each
feature on its path: whether the row follows all of that feature's splits, if it is in S, and otherwise the share of the
training rows that did. Such a product's Shapley values are an integral over t in [0, 1] of the other features' factors
z + t (o - z), a polynomial, which Gauss and Legendre's nodes give exactly. So a leaf needs no subsets, and a batch of
rows is one array expression for each leaf: equal patterns of followed features are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first; feature is -1 at a leaf. Left if value <= threshold, or in the node's categories."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    missing_left: np.ndarray
    categories: dict = field(default_factory=dict)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature[node]]
        known = np.isin(column, self.categories[node]) if node in self.categories else column <= self.threshold[node]
        return np.where(np.isnan(column), self.missing_left[node], known)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, open_ = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(open_):
            open_ = open_[self.feature[at[open_]] >= 0]
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                at[rows] = np.where(self.goes_left(node, x[rows]), self.left[node], self.right[node])
        return self.value[at]

    @cached_property
    def leaves(self) -> list[tuple[float, np.ndarray, np.ndarray, list[list[tuple[int, bool]]]]]:
        """(value, features, their shares of training rows, their splits as (node, left)) of every leaf."""
        out, stack = [], [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                by: dict[int, list] = {}
                for n, is_left in path:
                    by.setdefault(int(self.feature[n]), []).append((n, is_left))
                shares = [np.prod([self.cover[self.left[n] if is_left else self.right[n]] / self.cover[n] for n, is_left in steps]) for steps in by.values()]
                out.append((float(self.value[node]), np.array(list(by), dtype=np.int64), np.array(shares, dtype=float), list(by.values())))
            else:
                stack += [(int(self.right[node]), [*path, (node, False)]), (int(self.left[node]), [*path, (node, True)])]
        return out


def product_shapley(follows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of the product over features of (follows if known, else share), by row and feature."""
    m = len(shares)
    t, w = np.polynomial.legendre.leggauss((m + 1) // 2)
    t, w = (t + 1) / 2, w / 2
    gain = follows - shares
    factors = shares + t[:, None, None] * gain
    before, after = np.ones_like(factors), np.ones_like(factors)
    np.cumprod(factors[:, :, :-1], axis=2, out=before[:, :, 1:])
    after[:, :, :-1] = np.cumprod(factors[:, :, :0:-1], axis=2)[:, :, ::-1]
    return gain * np.tensordot(w, before * after, 1)


@dataclass(frozen=True)
class TreeEnsemble:
    """The sum of trees over features in a fixed order, and a constant; predict(frame) makes it a Model's estimator."""

    trees: tuple[Tree, ...]
    bias: float = 0.0

    @staticmethod
    def of(estimator: object) -> TreeEnsemble:
        return as_trees(estimator)

    @property
    def nbytes(self) -> int:
        return sum(sum(a.nbytes for a in (t.feature, t.threshold, t.left, t.right, t.value, t.cover, t.missing_left)) for t in self.trees)

    def predict(self, frame) -> np.ndarray:
        x = np.asarray(frame, dtype=float)
        return self.bias + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    @cached_property
    def base(self) -> float:
        """The prediction where nothing is known."""
        return self.bias + sum(v * shares.prod() for t in self.trees for v, _, shares, _ in t.leaves)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values by row and feature; with base they sum to the prediction."""
        out = np.zeros(x.shape)
        for tree in self.trees:
            left = {int(n): tree.goes_left(n, x) for n in np.flatnonzero(tree.feature >= 0)}
            for value, features, shares, splits in tree.leaves:
                if not len(features):
                    continue
                follows = np.stack([np.logical_and.reduce([left[n] == is_left for n, is_left in steps]) for steps in splits], axis=1)
                patterns, which = np.unique(follows, axis=0, return_inverse=True)
                out[:, features] += value * product_shapley(patterns.astype(float), shares)[which.reshape(-1)]
        return out


def _flat(nodes: list, categories: dict) -> Tree:
    feature, threshold, left, right, value, cover, missing = zip(*nodes, strict=True)
    tree = Tree(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), np.array(cover, float), np.array(missing, bool), categories)
    if (tree.cover <= 0).any():
        raise ValueError("every node needs its number of training rows")
    return tree


def from_nested(spec: tuple) -> Tree:
    """A tree written as (feature, threshold, training rows, left, right), its leaves as (value, training rows)."""
    nodes, todo = [], [(spec, None, None)]
    while todo:
        node, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][side] = at
        if len(node) == 2:
            nodes.append([-1, 0.0, -1, -1, node[0], node[1], False])
        else:
            nodes.append([node[0], node[1], -1, -1, 0.0, node[2], False])
            todo += [(node[4], at, 3), (node[3], at, 2)]
    return _flat(nodes, {})


def from_spark(model) -> TreeEnsemble:
    """A fitted DecisionTree-, RandomForest- or GBTRegressionModel of spark.ml."""
    java, kind = model._java_obj, type(model).__name__
    if kind == "DecisionTreeRegressionModel":
        roots, weights = [java.rootNode()], [1.0]
    elif kind in ("RandomForestRegressionModel", "GBTRegressionModel"):
        roots = [t.rootNode() for t in java.trees()]
        weights = list(java.treeWeights()) if kind.startswith("GBT") else [1.0 / len(roots)] * len(roots)
    else:
        raise ValueError(f"no regression trees: {kind}")
    trees = []
    for root, weight in zip(roots, weights, strict=True):
        nodes, categories, todo = [], {}, [(root, None, None)]
        while todo:
            node, parent, side = todo.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent][side] = at
            cover = float(node.impurityStats().count())
            if node.getClass().getSimpleName() == "LeafNode":
                nodes.append([-1, 0.0, -1, -1, weight * node.prediction(), cover, False])
                continue
            split = node.split()
            if split.getClass().getSimpleName() == "CategoricalSplit":
                categories[at] = np.array(list(split.leftCategories()), dtype=float)
                nodes.append([split.featureIndex(), np.nan, -1, -1, 0.0, cover, False])
            else:
                nodes.append([split.featureIndex(), split.threshold(), -1, -1, 0.0, cover, False])
            todo += [(node.rightChild(), at, 3), (node.leftChild(), at, 2)]
        trees.append(_flat(nodes, categories))
    return TreeEnsemble(tuple(trees))


def from_dump(dump: dict) -> TreeEnsemble:
    """A boosted model's nested dump: tree_info[].tree_structure with split_feature, threshold, decision_type,
    default_left, missing_type, internal_count and children, or leaf_value and leaf_count."""
    if any(x in str(dump.get("objective", "")) for x in ("binary", "multiclass", "cross_entropy", "rank")) or dump.get("num_class", 1) != 1:
        raise ValueError("one number for each row is needed: a regression without a link")
    infos, trees = dump["tree_info"], []
    weight = 1.0 / len(infos) if dump.get("average_output") else 1.0
    for info in infos:
        nodes, categories, todo = [], {}, [(info["tree_structure"], None, None)]
        while todo:
            node, parent, side = todo.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent][side] = at
            if "leaf_value" in node:
                nodes.append([-1, 0.0, -1, -1, weight * node["leaf_value"], node.get("leaf_count", 1), False])
                continue
            threshold, missing = node["threshold"], node.get("missing_type", "None")
            if missing == "Zero":
                raise ValueError("zeros that stand for missing values aren't supported")
            if node.get("decision_type", "<=") == "==":
                categories[at] = np.array(str(threshold).split("||"), dtype=float)
                threshold, left = np.nan, False
            else:
                # without a missing type, a missing value counts as zero
                left = bool(node.get("default_left", True)) if missing == "NaN" else 0.0 <= threshold
            nodes.append([node["split_feature"], threshold, -1, -1, 0.0, node["internal_count"], left])
            todo += [(node["right_child"], at, 3), (node["left_child"], at, 2)]
        trees.append(_flat(nodes, categories))
    return TreeEnsemble(tuple(trees))


def as_trees(estimator: object) -> TreeEnsemble:
    """The trees of an estimator; pipelines, whose inputs aren't the trees', are refused."""
    if isinstance(estimator, TreeEnsemble):
        return estimator
    if hasattr(estimator, "steps") or hasattr(estimator, "stages"):
        raise ValueError("give the fitted trees and their prepared features, not a pipeline")
    if hasattr(estimator, "_java_obj"):
        return from_spark(estimator)
    if hasattr(estimator, "dump_model"):
        return from_dump(estimator.dump_model())
    if isinstance(estimator, dict):
        return from_dump(estimator)
    raise ValueError("no trees are known of this estimator; permutation importance needs none")
