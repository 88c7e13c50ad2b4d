"""Ensembles of symmetric decision trees from their JSON export, as one expression: no library is needed to score them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.scores import sigmoid


@dataclass(frozen=True)
class Tree:
    """All nodes of a level ask the same question: splits (feature, border) from the lowest bit on, and a value for every combination of answers."""

    splits: tuple[tuple[int, float], ...]
    leaves: tuple[float, ...]


@dataclass(frozen=True)
class Trees:
    trees: tuple[Tree, ...]
    scale: float = 1.0
    bias: float = 0.0


def parse_trees(source: str | dict) -> Trees:
    """Checked trees: numbers finite, as many leaves as the splits have combinations, only numeric splits."""
    data = json.loads(source) if isinstance(source, str) else source
    trees = []
    for t in data["oblivious_trees"]:
        splits = []
        for s in t.get("splits") or ():
            if s.get("split_type", "FloatFeature") != "FloatFeature":
                raise ValueError(f"unknown split {s.get('split_type')!r}")
            splits.append((int(s["float_feature_index"]), float(s["border"])))
        leaves = tuple(float(x) for x in t["leaf_values"])
        if len(leaves) != 1 << len(splits):
            raise ValueError(f"{len(leaves)} leaves for {len(splits)} splits")
        if not all(map(math.isfinite, (*leaves, *(b for _, b in splits)))):
            raise ValueError("a border or leaf is not finite")
        trees.append(Tree(tuple(splits), leaves))
    scale, bias = data.get("scale_and_bias") or [1.0, [0.0]]
    return Trees(tuple(trees), float(scale), float(bias[0] if isinstance(bias, list) else bias))


def raw_score(trees: Trees, features: list[Column]) -> Column:
    """scale * the sum of the leaves + bias, in double precision; features are compared in single precision."""
    total = F.lit(0.0)
    for tree in trees.trees:
        place = F.lit(1)
        for bit, (feature, border) in enumerate(tree.splits):
            place = place + F.when(features[feature].cast("float") > F.lit(border).cast("float"), F.lit(1 << bit)).otherwise(F.lit(0))
        total = total + F.element_at(F.array(*[F.lit(x) for x in tree.leaves]), place)
    return total * F.lit(trees.scale) + F.lit(trees.bias)


def scored_by_trees(rows: DataFrame, trees: Trees, names: list[str]) -> DataFrame:
    """Rows with the raw score of the named features and its probability; a feature index beyond the names is an error."""
    most = max((f for t in trees.trees for f, _ in t.splits), default=-1)
    if most >= len(names):
        raise KeyError(f"no feature {most}")
    return rows.withColumn("raw", raw_score(trees, [F.col(n) for n in names])).withColumn("probability", sigmoid(F.col("raw")))
