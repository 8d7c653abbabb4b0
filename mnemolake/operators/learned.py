"""A softmax classifier of policy operations, and random search over ranker parameters."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.numbers import softmax
from mnemolake.functions.policy import FEATURES


def likeliest(p: dict[str, float], feasible: list[str]) -> str:
    """The feasible operation of the highest probability; the smaller name among equals."""
    return min(feasible, key=lambda op: (-p.get(op, 0.0), op))


@dataclass
class PolicyModel:
    labels: list[str]
    weights: dict[str, list[float]]
    """Bias first, then one weight for each feature."""
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    @classmethod
    def train(cls, examples: list[tuple[str, dict[str, float]]], labels: list[str] | None = None, epochs: int = 500, rate: float = 0.4, l2: float = 0.001) -> PolicyModel:
        """Softmax regression by ordered gradient steps, which is sequential by definition: one example after the other, zero start,
        step rate / sqrt(epoch + 1), L2 on all but the bias. examples: (label, features), a bounded set on the driver.
        """
        if not examples or epochs < 1 or rate <= 0 or l2 < 0:
            raise ValueError("examples and positive epochs and rate are needed")
        order = list(dict.fromkeys([*(labels or []), *sorted({x for x, _ in examples})]))
        x = np.array([[1.0] + [min(1.0, max(0.0, float(f.get(n, 0.0)))) for n in FEATURES] for _, f in examples])
        y = np.array([order.index(label) for label, _ in examples])
        w = np.zeros((len(order), x.shape[1]))
        keep = np.ones(x.shape[1])
        keep[0] = 0.0
        for epoch in range(epochs):
            step = rate / np.sqrt(epoch + 1.0)
            for row, target in zip(x, y):
                z = w @ row
                p = np.exp(z - z.max())
                error = -p / p.sum()
                error[target] += 1.0
                w += step * (error[:, None] * row[None] - l2 * w * keep)
        return cls(order, {k: [float(v) for v in w[i]] for i, k in enumerate(order)})

    def probabilities(self, f: dict[str, float]) -> dict[str, float]:
        row = np.array([1.0] + [min(1.0, max(0.0, f.get(n, 0.0))) for n in self.features])
        z = np.array([np.dot(w, row) for w in self._rows])
        p = np.exp(z - z.max())
        return dict(zip(self.labels, (p / p.sum()).tolist()))

    @cached_property
    def _rows(self) -> list[np.ndarray]:
        return [np.array(self.weights[k]) for k in self.labels]

    def choose(self, f: dict[str, float], feasible: list[str]) -> str:
        """The likeliest feasible operation; the smaller name among equals."""
        return likeliest(self.probabilities(f), feasible)

    def columns(self) -> Column:
        """Probabilities in the order of labels, from columns named after the features."""
        logits = []
        for k in self.labels:
            w = self.weights[k]
            z = F.lit(w[0])
            for n, v in zip(self.features, w[1:]):
                z = z + F.lit(v) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(n)))
            logits.append(z)
        return softmax(F.array(*logits))

    def to_json(self) -> str:
        return json.dumps({"labels": self.labels, "weights": self.weights, "features": self.features})

    @classmethod
    def from_json(cls, text: str) -> PolicyModel:
        return cls(**json.loads(text))


# fixed values: ranges of the random search, in drawing order, and weights of its objective
RANGES = {
    "semantic_relevance": (0.0, 0.0), "importance": (0.0, 0.0), "scope_match": (0.0, 0.0), "confidence": (0.0, 0.0), "success_contribution": (0.0, 0.0), "recency": (0.0, 0.40),
    "contradiction": (-0.20, 0.10), "redundancy": (-0.15, 0.0), "token_cost": (-0.10, 0.0), "staleness": (-0.20, 0.0), "update_signal": (0.0, 0.50), "action_signal": (0.0, 0.20),
}
FUSION = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40)
OBJECTIVE = {"recall_all_5": 0.80, "macro_type": 0.35, "worst_type": 0.15, "mrr": 0.40, "fold_stddev": -0.20, "token_cost": -0.05, "stale_rate": -0.10, "conflict_rate": -0.10}


def trials(n: int, seed: int) -> list[dict]:
    """Parameters of n trials: dense only, then mixes of dense and BM25, then seeded draws."""
    none = dict.fromkeys(RANGES, 0.0)
    out = [{"trial": i, "weights": none, "semantic": 1.0 - x, "lexical": x, "limit": 0.0, "penalty": 0.0, "protect": 5, "margin": 0.0} for i, x in enumerate((0.0, *FUSION))][:n]
    rng = random.Random(seed)
    while len(out) < n:
        weights = {k: rng.uniform(*r) for k, r in RANGES.items()}
        semantic = rng.uniform(0.70, 1.0)
        out.append({"trial": len(out), "weights": weights, "semantic": semantic, "lexical": 1.0 - semantic, "limit": rng.uniform(0.0, 0.15), "penalty": rng.uniform(0.0, 0.02), "protect": rng.choice((4, 5)), "margin": rng.uniform(0.01, 0.06)})
    return out


def objective(values: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for k, w in OBJECTIVE.items():
        if k in values:
            total = total + F.lit(w) * values[k]
    return total


def gate(metrics: dict[str, float]) -> dict[str, bool]:
    """Whether a trained ranker may be used: recall, its gain over dense overall and by type, and stability over folds."""
    return {
        # fixed values: thresholds of the gate
        "recall": metrics["recall_all_5"] >= 0.90, "gain": metrics["recall_all_5"] - metrics["dense_recall_all_5"] >= 0.02, "macro": metrics["macro_gain"] >= 0.0,
        "worst": metrics["worst_gain"] >= -0.03, "stable": metrics["fold_stddev"] <= 0.20, "head": metrics.get("top10_preserved", 1.0) >= 1.0,
    }
