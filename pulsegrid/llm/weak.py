"""Weak supervision: a generative model of voters, and a sparse hashed linear model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class LabelModel:
    """P(votes, y) with votes in {0, 1}: every vote depends on y and, along a tree, on one other vote.

    ``table[y, j, p]`` is the probability that voter j votes 1, given y and that its parent votes p
    (p = 0 for a root).
    """

    prior: float
    parent: np.ndarray
    table: np.ndarray
    correlation: dict[tuple[int, int], float] = field(default_factory=dict)

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """``(patterns, 2)`` of log P(votes, y)."""
        voters = np.arange(votes.shape[1])
        given = np.where(self.parent[None, :] >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        out = np.empty((len(votes), 2))
        for y, p in ((0, 1 - self.prior), (1, self.prior)):
            one = self.table[y, voters[None, :], given]
            out[:, y] = np.log(p) + np.log(np.where(votes == 1, one, 1 - one)).sum(axis=1)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        joint = self.log_joint(votes)
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))

    def accuracies(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """``(voters, 2)``: P(vote 1 | y) under the model's posteriors."""
        q = self.posterior(votes)
        return np.stack([
            (votes * (weight * p)[:, None]).sum(axis=0) / max((weight * p).sum(), 1e-9) for p in (1 - q, q)
        ], axis=1)


def unpack(patterns: np.ndarray, voters: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(voters)) & 1


def _tree(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict]:
    """The tree of greatest mutual information between votes given y; ``weight`` is (patterns, 2)."""
    n = votes.shape[1]
    info = np.zeros((n, n))
    total = max(weight.sum(), 1e-9)
    for y in (0, 1):
        w = weight[:, y]
        mass = w.sum() + 2.0
        one = (votes * w[:, None]).sum(axis=0) + 1.0
        both = (votes * w[:, None]).T @ votes
        for a, b, joint in (
            (one, one, both), (one, mass - one, one[:, None] - 1 - both),
            (mass - one, one, one[None, :] - 1 - both),
            (mass - one, mass - one, mass - 2 - one[:, None] - one[None, :] + 2 + both),
        ):
            p = np.maximum(joint, 0) + 0.5
            info += (w.sum() / total) * (p / mass) * np.log(p * mass / (a[:, None] * b[None, :]))
    parent, inside, found = np.full(n, -1), [0], {}
    while len(inside) < n:
        rest = [j for j in range(n) if j not in inside]
        gains = info[np.ix_(inside, rest)]
        i, j = np.unravel_index(gains.argmax(), gains.shape)
        parent[rest[j]] = inside[i]
        found[(inside[i], rest[j])] = float(gains[i, j])
        inside.append(rest[j])
    return parent, found


def fit_label_model(
    votes: np.ndarray, weight: np.ndarray, known: np.ndarray, start: np.ndarray, correlated: bool, rounds: int = 60,
) -> LabelModel:
    """Expectation-maximisation over vote patterns, each seen ``weight`` times.

    ``known`` is 0 or 1 for patterns of rows with a label and -1 for the others, whose posterior
    begins at ``start``.  ``correlated`` also learns, along a tree, which voters depend on another.
    """
    n = votes.shape[1]
    q = np.where(known >= 0, known, start).astype(float)
    model = LabelModel(0.5, np.full(n, -1), np.full((2, n, 2), 0.5))
    for step in range(rounds):
        soft = np.stack([weight * (1 - q), weight * q], axis=1)
        parent, found = _tree(votes, soft) if correlated and step >= 3 and n > 1 else (np.full(n, -1), {})
        table = np.empty((2, n, 2))
        given = np.where(parent[None, :] >= 0, votes[:, np.maximum(parent, 0)], 0)
        for y in (0, 1):
            plain = ((votes * soft[:, y:y + 1]).sum(axis=0) + 0.1) / (soft[:, y].sum() + 1.0)
            for p in (0, 1):
                mass = (soft[:, y:y + 1] * (given == p)).sum(axis=0)
                table[y, :, p] = ((votes * soft[:, y:y + 1] * (given == p)).sum(axis=0) + plain) / (mass + 1.0)
        prior = min(max((soft[:, 1].sum() + 0.5) / (soft.sum() + 1.0), 1e-4), 1 - 1e-4)
        model = LabelModel(prior, parent, np.clip(table, 1e-6, 1 - 1e-6), found)
        fresh = np.where(known >= 0, known, model.posterior(votes))
        settled, q = np.abs(fresh - q).max(initial=0) < 1e-6, fresh
        if settled and step > 5:
            break
    return model


def fit_linear(
    ids: np.ndarray, owner: np.ndarray, target: np.ndarray, weight: np.ndarray, buckets: int,
    l1: float = 2e-4, rounds: int = 200,
) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on presence features: weights and intercept.

    Row ``owner[k]`` has feature ``ids[k]``; ``target`` are soft labels, ``weight`` the rows' weights.
    Proximal gradient steps with a step size per feature; momentum restarts when the loss rises.
    """
    rows = len(target)
    if not rows or weight.sum() <= 0:
        return np.zeros(buckets), -3.0
    weight = weight / weight.sum()
    size = np.bincount(owner, minlength=rows) + 1.0
    bound = 0.25 * np.bincount(ids, weights=(weight * size)[owner], minlength=buckets) + 1e-9
    bound0 = 0.25 * float((weight * size).sum())
    mean = float(np.clip((weight * target).sum(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(buckets), float(np.log(mean / (1 - mean)))
    v, c, speed, last = w.copy(), b, 1.0, np.inf
    for _ in range(rounds):
        z = np.bincount(owner, weights=v[ids], minlength=rows) + c
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss = float((weight * (np.logaddexp(0, z) - target * z)).sum() + l1 * np.abs(v).sum())
        if loss > last:
            speed = 1.0
        last = loss
        residual = weight * (p - target)
        moved = v - np.bincount(ids, weights=residual[owner], minlength=buckets) / bound
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - l1 / bound, 0)
        fresh0 = c - residual.sum() / bound0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        v = fresh + (speed - 1) / faster * (fresh - w)
        c = fresh0 + (speed - 1) / faster * (fresh0 - b)
        w, b, speed = fresh, fresh0, faster
    return w, b
