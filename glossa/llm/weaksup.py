"""Weak supervision: accuracies of voters that abstain at will, by expectation-maximisation.

The voters' ballots over all documents are counted by pattern (at most 3^voters of
them, so the counts are small at any size); the rest runs on those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN, BAD, GOOD = 0, 1, 2


def encode(votes: np.ndarray) -> np.ndarray:
    """A number for each row of votes: its votes as digits of base 3."""
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def decode(patterns: np.ndarray, voters: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(voters, dtype=np.int64) % 3


@dataclass
class LabelModel:
    """prior: share of good documents; emit[class, voter, vote]: how often a voter that votes votes so for a class.

    Whether a voter abstains is taken to say nothing about the class, so abstaining has
    probability one.
    """

    prior: float
    emit: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of good for each row of votes."""
        say = np.log(self.emit)
        j = np.arange(votes.shape[1])
        bad, good = (say[c, j, votes].sum(axis=1) + np.log(p) for c, p in ((0, 1 - self.prior), (1, self.prior)))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Each voter's share of right votes among those that it casts."""
        weight = np.array([1 - self.prior, self.prior])
        right = weight[0] * self.emit[0, :, BAD] + weight[1] * self.emit[1, :, GOOD]
        cast = (weight[:, None, None] * self.emit)[:, :, [BAD, GOOD]].sum(axis=(0, 2))
        return right / np.maximum(cast, 1e-12)


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, smooth: float = 1.0, doubt: float = 0.1) -> LabelModel:
    """votes: one row a pattern; counts: documents of each.  Voters are taken to be independent given the class.

    Bad texts are bad in different ways, and a voter sees one of them; so the start is
    that any vote for bad is right but for `doubt`, which also says which class is
    which.  `smooth` documents are added to each cell, so no vote is impossible.
    """
    n = votes.shape[1]
    shown = np.stack([(votes == v) for v in (ABSTAIN, BAD, GOOD)], axis=2).astype(float)
    good = np.where((votes == BAD).any(axis=1), doubt, 1 - doubt)
    model = LabelModel(0.5, np.broadcast_to([1.0, 0.5, 0.5], (2, n, 3)))
    for _ in range(rounds if counts.sum() else 0):
        weight = np.stack([(1 - good) * counts, good * counts])
        emit = np.einsum("cp,pjv->cjv", weight, shown) + smooth / 2
        emit[:, :, ABSTAIN] = 0
        emit /= emit.sum(axis=2, keepdims=True)
        emit[:, :, ABSTAIN] = 1
        share = (weight[1].sum() + smooth) / (counts.sum() + 2 * smooth)
        model = LabelModel(float(np.clip(share, 0.01, 0.99)), emit)
        good = model.posterior(votes)
    return model
