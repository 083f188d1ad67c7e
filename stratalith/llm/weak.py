"""Weak supervision: a generative label model over many noisy voters, and linear models on its labels.

All of it works on arrays in the driver: votes are a matrix of rows by voters, of a bounded sample or
of the patterns of votes of all rows, each with its number.
"""

from __future__ import annotations


class LabelModel:
    """Accuracies and correlations of voters by expectation-maximisation.

    A vote is 1, 0, or -1 for abstaining. For either class each voter has a probability of each of
    its three answers. Voters that agree beyond what the class explains are no independent evidence:
    their correlation given the class is estimated once the first rounds have told the classes
    apart, and a voter's log odds are divided by one plus the sum of its correlations with the others.

    Fields after ``fit``: ``prior``, ``answers`` (voters, 2 classes, 3 answers), ``correlation``
    (voters, voters), ``weight`` (voters), ``accuracy`` (voters: the share of its votes that are right).
    """

    def __init__(self, start, prior: float = 0.1, rounds: int = 30, smooth: float = 2.0, anchor: bool = False):
        """start: for each voter a first guess of its accuracy where it votes.

        anchor: the last voter is a given label, whose accuracy and prior are not estimated anew.
        """
        self.start, self.prior, self.rounds, self.smooth, self.anchor = start, prior, rounds, smooth, anchor

    def fit(self, votes, weights=None) -> LabelModel:
        """weights: how many times each row of votes counts, else once."""
        import numpy as np

        votes = np.asarray(votes)
        n, m = votes.shape
        weights = np.ones(n) if weights is None else np.asarray(weights, dtype=np.float64)
        onehot = np.stack([votes == v for v in (0, 1, -1)], axis=2).astype(np.float64)
        start = np.asarray(self.start, dtype=np.float64)
        share = np.average(onehot, axis=0, weights=weights)
        # A voter's first table: votes as often as it does, right as often as is guessed.
        casts = np.clip(share[:, 0] + share[:, 1], 1e-6, 1)
        self.answers = np.stack([np.stack([(1 - start) * casts, start * casts, 1 - casts], axis=1)] * 2, axis=1)
        self.answers[:, 0] = np.stack([start * casts, (1 - start) * casts, 1 - casts], axis=1)
        fires = (share[:, 0] == 0) & (share[:, 1] > 0)
        # Of a voter that only ever says 1, being right is a matter of where it speaks.
        hit = np.clip(start * share[:, 1] / self.prior, 1e-4, 0.99)
        miss = np.clip((1 - start) * share[:, 1] / (1 - self.prior), 1e-6, 0.99)
        self.answers[fires, 1] = np.stack([np.zeros(m), hit, 1 - hit], axis=1)[fires]
        self.answers[fires, 0] = np.stack([np.zeros(m), miss, 1 - miss], axis=1)[fires]
        self.answers = np.clip(self.answers, 1e-6, 1)
        self._correlate(onehot, np.zeros(n), weights)
        # Before any posterior is known, only voters that are all but copies share their weight.
        self.weight = 1 / np.where(self.correlation > 0.6, self.correlation, 0).sum(axis=1).clip(1)
        given = self.answers[-1].copy()
        for turn in range(self.rounds):
            p = self.posterior(votes)
            for c, w in ((0, weights * (1 - p)), (1, weights * p)):
                counts = np.einsum("n,nmv->mv", w, onehot)
                self.answers[:, c] = (counts + self.smooth * share + 1e-6) / (w.sum() + self.smooth + 3e-6)
            if self.anchor:
                self.answers[-1] = given
            else:
                self.prior = float(np.clip(np.average(p, weights=weights), 1e-3, 1 - 1e-3))
            if turn == 4:
                self._correlate(onehot, p, weights)
        right = self.answers[:, 1, 1] * self.prior + self.answers[:, 0, 0] * (1 - self.prior)
        cast = (self.answers[:, :, :2].sum(axis=2) * np.array([1 - self.prior, self.prior])).sum(axis=1)
        self.accuracy = right / np.clip(cast, 1e-9, None)
        return self

    def _correlate(self, onehot, p, weights) -> None:
        """Correlation of the voters' signed votes, given the class."""
        import numpy as np

        signed = onehot[:, :, 1] - onehot[:, :, 0]
        total = np.zeros((signed.shape[1],) * 2)
        for w in (weights * (1 - p), weights * p):
            centred = signed - np.average(signed, axis=0, weights=w + 1e-12)
            total += (centred * w[:, None]).T @ centred
        scale = np.sqrt(np.clip(np.diag(total), 1e-9, None))
        self.correlation = total / scale[:, None] / scale[None, :]
        np.fill_diagonal(self.correlation, 1)
        # Chance alone makes small correlations; only clear ones count. Voters that exclude each
        # other are no repetition of one another.
        self.weight = 1 / np.where(self.correlation > 0.1, self.correlation, 0).sum(axis=1).clip(1)
        if self.anchor:
            self.weight[-1] = 1

    def posterior(self, votes):
        import numpy as np

        odds = np.log(self.answers[:, 1]) - np.log(self.answers[:, 0])
        votes = np.asarray(votes)
        picked = np.stack([np.where(votes == v, odds[:, k], 0.0) for k, v in enumerate((0, 1, -1))]).sum(axis=0)
        total = picked @ self.weight + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit_linear(rows, targets, size: int, l2: float = 1e-3, rounds: int = 300, rate: float = 0.1):
    """Weights and bias of a logistic regression on soft targets.

    rows: for each example the indices of its features, all of value one. Full gradients with Adam
    steps; no random numbers, so equal input gives equal weights.
    """
    import numpy as np

    counts = np.array([len(r) for r in rows], dtype=np.int64)
    columns = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if counts.sum() else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), counts)
    targets = np.asarray(targets, dtype=np.float64)
    w = np.zeros(size + 1)
    mean = float(np.clip(targets.mean() if len(targets) else 0.5, 1e-3, 1 - 1e-3))
    w[size] = np.log(mean / (1 - mean))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if len(rows) else 1):
        z = np.bincount(owner, weights=w[columns], minlength=len(rows)) + w[size]
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets
        gradient = np.concatenate([np.bincount(columns, weights=error[owner], minlength=size), [error.sum()]]) / len(rows)
        gradient[:size] += l2 * w[:size]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:size], float(w[size])
