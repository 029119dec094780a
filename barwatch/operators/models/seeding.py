"""Starting centres by k-means|| (Bahmani et al. 2012), as passes over all rows of each group."""

from __future__ import annotations

import numpy as np

from barwatch.operators.models.grouped import State

# Rounds, and candidates a round adds for each centre wanted.
ROUNDS, OVERSAMPLING = 5, 2
# Tries of the last step, which works on the weighted candidates alone.
_TRIES, _STEPS = 16, 20
_CHUNK = 8192


def _draws(u: np.ndarray, phase: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) for one round from each row's own number."""
    h = (u * (1 << 52)).astype(np.uint64) + np.uint64((phase * 0x9E3779B97F4A7C15 + seed) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest centre of each row and the squared distance to it."""
    place, gap = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), _CHUNK):
        squares = ((x[i : i + _CHUNK, None, :] - centres) ** 2).sum(axis=2)
        place[i : i + _CHUNK] = squares.argmin(axis=1)
        gap[i : i + _CHUNK] = squares.min(axis=1)
    return place, gap


class Seeding:
    """Passes 0 to ROUNDS draw candidates, pass ROUNDS + 1 weighs them.

    A round keeps the rows with the least -log(u) / d^2, where d is the
    distance to the nearest candidate so far: a weighted sample without
    replacement whose size is fixed and whose parts merge.  Every row takes
    part in every round, and each candidate's weight is the number of rows
    nearest to it.
    """

    LAST = ROUNDS + 1

    def __init__(self, k: int, seed: int) -> None:
        self.k, self.seed = k, seed

    def start(self, width: int) -> State:
        return State(0, np.array([float(width)]))

    def partial(self, state: State, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        candidates = self._candidates(state)
        if state.phase == self.LAST:
            return np.bincount(nearest(x, candidates)[0], minlength=len(candidates)).astype(float)
        weight = nearest(x, candidates)[1] if len(candidates) else np.ones(len(x))
        with np.errstate(divide="ignore"):
            key = np.where(weight > 0, -np.log(_draws(u, state.phase, self.seed)) / weight, np.inf)
        return self.merge(state.phase, [np.column_stack((key, x)).ravel()], x.shape[1])

    def merge(self, phase: int, parts: list[np.ndarray], width: int | None = None) -> np.ndarray:
        if phase == self.LAST:
            return np.sum(parts, axis=0)
        if width is None:  # merged parts name it
            width, parts = int(parts[0][0]), [p[1:] for p in parts]
        drawn = np.concatenate([p.reshape(-1, 1 + width) for p in parts])
        drawn = drawn[np.isfinite(drawn[:, 0])]
        most = OVERSAMPLING * self.k if phase else 1
        order = np.lexsort((*drawn[:, 1:].T, drawn[:, 0]))[:most]
        return np.append(float(width), drawn[order].ravel())

    def update(self, state: State, total: np.ndarray) -> State:
        if state.phase == self.LAST:
            return State(state.phase + 1, np.append(state.values[0], self._reduced(self._candidates(state), total).ravel()))
        width = int(state.values[0])
        drawn = total[1:].reshape(-1, 1 + width)[:, 1:]
        return State(state.phase + 1, np.append(state.values, drawn.ravel()))

    @staticmethod
    def _candidates(state: State) -> np.ndarray:
        return state.values[1:].reshape(-1, int(state.values[0]))

    def _reduced(self, candidates: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The k centres of least weighted cost that a few tries among the candidates find."""
        best, least = None, np.inf
        for attempt in range(_TRIES):
            rng = np.random.default_rng([self.seed, attempt])
            centres = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
            while len(centres) < self.k:
                pull = weights * nearest(candidates, np.array(centres))[1]
                centres.append(candidates[rng.choice(len(candidates), p=pull / pull.sum()) if pull.sum() > 0 else 0])
            centres = np.array(centres)
            for _ in range(_STEPS):
                member = np.eye(self.k)[nearest(candidates, centres)[0]] * weights[:, None]
                size = member.sum(axis=0)[:, None]
                centres = np.where(size > 0, member.T @ candidates / np.maximum(size, 1e-300), centres)
            cost = (weights * nearest(candidates, centres)[1]).sum()
            if cost < least:
                best, least = centres, cost
        return best
